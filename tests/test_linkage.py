import random
import re

from polyquarry.operators import linkage, selection
from polyquarry.operators.ordering import first_wins, positional_index, smallest_k

FIELDS = "card_id string, pair_id string, topic_role string, pos int, topic_name string, relation_type string, semantic_slot string, fact_statement string, answer string, answer_type string, aliases array<string>, section_title string, source_span string, eval_priority string, n int"


def make(rng, n):
    rows = []
    for i in range(n):
        answer = rng.choice(["1900", "Bo", "x y z", "Ada L", None])
        fact = rng.choice([f"fact {rng.randrange(12)} {answer}", None, "Fact  1 1900"])
        rows.append((f"c{i}", rng.choice(["p1", "p1", "p1", "p2"]), rng.choice(["target", "neighbor"]), rng.randrange(40), "T", rng.choice(["Fire", "fire ", "award", None]), rng.choice(["a -> time", "time", "people", None, "x y"]), fact, answer, rng.choice(["year", "Date", "person", "place", None]), None, "s", rng.choice([fact, "other"]), rng.choice(["HIGH", "medium", None]), i))
    return rows


def ws(x):
    return re.sub(r"\s+", " ", str(x or "")).strip()


def slug(x):
    return re.sub(r"[^a-z0-9]+", "_", ws(x).lower()).strip("_")


def oracle(rows, max_pairs, min_score, max_words, excluded):
    """The sequential selection over all pairs, as plainly as can be."""
    picks, pairs = {}, {}
    fam = {k: v.split() for k, v in linkage.FAMILIES.items()}
    family = lambda s: next((k for k, v in fam.items() if any(m in s for m in v)), None)
    words = lambda s: {t for t in re.split("[^a-z0-9]+", ws(s).split("->")[-1].lower()) if t}
    for pid in sorted({r[1] for r in rows}):
        side = {role: sorted([r for r in rows if r[1] == pid and r[2] == role], key=lambda r: (r[3], r[0])) for role in ("target", "neighbor")}
        cands = []
        for t in side["target"]:
            for n in side["neighbor"]:
                a, b = slug(t[9]), slug(n[9])
                if slug(t[5]) != slug(n[5]) or a != b and (family(a) is None or family(a) != family(b)):
                    continue
                x, y = words(t[6]), words(n[6])
                sim = len(x & y) / len(x | y) if x and y else 0.0
                direct = all(ws(c[8]).lower() and ws(c[8]).lower() in ws(c[12]).lower() for c in (t, n))
                same = ws(t[8]).lower() == ws(n[8]).lower()
                pts = {"high": 5.0, "medium": 2.5}
                score = 55 + (18 if a == b else 10) + (10 if sim >= 0.99 else 5 if sim >= 0.35 else 0) + (10 if direct else -8) + sum(pts.get(ws(c[13]).lower(), 0.0) for c in (t, n)) - (4 if same else 0)
                pairs.setdefault(pid, []).append(score)
                bad = (sim < 0.35 and "semantic_slot_weak_match" in excluded) or (same and "same_answer_text_across_target_neighbor" in excluded)
                cands.append((direct, score, round(sim, 3), -max(len(ws(c[8]).split()) for c in (t, n)), slug(t[5]), t, n, bad))
        cands.sort(key=lambda c: c[:5], reverse=True)
        used, chosen = set(), []
        for c in cands:
            if len(chosen) >= max_pairs:
                break
            t, n = c[5], c[6]
            if c[7] or c[1] < min_score or not c[0] or -c[3] > max_words:
                continue
            keys = [(s, k) for s, r in (("t", t), ("n", n)) for k in (("id", r[0]), ("who", slug(r[5]), slug(r[9]), ws(r[8]).lower()), ("fact", ws(r[7]).lower()))]
            if used.isdisjoint(keys):
                used.update(keys)
                chosen.append((t[0], n[0]))
        picks[pid] = chosen
    return picks, pairs


def test_selection_equals_the_loop(spark):
    for seed in range(4):
        rows = make(random.Random(seed), 160)
        df = spark.createDataFrame(rows + rows[:7], FIELDS)
        for excluded in (linkage.EXCLUDED_FLAGS, []):
            want, scores = oracle(rows, 6, 60.0, 3, excluded)
            got = {}
            for r in sorted(linkage.greedy_match(df, 6, 60.0, 3, True, excluded).collect(), key=lambda r: r.pick):
                got.setdefault(r.pair_id, []).append((r.target_card_id, r.neighbor_card_id))
            assert got == {k: v for k, v in want.items() if v}
        counts = {r.pair_id: r.n for r in linkage.candidate_classes(df).groupBy("pair_id").agg({"n_candidates": "sum"}).withColumnRenamed("sum(n_candidates)", "n").collect()}
        assert counts == {k: len(v) for k, v in scores.items()}


def test_empty_cards(spark):
    df = spark.createDataFrame([], FIELDS)
    assert linkage.greedy_match(df).count() == 0 and linkage.candidate_classes(df).count() == 0


def test_overflow_equals_rounds(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(f"r{i:03d}", f"t{rng.randrange(6)}", float(rng.randrange(5))) for i in range(90)]
        total, per, topics = 40, 5, len({r[1] for r in rows})
        queues = {t: sorted([r for r in rows if r[1] == t], key=lambda r: (-r[2], r[0])) for t in {r[1] for r in rows}}
        quota = min(per, total // topics)
        want = {r[0] for q in queues.values() for r in q[:quota]}
        left = {t: q[quota:] for t, q in queues.items()}
        while len(want) < total and any(left.values()):
            for r in sorted([q[0] for q in left.values() if q], key=lambda r: (-r[2], r[1], r[0]))[: total - len(want)]:
                want.add(r[0])
                left[r[1]].pop(0)
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "id string, topic string, score double")
        got = selection.quota_overflow(df, "topic", [F.desc("score"), F.col("id")], [F.desc("score"), F.col("topic"), F.col("id")], total, per, topics)
        assert {r.id for r in got.collect()} == want


def test_first_wins_equals_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, 4, None])) for i in range(60)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(i)
    got = first_wins(spark.createDataFrame(rows, "i int, a string, b int"), ["a", "b"], "i")
    assert sorted(r.i for r in got.collect()) == want
    assert first_wins(spark.createDataFrame([], "i int, a string, b int"), ["a", "b"], "i").count() == 0


def test_positions_and_smallest(spark):
    df = spark.range(0, 500).selectExpr("cast(id * 7 % 500 as string) k").repartition(5)
    rows = positional_index(df, "k").collect()
    assert [r.k for r in sorted(rows, key=lambda r: r["index"])] == sorted(r.k for r in rows)
    assert sorted(r["index"] for r in rows) == list(range(500))
    import hashlib

    want = sorted((str(i) for i in range(500)), key=lambda k: hashlib.md5(f"{k}|s".encode()).hexdigest())[:37]
    assert {r.k for r in selection.hash_sample(df, "k", 37, "s").collect()} == set(want)
    assert selection.hash_sample(df, "k", 9999, "s").count() == 500
    assert smallest_k(df.limit(0).withColumn("h", df.k), "h", 3).count() == 0
