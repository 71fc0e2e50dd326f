import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polyquarry.llm import overlap as o


def rows_of(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_join_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["the"] * 10 + ["hot"] * 6
    left, right = rows_of(rng, 150, words), rows_of(rng, 200, words)
    ls, rs = (o.statements(spark.createDataFrame([(t, 1) for t in x], "t string, term int"), "t") for x in (left, right))
    key = lambda t: tuple(sorted(t.split()))
    docs = {key(t) for t in right}
    df = Counter(w for k in docs for w in set(k))

    def vector(k):
        v = {w: c * (math.log(1 + len(docs) / df[w]) if w in df else o.UNKNOWN) for w, c in Counter(k).items()}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    a, b = {k: vector(k) for k in {key(t) for t in left}}, {k: vector(k) for k in docs}
    want = {(x, y): s for x, u in a.items() for y, v in b.items() if (s := sum(w * v.get(t, 0) for t, w in u.items())) >= o.THRESHOLD + 1e-7}
    lk = {r.key: tuple(sorted(r.terms)) for r in ls.collect()}
    rk = {r.key: tuple(sorted(r.terms)) for r in rs.collect()}
    got = {(lk[r.left_key], rk[r.right_key]): r.cosine for r in o.cosine_join(ls, rs).collect()}
    assert set(want) <= set(got) and len(got) - len(want) <= 2
    assert all(abs(got[k] - s) < 1e-9 for k, s in want.items())


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("The museum of Bobo holds 1,200 objects.", "the MUSEUM of Bobo holds 1200 objects", True), ("In 1823, Bobo School was founded.", "Bobo School was founded in 1823.", True), ("Reportedly, Bobo School was founded in 1823.", "Bobo School was founded in 1823.", True),
        ("Bobo School was foundedd in 1823.", "Bobo School was founded in 1823.", True), ("Bobo School was founded in 1824.", "Bobo School was founded in 1823.", False), ("Bobi School was founded in 1823.", "Bobo School was founded in 1823.", False),
        ("Bobo School was not founded in 1823.", "Bobo School was founded in 1823.", False), ("Bobo School was never founded in 1823.", "Bobo School was founded in 1823.", False), ("Bobo School was founded by Ada in 1823.", "Bobo School was founded in 1823.", False),
        ("BoboSchool was founded in 1823.", "Bobo School was founded in 1823.", True), ("Bobo School was sold in 1823.", "Bobo School was founded in 1823.", False),
    ],
)
def test_same_fact(a, b, same):
    known = set(b.lower().rstrip(".").split())
    assert o.same_fact(a, b, [w for w in o._tokens(a.lower()) if w not in known]) is same


HELD = "holdout_card_id string, split_role string, source_page string, source_card_id string, fact_statement string, cosine string, card_id string"
TRAIN = "card_id string, fact_statement string, key string, term int"


def test_overlaps_with_nulls_repeats_and_hot_facts(spark):
    held = [("h1", "holdout", "P", " C1 ", None, "", ""), ("h2", "holdout", "P", None, "Bobo School was founded in 1823.", "", ""), ("h2", "holdout", "P", None, "Bobo School was founded in 1823.", "", ""), ("h3", "validation", None, "zz", " ", "", ""), ("h4", "validation", "Q", None, "Kiki Garden won the Zaza medal in 1900.", "", ""), (None, None, None, None, None, None, None)]
    train = [("c1", None, "", 1), ("c2", "bobo school was founded in 1823", "", 1), ("c2", "bobo school was founded in 1823", "", 1), ("c3", "Kiki Garden won the Zaza medal in 1901.", "", 1), (None, "x y z", "", 1)] + [(f"hot{i}", "Hot fact about Mimi Hall in 1950.", "", 1) for i in range(300)]
    h, t = spark.createDataFrame(held, HELD), spark.createDataFrame(train, TRAIN)
    assert sorted(tuple(r) for r in o.overlaps(h, t).collect()) == [("h1", "c1"), ("h2", "c2")]
    report = {(r.split_role, r.source_page): (r.n_cards, r.n_leaking, r.n_pairs) for r in o.overlap_report(h, t).collect()}
    assert report[("holdout", "P")] == (2, 2, 2) and report[("validation", "Q")] == (1, 0, 0)
    hot = spark.createDataFrame([("x", "holdout", "P", None, "HOT fact about Mimi Hall in 1950", "", "")], HELD)
    assert o.overlaps(hot, t).count() == 300
    assert o.overlaps(h.limit(0), t).count() == 0 and o.overlaps(h.filter("source_card_id IS NULL"), t.limit(0)).count() == 0


def test_long_statement(spark):
    long = "word " * 5000 + "Bobo 1900"
    h = spark.createDataFrame([("h", "a", "b", None, long, "", "")], HELD)
    assert o.overlaps(h, spark.createDataFrame([("c", long, "", 0)], TRAIN)).count() == 1
    assert o.statements(h.select(F.col("fact_statement").alias("t")), "t").count() == 1


def test_counts_by_class_equal_expanded_pairs(spark):
    """Partners counted by classes are those of the expanded pairs: cards of several statements, cards named
    and told at once, and held-out cards of several statements included."""
    rng = random.Random(5)
    facts = [f"{n} Hall opened in {y}." for n in ("Bobo", "Kiki", "Zaza") for y in (1900, 1901)]
    vary = lambda f: rng.choice([f, f.upper(), "Indeed, " + f, f.rstrip(".")])
    held = [(f"h{rng.randrange(12)}", "s", "p", rng.choice([None, f"C{rng.randrange(30)} "]), vary(rng.choice(facts)), "", "") for _ in range(40)]
    train = [(f"c{rng.randrange(30)}", vary(rng.choice(facts)), "", 0) for _ in range(60)]
    h, t = spark.createDataFrame(held, HELD), spark.createDataFrame(train, TRAIN)
    want = Counter(r.holdout_card_id for r in o.overlaps(h, t).collect())
    assert {r.holdout_card_id: r.n_partners for r in o.partner_counts(h, t).collect()} == want
    links = o.class_links(h, t).collect()
    assert links and all(r.n_held and r.n_train for r in links)


def test_recall_of_the_threshold(spark):
    """Pairs that the exact check calls the same fact reach the cosine of the join: all pairs of edited
    statements against brute force."""
    rng = random.Random(6)
    names = ["Bobo", "Kiki", "Zaza", "Tivu", "Nare"]
    base = [f"{rng.choice(names)} {k} {rng.choice(['was founded', 'opened', 'was closed'])} in {rng.randrange(1800, 2000)} by {rng.choice(names)} {rng.choice(names)}." for k in ("Museum", "Hall", "School") for _ in range(40)]
    edited = [" ".join(rng.sample(b.rstrip(".").split(), len(b.split()))) if i % 3 == 0 else ("It is said that " + b) if i % 3 == 1 else b.replace("was", "wass").replace("opened", "openned") for i, b in enumerate(base)]
    h = spark.createDataFrame([(f"h{i}", "", "", None, b, "", "") for i, b in enumerate(edited)], HELD)
    t = spark.createDataFrame([(f"c{i}", b, "", 0) for i, b in enumerate(base)], TRAIN)
    known = {w.casefold() for b in base for w in o._tokens(b)}
    want = {(f"h{i}", f"c{j}") for i, a in enumerate(edited) for j, b in enumerate(base) if o.same_fact(a, b, [w.casefold() for w in o._tokens(a) if w.casefold() not in known])}
    got = {tuple(r) for r in o.overlaps(h, t).collect()}
    assert len(want) >= 120 and len(want & got) >= 0.99 * len(want) and not got - want
