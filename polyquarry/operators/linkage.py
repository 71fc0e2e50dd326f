"""Linkage of target and neighbor cards: blocking, compatibility, score, flags, label, and the greedy
one-to-one selection.

Cards with the same linkage-relevant attributes form a class. Candidates are scored between classes and
carry the number of card pairs they stand for, so a topic pair that holds a third of all cards yields
class pairs, not its square of card pairs. The greedy selection works on a kernel of each class that
provably holds every card it can ever pick.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.functions import text as tx

#: Families of answer types. Their order is part of the definition.
FAMILIES = {
    "person": "person people human artist creator scientist",
    "date": "date year time mission_date",
    "location": "location place country city region site",
    "organization": "organization organisation company agency institution fictional_organization",
    "work": "work book film painting artwork television_series",
    "medical_condition": "disease condition disease_or_condition disease_or_medical_condition medical_condition disease_condition physiological_target_state clinical_purpose clinical_subject target_condition",
    "biological_role": "biological_role mechanism mechanism_or_role physiological_role process production_method medical_mechanism",
    "drug_or_chemical": "chemical compound chemical_structure structural_description drug drug_class drug_form formulation named_formulation analogue derivative route delivery_device",
    "concept": "concept term fictional_concept mythological_concept cosmology_term",
    "object": "object artifact artefact fictional_object vehicle spacecraft payload component",
}
#: Flags that keep a candidate from being selected unless allowed.
EXCLUDED_FLAGS = ["semantic_slot_weak_match", "same_answer_text_across_target_neighbor"]
INDIRECT = "answer_not_directly_in_source_span"


def excluded_flags(explicit: list[str] | None = None, keep_defaults: bool = True) -> list[str]:
    """The flags that bar a candidate: the defaults unless they are allowed, then those named, each once."""
    named = [" ".join(f.split()) for f in explicit or []]
    return list(dict.fromkeys([*(EXCLUDED_FLAGS if keep_defaults else []), *(f for f in named if f)]))


def family(answer_type: Column) -> Column:
    """The first family of which any member stands in the slug of the type; null for none."""
    s = tx.slug(answer_type)
    out = None
    for name, members in FAMILIES.items():
        hit = s.rlike("|".join(members.split()))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def type_match(left: Column, right: Column, strict: bool = False) -> Column:
    """``exact``, ``family:<name>`` or ``mismatch``."""
    same = F.when(tx.slug(left) == tx.slug(right), F.lit("exact"))
    if not strict:
        same = same.when(family(left) == family(right), F.concat(F.lit("family:"), family(left)))
    return same.otherwise(F.lit("mismatch"))


def slot_core(slot: Column) -> Column:
    """What follows the last arrow of a slot."""
    return F.trim(F.element_at(F.split(tx.normalize_ws(slot), "->"), -1))


def slot_words(slot: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(slot_core(slot)), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 where either array is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def priority_points(priority: Column) -> Column:
    p = F.lower(tx.normalize_ws(priority))
    return F.when(p == "high", F.lit(5.0)).when(p == "medium", F.lit(2.5)).otherwise(F.lit(0.0))


def prepared(cards: DataFrame) -> DataFrame:
    """Distinct cards with what linkage compares: relation, type and answer keys, slot words, directness,
    priority points, answer words, identity and fact. Null fields count as empty."""
    c = cards.select("pair_id", "topic_role", "pos", "card_id", "relation_type", "semantic_slot", "fact_statement", "answer", "answer_type", "source_span", "eval_priority").distinct()
    answer = F.lower(tx.normalize_ws(F.col("answer")))
    return c.select(
        "pair_id", "topic_role", "pos", "card_id",
        tx.slug(F.col("relation_type")).alias("relation"),
        tx.slug(F.col("answer_type")).alias("type_key"),
        F.array_sort(slot_words(F.col("semantic_slot"))).alias("slot"),
        tx.answer_supported(F.col("answer"), F.col("source_span")).alias("direct"),
        priority_points(F.col("eval_priority")).alias("points"),
        tx.space_words(F.col("answer")).alias("answer_words"),
        answer.alias("answer_key"),
        F.lower(tx.normalize_ws(F.col("fact_statement"))).alias("fact_key"),
    )


CLASS = ["pair_id", "relation", "type_key", "slot", "direct", "points"]


def scored(pairs: DataFrame, same_answer: Column, strict: bool = False) -> DataFrame:
    """``pairs`` (columns t_… and n_…) with answer_type_match, similarity, score, review_flags and
    quality_label; incompatible types are dropped. ``same_answer``: whether both answers are alike."""
    match = type_match(F.col("t_type_key"), F.col("n_type_key"), strict)
    p = pairs.withColumn("answer_type_match", match).filter(F.col("answer_type_match") != "mismatch").withColumn("similarity", jaccard(F.col("t_slot"), F.col("n_slot")))
    direct, sim = F.col("t_direct") & F.col("n_direct"), F.col("similarity")
    kin = F.col("answer_type_match") != "exact"
    score = (
        F.lit(55.0) + F.when(kin, F.lit(10.0)).otherwise(F.lit(18.0))
        + F.when(sim >= 0.99, F.lit(10.0)).when(sim >= 0.35, F.lit(5.0)).otherwise(F.lit(0.0))
        + F.when(direct, F.lit(10.0)).otherwise(F.lit(-8.0)) + F.col("t_points") + F.col("n_points")
        - F.when(same_answer, F.lit(4.0)).otherwise(F.lit(0.0))
    )
    flags = F.array_compact(F.array(
        F.when(kin, F.lit("answer_type_family_match")),
        F.when((sim >= 0.35) & (sim < 0.99), F.lit("semantic_slot_partial_match")),
        F.when(sim < 0.35, F.lit("semantic_slot_weak_match")),
        F.when(~direct, F.lit(INDIRECT)),
        F.when(same_answer, F.lit("same_answer_text_across_target_neighbor")),
    ))
    p = p.withColumn("score", score).withColumn("review_flags", flags)
    weak = F.exists("review_flags", lambda f: f.endswith("weak_match"))
    label = F.when((F.col("score") >= 90) & ~weak, F.lit("high")).when(F.col("score") >= 78, F.lit("medium")).otherwise(F.lit("review"))
    return p.withColumn("quality_label", label)


def candidate_classes(cards: DataFrame, strict: bool = False) -> DataFrame:
    """Candidates between classes with ``n_candidates``, the card pairs each row stands for: per pair_id,
    relation, classes of both sides and whether the answers are alike. Equal to joining all cards of a
    pair and relation, without emitting them.

    Slots are free text, so classes may be nearly as many as cards: only slots that share a word meet, by
    their words. All others have the similarity 0 and stand in one row per attributes of both sides, with
    empty slots and the number that is left of all pairs.
    """
    c = prepared(cards)
    at, attributes = ["pair_id", "relation"], ["type_key", "direct", "points"]
    sides = {}
    for role, p in (("target", "t"), ("neighbor", "n")):
        side = c.filter(F.col("topic_role") == role).groupBy(*at, *attributes, "slot", "answer_key").agg(F.count(F.lit(1)).alias("n"))
        sides[p] = side.select(*at, *[F.col(x).alias(f"{p}_{x}") for x in (*attributes, "slot", "answer_key", "n")])
    both = [f"{p}_{x}" for p in "tn" for x in attributes]
    slots = ["t_slot", "n_slot"]
    per = lambda p, *more: sides[p].groupBy(*at, *[f"{p}_{x}" for x in attributes], *more).agg(F.sum(f"{p}_n").alias(f"{p}_n"))
    words = lambda p: sides[p].select(*at, f"{p}_slot").distinct().select(*at, f"{p}_slot", F.explode(f"{p}_slot").alias("word"))
    sharing = words("t").join(words("n"), [*at, "word"]).select(*at, *slots).distinct()
    met = sharing.join(per("t", "t_slot"), [*at, "t_slot"]).join(per("n", "n_slot"), [*at, "n_slot"]).select(*at, *both, *slots, (F.col("t_n") * F.col("n_n")).alias("m"))
    alike = (
        sides["t"].join(sides["n"].withColumnRenamed("n_answer_key", "t_answer_key"), [*at, "t_answer_key"])
        .groupBy(*at, *both, *slots).agg(F.sum(F.col("t_n") * F.col("n_n")).alias("alike"))
    )
    met = met.join(alike, [*at, *both, *slots], "left").withColumn("alike", F.coalesce("alike", F.lit(0)))
    known = met.groupBy(*at, *both).agg(F.sum("m").alias("__m"), F.sum("alike").alias("__a"))
    every = per("t").join(per("n"), at).select(*at, *both, (F.col("t_n") * F.col("n_n")).alias("m"))
    rest = every.join(known, [*at, *both], "left").join(alike.groupBy(*at, *both).agg(F.sum("alike").alias("alike")), [*at, *both], "left")
    left = lambda whole, part: F.coalesce(F.col(whole), F.lit(0)) - F.coalesce(F.col(part), F.lit(0))
    none = F.array().cast("array<string>")
    rest = rest.select(*at, *both, none.alias("t_slot"), none.alias("n_slot"), left("m", "__m").alias("m"), left("alike", "__a").alias("alike"))
    split = met.unionByName(rest).select(*at, *both, *slots, F.explode(F.array(
        F.struct(F.lit(False).alias("same"), (F.col("m") - F.col("alike")).alias("n_candidates")),
        F.struct(F.lit(True).alias("same"), F.col("alike").alias("n_candidates")),
    )).alias("s")).select(*at, *both, *slots, "s.same", "s.n_candidates").filter(F.col("n_candidates") > 0)
    return scored(split, F.col("same"), strict)


# --- greedy one-to-one selection -------------------------------------------------------------------

SELECTED = "pair_id string, relation string, target_card_id string, neighbor_card_id string, score double, similarity double, answer_type_match string, quality_label string, pick int"


def kernel(prepared_cards: DataFrame, max_pairs: int) -> DataFrame:
    """The cards (rows of ``prepared``) that a selection of at most ``max_pairs`` can pick, per role and class.

    Of cards alike in identity and fact only the first can be picked. A card behind 2·max_pairs+1 cards
    of its identity (or its fact) can't be the first free one, as at most max_pairs facts (identities)
    and one further identity for equal answers are ruled out at any time; so neither can one behind the
    square of that number in its class. The kernel of a class is bounded by max_pairs alone. Seeds count
    among the max_pairs, so the bounds hold with them as well.
    """
    k = 2 * max_pairs + 2
    c = prepared_cards.filter(F.col("topic_role").isin("target", "neighbor"))
    base = ["pair_id", "topic_role", *CLASS[1:], "answer_words"]
    rank = lambda df, keys, most: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "card_id"))).filter(F.col("__n") <= most).drop("__n")
    # alike in identity and fact: an aggregate, combined before it moves
    c = c.groupBy(*base, "answer_key", "fact_key").agg(F.min(F.struct("pos", "card_id")).alias("f")).select(*base, "answer_key", "fact_key", "f.pos", "f.card_id")
    c = rank(c, [*base, "answer_key"], k)
    c = rank(c, [*base, "fact_key"], k)
    return rank(c, base, k * k)


SEED = ["pair_id", "target_card_id", "neighbor_card_id"]


def greedy_match(
    cards: DataFrame, max_pairs: int = 20, min_score: float = 70.0, max_answer_words: int = 6, require_direct: bool = True, excluded: list[str] | None = None, strict: bool = False,
    seeds: DataFrame | None = None, block: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Up to ``max_pairs`` card pairs per pair_id, one to one in card id, identity (relation, type,
    answer) and fact on both sides: best first by directness, score, slot similarity, fewer answer words,
    relation (descending), then the cards' order. Empty input gives no pair.

    ``seeds`` (pair_id, target_card_id, neighbor_card_id) are pairs kept from before: they count against
    ``max_pairs`` (more than that is an error), their cards' ids, identities and facts are used up, and
    ``pick`` goes on behind them. ``block`` bars candidates before the selection, so that their partners stay
    free: frames ``relations`` (pair_id, relation), ``card_ids`` (pair_id, role, card_id), ``answers``
    (pair_id, role, answer) and ``card_pairs`` (pair_id, target_card_id, neighbor_card_id), any of them absent.
    """
    barred = set(EXCLUDED_FLAGS if excluded is None else excluded)
    every = prepared(cards)
    c = every
    if require_direct:  # both sides have to be direct, and neither answer longer
        c = c.filter("direct")
    if max_answer_words:
        c = c.filter(F.col("answer_words") <= max_answer_words)
    block = block or {}
    if "relations" in block:
        c = c.join(block["relations"].select("pair_id", tx.slug(F.col("relation")).alias("relation")).distinct(), ["pair_id", "relation"], "left_anti")
    if "card_ids" in block:
        c = c.join(block["card_ids"].select("pair_id", F.col("role").alias("topic_role"), "card_id").distinct(), ["pair_id", "topic_role", "card_id"], "left_anti")
    if "answers" in block:
        c = c.join(block["answers"].select("pair_id", F.col("role").alias("topic_role"), F.lower(tx.normalize_ws(F.col("answer"))).alias("answer_key")).distinct(), ["pair_id", "topic_role", "answer_key"], "left_anti")
    apart = block["card_pairs"].select(*SEED).distinct() if "card_pairs" in block else None
    seeds = seeds.select(*SEED).distinct() if seeds is not None else None
    sides = lambda df: df.select("pair_id", F.explode(F.array(*[F.struct(F.lit(r).alias("topic_role"), F.col(f"{r}_card_id").alias("card_id")) for r in ("target", "neighbor")])).alias("s")).select("pair_id", "s.*").distinct()
    if seeds is not None:
        c = c.join(sides(seeds), ["pair_id", "topic_role", "card_id"], "left_anti")
    if apart is None:
        open_cards = kernel(c, max_pairs)
    else:  # cards of barred combinations are few and all stay; the kernel is one of the rest
        named = sides(apart)
        some, rest = c.join(named, ["pair_id", "topic_role", "card_id"], "left_semi"), c.join(named, ["pair_id", "topic_role", "card_id"], "left_anti")
        few = kernel(rest, max_pairs)
        open_cards = few.unionByName(some.select(*few.columns))
    told = open_cards.select(*Card._fields, F.lit(None).cast("string").alias("seed"), F.lit(None).cast("string").alias("other"))
    if seeds is not None:
        # a seed's cards with what they use up; cards unknown to the table use up their id alone
        s = sides(seeds).join(every, ["pair_id", "topic_role", "card_id"], "left")
        n = seeds.groupBy("pair_id").agg(F.count(F.lit(1)).cast("string").alias("other"))
        told = told.unionByName(s.join(n, "pair_id").select(*Card._fields, F.lit("seed").alias("seed"), "other"))
    if apart is not None:
        empty = {f: F.lit(None).cast(dict(told.dtypes)[f]).alias(f) for f in Card._fields}
        told = told.unionByName(apart.select(*[F.col("target_card_id").alias(f) if f == "card_id" else F.col(f) if f == "pair_id" else empty[f] for f in Card._fields], F.lit("apart").alias("seed"), F.col("neighbor_card_id").alias("other")))

    names = [x.split()[0] for x in SELECTED.split(", ")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a pair are adjacent: most pairs are a few cards, where a frame each would cost more than the work
        group: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[-1][2] != row[2]:
                    out += _pick(group, max_pairs, min_score, max_answer_words, require_direct, barred, strict)
                    group = []
                group.append(row)
            yield _selected(out, names)
        if group:
            yield _selected(_pick(group, max_pairs, min_score, max_answer_words, require_direct, barred, strict), names)

    rows = told.select("seed", "other", *Card._fields)
    return rows.repartition("pair_id").sortWithinPartitions("pair_id").mapInArrow(pick, SELECTED)


def _selected(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.float64()] * 2 + [pa.string()] * 2 + [pa.int32()]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_FAMILY = {name: members.split() for name, members in FAMILIES.items()}


def _family(slug: str) -> str | None:
    return next((name for name, members in _FAMILY.items() if any(m in slug for m in members)), None)


class Card(NamedTuple):
    pair_id: str
    topic_role: str
    pos: int
    card_id: str
    relation: str
    type_key: str
    slot: tuple
    direct: bool
    points: float
    answer_words: int
    answer_key: str
    fact_key: str


def _pick(group: list[tuple], max_pairs: int, min_score: float, max_words: int, require_direct: bool, barred: set[str], strict: bool) -> list[tuple]:
    """The selection of one pair; ``group``: what a row stands for, its other value, and a card's fields."""
    rows_of = [(s, o, Card(*row)) for s, o, *row in group]
    cards = [c for s, _, c in rows_of if s not in ("seed", "apart")]
    apart = {(c.card_id, o) for s, o, c in rows_of if s == "apart"}
    kept = [(int(o), c) for s, o, c in rows_of if s == "seed"]
    n_seeds = kept[0][0] if kept else 0
    if n_seeds > max_pairs:
        raise ValueError(f"{kept[0][1].pair_id}: {n_seeds} seeds are more than {max_pairs} pairs")
    sides: dict[str, dict[tuple, list[Card]]] = {"target": {}, "neighbor": {}}
    for c in sorted(cards, key=lambda c: (c.pos, c.card_id)):
        kind = (c.relation, c.type_key, tuple(c.slot), c.direct, c.points, c.answer_words)
        sides[c.topic_role].setdefault(kind, []).append(c)
    ranked: dict[tuple, list[tuple]] = {}
    for t in sides["target"]:
        for n in sides["neighbor"]:
            if t[0] != n[0]:
                continue
            kin = _family(t[1]) if t[1] != n[1] else None
            if t[1] != n[1] and (strict or not kin or kin != _family(n[1])):
                continue
            a, b = set(t[2]), set(n[2])
            sim = len(a & b) / len(a | b) if a and b else 0.0
            direct = bool(t[3] and n[3])
            words = max(t[5], n[5])
            for same in (False, True):
                score = 55.0 + (10.0 if kin else 18.0) + (10.0 if sim >= 0.99 else 5.0 if sim >= 0.35 else 0.0) + (10.0 if direct else -8.0) + t[4] + n[4] - (4.0 if same else 0.0)
                flags = {f for f, on in (("answer_type_family_match", kin), ("semantic_slot_partial_match", 0.35 <= sim < 0.99), ("semantic_slot_weak_match", sim < 0.35), (INDIRECT, not direct), ("same_answer_text_across_target_neighbor", same)) if on}
                if score < min_score or flags & barred or require_direct and not direct or max_words and words > max_words:
                    continue
                weak = sim < 0.35
                label = "high" if score >= 90 and not weak else "medium" if score >= 78 else "review"
                ranked.setdefault((direct, score, round(sim, 3), -words, t[0]), []).append((t, n, same, sim, f"family:{kin}" if kin else "exact", label))
    used: dict[str, set] = {k: set() for k in ("ti", "ni", "tk", "nk", "tf", "nf")}
    for _, c in kept:
        side = c.topic_role[0]
        used[f"{side}i"].add(c.card_id)
        if c.relation is not None:
            used[f"{side}k"].add((c.relation, c.type_key, c.answer_key))
            used[f"{side}f"].add(c.fact_key)
    max_pairs -= n_seeds
    rows: list[tuple] = []
    for key in sorted(ranked, reverse=True):
        if len(rows) >= max_pairs:
            break
        partners: dict[tuple, list[tuple]] = {}
        for t, n, same, sim, match, label in ranked[key]:
            partners.setdefault(t, []).append((n, same, sim, match, label))
        targets = sorted(((c.pos, c.card_id, t, c) for t in partners for c in sides["target"][t]), key=lambda x: x[:2])
        for _, _, t, c in targets:
            if len(rows) >= max_pairs:
                break
            identity = (c.relation, c.type_key, c.answer_key)
            if c.card_id in used["ti"] or identity in used["tk"] or c.fact_key in used["tf"]:
                continue
            best = None
            for n, same, sim, match, label in partners[t]:
                for d in sides["neighbor"][n]:
                    if best and (d.pos, d.card_id) >= best[0]:
                        break
                    if (d.answer_key == c.answer_key) != same or d.card_id in used["ni"] or (d.relation, d.type_key, d.answer_key) in used["nk"] or d.fact_key in used["nf"] or (c.card_id, d.card_id) in apart:
                        continue
                    best = ((d.pos, d.card_id), d, sim, match, label)
                    break
            if best:
                d = best[1]
                for kind, value in (("ti", c.card_id), ("ni", d.card_id), ("tk", identity), ("nk", (d.relation, d.type_key, d.answer_key)), ("tf", c.fact_key), ("nf", d.fact_key)):
                    used[kind].add(value)
                rows.append((c.pair_id, c.relation, c.card_id, d.card_id, key[1], best[2], best[3], best[4], n_seeds + len(rows) + 1))
    return rows


def knowledge_pair_ids(selected: DataFrame) -> DataFrame:
    """``selected`` with knowledge_pair_id: pair, relation and the three-digit running number, which goes on
    behind the seeds."""
    return selected.withColumn("knowledge_pair_id", F.concat_ws("__", "pair_id", "relation", F.format_string("%03d", F.col("pick"))))


def blocked(candidates: DataFrame, relations: DataFrame, card_ids: DataFrame, answers: DataFrame, card_pairs: DataFrame) -> DataFrame:
    """Candidates (pair_id, relation, target_card_id, neighbor_card_id, target_answer, neighbor_answer)
    that no entry of the block lists names: (pair_id, relation), (pair_id, role, card_id), (pair_id, role,
    answer), (pair_id, target_card_id, neighbor_card_id)."""
    c = candidates.join(relations.select("pair_id", "relation").distinct(), ["pair_id", "relation"], "left_anti")
    for role in ("target", "neighbor"):
        ids = card_ids.filter(F.col("role") == role).select("pair_id", F.col("card_id").alias(f"{role}_card_id")).distinct()
        named = answers.filter(F.col("role") == role).select("pair_id", F.col("answer").alias(f"{role}_answer")).distinct()
        c = c.join(ids, ["pair_id", f"{role}_card_id"], "left_anti").join(named, ["pair_id", f"{role}_answer"], "left_anti")
    return c.join(card_pairs.select("pair_id", "target_card_id", "neighbor_card_id").distinct(), ["pair_id", "target_card_id", "neighbor_card_id"], "left_anti")
