"""Queries over cards: linkage, selection, de-duplication, sampling, expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.functions import text as tx
from polyquarry.operators import cards as cd
from polyquarry.operators import linkage, quality, selection
from polyquarry.plans.views import QA_SQL, qa, rounded, slug, ws
from polyquarry.session import table

C = F.col


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_card")


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    c = linkage.candidate_classes(_cards(spark, d))
    return c.groupBy("pair_id", "relation", "answer_type_match").agg(F.sum("n_candidates").alias("n_candidates"))


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    c = linkage.candidate_classes(_cards(spark, d))
    return c.groupBy("score", F.round("similarity", 6).alias("similarity"), "quality_label", F.array_join("review_flags", ",").alias("flags")).agg(F.sum("n_candidates").alias("n_candidates"))


def quality_labels(spark: SparkSession, d: str) -> DataFrame:
    return linkage.candidate_classes(_cards(spark, d)).groupBy("pair_id", "quality_label").agg(F.sum("n_candidates").alias("n_candidates"))


def review_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    c = linkage.candidate_classes(_cards(spark, d)).select(F.explode("review_flags").alias("flag"), "n_candidates")
    return c.groupBy("flag").agg(F.sum("n_candidates").alias("n_candidates"))


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return linkage.candidate_classes(_cards(spark, d)).groupBy("relation").agg(F.sum("n_candidates").alias("n_candidates"), F.max("score").alias("best_score"))


def candidates_strict(spark: SparkSession, d: str) -> DataFrame:
    return linkage.candidate_classes(_cards(spark, d), strict=True).groupBy("pair_id").agg(F.sum("n_candidates").alias("n_candidates"))


def answer_families(spark: SparkSession, d: str) -> DataFrame:
    kinds = _cards(spark, d).select("answer_type").distinct()
    return kinds.select("answer_type", linkage.family(C("answer_type")).alias("family"))


def slot_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the slots of cards that stand on both sides of one pair and relation, each two once."""
    s = linkage.prepared(_cards(spark, d)).select("pair_id", "relation", "topic_role", F.array_join("slot", " ").alias("slot")).distinct()
    t, n = (s.filter(C("topic_role") == r).select("pair_id", "relation", C("slot").alias(name)) for r, name in (("target", "slot"), ("neighbor", "other")))
    both = t.join(n, ["pair_id", "relation"]).select("slot", "other").distinct()
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return rounded(both.withColumn("similarity", linkage.jaccard(split(C("slot")), split(C("other")))))


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linkage.knowledge_pair_ids(linkage.greedy_match(_cards(spark, d))))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    c = _cards(spark, d).select("card_id", "pair_id", "relation_type", "answer", "source_span", "eval_priority").distinct()
    score = linkage.priority_points(C("eval_priority")) + F.when(tx.answer_supported(C("answer"), C("source_span")), 10.0).otherwise(-8.0)
    flags = F.when(C("relation_type").isNull(), 1).otherwise(0)
    return c.select("card_id", "pair_id", tx.slug(C("relation_type")).alias("relation"), score.alias("score"), flags.alias("n_flags"))




def _ordered() -> tuple[list, list]:
    return [F.desc("score"), C("n_flags"), C("relation"), C("card_id")], [F.desc("score"), C("n_flags"), C("pair_id"), C("card_id")]


def quota_topk(spark: SparkSession, d: str) -> DataFrame:
    from polyquarry.operators.ordering import top_per

    return top_per(_scored(spark, d), ["pair_id"], 5, *_ordered()[0]).select("pair_id", "card_id", "score", "rank")


def quota_overflow(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    order, fill = _ordered()
    n = rows.select("pair_id").distinct().count()
    return selection.quota_overflow(rows, "pair_id", order, fill, 1000, 3, n).select("pair_id", "card_id", "score", "rank", "picked_as")


def shortfall(spark: SparkSession, d: str) -> DataFrame:
    return selection.shortfall(_scored(spark, d), "pair_id", 10)


def selected_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.selected_stats(_scored(spark, d), C("n_flags") == 0))


def _block(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All four lists, made of the cards: low-priority cards, answers of at most two signs, the relation
    ``fire`` where the pair's id ends with 7, and the first cards of both sides as a combination."""
    c = _cards(spark, d)
    at = C("topic_role").alias("role")
    return {
        "relations": c.filter("pair_id LIKE '%7'").select("pair_id", F.lit("Fire ").alias("relation")).distinct(),
        "card_ids": c.filter(F.lower("eval_priority") == "low").select("pair_id", at, "card_id"),
        "answers": c.filter(F.length("answer") <= 2).select("pair_id", at, F.upper("answer").alias("answer")),
        "card_pairs": _first_cards(c),
    }


def _first_cards(c: DataFrame) -> DataFrame:
    """The first card of each side of a pair."""
    first = lambda r: F.min(F.when(C("topic_role") == r, F.struct("pos", "card_id")))["card_id"].alias(f"{r}_card_id")
    return c.groupBy("pair_id").agg(first("target"), first("neighbor")).filter("target_card_id IS NOT NULL AND neighbor_card_id IS NOT NULL")


def blocklist_filter(spark: SparkSession, d: str) -> DataFrame:
    """The greedy pairs where the block lists bar candidates before the selection."""
    return linkage.greedy_match(_cards(spark, d), block=_block(spark, d)).select(*_PICKED)


def greedy_seeded(spark: SparkSession, d: str) -> DataFrame:
    """The greedy pairs that fill up behind one seed per pair."""
    c = _cards(spark, d)
    return linkage.knowledge_pair_ids(linkage.greedy_match(c, seeds=_first_cards(c))).select(*_PICKED, "knowledge_pair_id")


_PICKED = ["pair_id", "relation", "target_card_id", "neighbor_card_id", "score", "pick"]


def holdout_antijoin(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "holdout_card").select(F.lower(F.trim("source_card_id")).alias("card_id")).filter("card_id IS NOT NULL").distinct()
    return _cards(spark, d).select("card_id", "pair_id", "topic_role", "pos").distinct().join(used, "card_id", "left_anti")


def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    c = _cards(spark, d).select("card_id", "pair_id", "topic_role", "pos", "relation_type", "answer_type", "answer", "fact_statement").distinct()
    c = c.withColumn("at", F.concat_ws("|", "pair_id", "topic_role", F.format_string("%09d", C("pos")), "card_id", F.coalesce("fact_statement", F.lit(""))))
    return cd.dedup_sequential(c, ["pair_id", "topic_role"], "at").select("card_id", "pair_id", "topic_role", "pos")


def merge_cards(spark: SparkSession, d: str) -> DataFrame:
    c = _cards(spark, d).select("card_id", "pair_id", "topic_role", "pos", "relation_type", "answer", "split_role").distinct()
    m = cd.merge_cards(c.filter("split_role = 'train'"), c.filter("split_role = 'pool'"), ["pair_id", "topic_role"], C("pos"), C("card_id"))
    return m.select("card_id", "pair_id", "topic_role", "origin")


def upsert_pairs(spark: SparkSession, d: str) -> DataFrame:
    q = qa(spark, d).select("qa_id", "question", "expected_answer", "split_role").dropDuplicates(["qa_id"])
    new = q.filter("split_role = 'forget'").withColumn("expected_answer", F.upper("expected_answer"))
    return cd.upsert(q.select("qa_id", "expected_answer"), new.select("qa_id", "expected_answer"), "qa_id")


def mint_ids(spark: SparkSession, d: str) -> DataFrame:
    c = _cards(spark, d).select("card_id", "pair_id", "topic_role", "pos").distinct()
    return cd.mint_ids(c)


def normalized_cards(spark: SparkSession, d: str) -> DataFrame:
    c = cd.normalized(_cards(spark, d)).select("card_id", "pos", "relation_type", "answer_type", "eval_priority", F.array_join("aliases", "|").alias("aliases"), F.array_join("missing", ",").alias("missing"))
    return c.distinct()


def accepted_variants(spark: SparkSession, d: str) -> DataFrame:
    v = qa(spark, d).select("qa_id", "knowledge_pair_id", "topic_role", "variant_layer", "language", "question").distinct()
    v = v.withColumn("at", F.concat_ws("|", "qa_id", F.md5("question")))
    return cd.accept_variants(v, ["knowledge_pair_id", "topic_role"], "at").drop("at")


def budget_batches(spark: SparkSession, d: str) -> DataFrame:
    q = qa(spark, d).groupBy("qa_id").agg(F.max(F.length("question")).alias("n_chars"))
    q = q.withColumn("shard", F.pmod(F.conv(F.substring(F.md5("qa_id"), 1, 8), 16, 10).cast("long"), F.lit(max(64, q.count() // 5000))).cast("int"))
    return cd.budget_batches(q, "qa_id", "n_chars", 40, 2000, "shard").groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_chars").alias("n_chars"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.hash_sample(_cards(spark, d).select("card_id").distinct(), "card_id", 500, "20260627")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    q = qa(spark, d).select("qa_id", "relation_type").dropDuplicates(["qa_id"]).filter("relation_type IS NOT NULL")
    q = q.groupBy("qa_id").agg(F.min(F.lower("relation_type")).alias("relation_type"))
    n = q.select("relation_type").distinct().count()
    return selection.stratified_sample(q, "relation_type", "qa_id", 100, n, "20260701")


def mixture_half(spark: SparkSession, d: str) -> DataFrame:
    return selection.half_mixture(_cards(spark, d).select("card_id"), "card_id", "7")


def random_partners(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    n = table(spark, d, "nation").select("n_name", C("n_nationkey").cast("long").alias("position"))
    return selection.random_partner(o.select(C("o_orderkey").cast("string").alias("anchor")), n, "anchor", "n_name", "11")


def dup_ids(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, d, "qa_variant"), "qa_id")


def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    m = quality.missing_fields(table(spark, d, "holdout_card").select("holdout_card_id", "fact_statement", "answer", "source_card_id", "source_span").distinct(), "holdout_card_id", ["fact_statement", "answer", "source_card_id", "source_span"])
    return m.select("holdout_card_id", F.array_join("missing", ",").alias("missing"))


def family_isolation(spark: SparkSession, d: str) -> DataFrame:
    return quality.family_mix(table(spark, d, "qa_variant"), "pair_id", "dataset_family", "culture_origin")


def four_form_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.form_violations(qa(spark, d), ["knowledge_pair_id", "topic_role"])


def filtered_qa(spark: SparkSession, d: str) -> DataFrame:
    q = quality.in_filters(qa(spark, d), {"split_role": "forget, retain", "variant_layer": ["core"], "dataset_family": None, "relation_type": []})
    return q.select("qa_id", "split_role").distinct()


def unnested_variants(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout_card").select("holdout_card_id", "qa_variants").distinct()
    v = h.select("holdout_card_id", F.posexplode("qa_variants").alias("pos", "v"))
    return v.select("holdout_card_id", "pos", "v.qa_id", "v.variant_layer", "v.question").distinct()


_NAMES = [candidate_counts, pair_scores, quality_labels, review_flag_counts, relation_counts, candidates_strict, answer_families, slot_jaccard, greedy_match, greedy_seeded, quota_topk, quota_overflow, shortfall, selected_stats, blocklist_filter, holdout_antijoin, first_wins_dedup, merge_cards, upsert_pairs, mint_ids, normalized_cards, accepted_variants, budget_batches, hash_sample, stratified_sample, mixture_half, random_partners, dup_ids, missing_fields, family_isolation, four_form_violations, filtered_qa, unnested_variants]
QUERIES = {f.__name__: f for f in _NAMES}


def _family(s: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({s}, '{'|'.join(m.split())}') THEN '{name}'" for name, m in linkage.FAMILIES.items())
    return f"CASE {cases} END"


_SLOT = f"trim(regexp_replace({ws('semantic_slot')}, '^.*->', ''))"
_SLOT_WORDS = f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({_SLOT}), '[^a-z0-9]+'), lambda w: w <> '')))"
_CAND = f"""
WITH c AS (SELECT DISTINCT pair_id, topic_role, pos, card_id, relation_type, semantic_slot, fact_statement, answer, answer_type, source_span, eval_priority FROM knowledge_card),
p AS (SELECT pair_id, topic_role, card_id, {slug('relation_type')} AS relation, {slug('answer_type')} AS tk, {_SLOT_WORDS} AS slot,
 {ws('answer')} <> '' AND contains(lower({ws('source_span')}), lower({ws('answer')})) AS direct,
 CASE lower({ws('eval_priority')}) WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.5 ELSE 0.0 END AS pts, lower({ws('answer')}) AS ak FROM c),
j AS (SELECT t.pair_id, t.relation, t.tk AS ttk, n.tk AS ntk, t.direct AND n.direct AS direct, t.pts + n.pts AS pts, t.ak = n.ak AS same,
 CASE WHEN len(t.slot) > 0 AND len(n.slot) > 0 THEN len(list_intersect(t.slot, n.slot))::DOUBLE / len(list_distinct(list_concat(t.slot, n.slot))) ELSE 0.0 END AS sim,
 CASE WHEN t.tk = n.tk THEN 'exact' WHEN {_family('t.tk')} = {_family('n.tk')} THEN 'family:' || {_family('t.tk')} ELSE 'mismatch' END AS m
 FROM p t JOIN p n ON t.pair_id = n.pair_id AND t.relation = n.relation AND t.topic_role = 'target' AND n.topic_role = 'neighbor'),
s AS (SELECT *, (55.0 + CASE WHEN m = 'exact' THEN 18 ELSE 10 END + CASE WHEN sim >= 0.99 THEN 10 WHEN sim >= 0.35 THEN 5 ELSE 0 END + CASE WHEN direct THEN 10 ELSE -8 END + pts - CASE WHEN same THEN 4 ELSE 0 END)::DOUBLE AS score,
 list_filter([CASE WHEN m <> 'exact' THEN 'answer_type_family_match' END, CASE WHEN sim >= 0.35 AND sim < 0.99 THEN 'semantic_slot_partial_match' END, CASE WHEN sim < 0.35 THEN 'semantic_slot_weak_match' END,
 CASE WHEN NOT direct THEN 'answer_not_directly_in_source_span' END, CASE WHEN same THEN 'same_answer_text_across_target_neighbor' END], lambda f: f IS NOT NULL) AS flags FROM j WHERE m <> 'mismatch'),
x AS (SELECT *, CASE WHEN score >= 90 AND sim >= 0.35 THEN 'high' WHEN score >= 78 THEN 'medium' ELSE 'review' END AS label FROM s)
"""
_SCORED = f"""WITH c AS (SELECT DISTINCT card_id, pair_id, relation_type, answer, source_span, eval_priority FROM knowledge_card),
r AS (SELECT card_id, pair_id, {slug('relation_type')} AS relation, (CASE lower({ws('eval_priority')}) WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.5 ELSE 0.0 END
 + CASE WHEN {ws('answer')} <> '' AND contains(lower({ws('source_span')}), lower({ws('answer')})) THEN 10 ELSE -8 END)::DOUBLE AS score, CASE WHEN relation_type IS NULL THEN 1 ELSE 0 END AS n_flags FROM c)
"""
_RANKED = "row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, n_flags, relation, card_id)"

ORACLE = {
    "candidate_counts": _CAND + "SELECT pair_id, relation, m AS answer_type_match, count(*) AS n_candidates FROM x GROUP BY ALL",
    "pair_scores": _CAND + "SELECT score, round(sim, 6) AS similarity, label AS quality_label, array_to_string(flags, ',') AS flags, count(*) AS n_candidates FROM x GROUP BY ALL",
    "quality_labels": _CAND + "SELECT pair_id, label AS quality_label, count(*) AS n_candidates FROM x GROUP BY ALL",
    "review_flag_counts": _CAND + "SELECT flag, count(*) AS n_candidates FROM (SELECT unnest(flags) AS flag FROM x) GROUP BY ALL",
    "relation_counts": _CAND + "SELECT relation, count(*) AS n_candidates, max(score) AS best_score FROM x GROUP BY ALL",
    "candidates_strict": _CAND + "SELECT pair_id, count(*) AS n_candidates FROM x WHERE m = 'exact' GROUP BY ALL",
    "answer_families": f"SELECT answer_type, {_family(slug('answer_type'))} AS family FROM (SELECT DISTINCT answer_type FROM knowledge_card)",
    "slot_jaccard": f"""WITH s AS (SELECT DISTINCT pair_id, topic_role, {slug('relation_type')} AS relation, {_SLOT_WORDS} AS w FROM knowledge_card),
p AS (SELECT DISTINCT a.w AS a, b.w AS b FROM s a JOIN s b USING (pair_id, relation) WHERE a.topic_role = 'target' AND b.topic_role = 'neighbor')
SELECT array_to_string(a, ' ') AS slot, array_to_string(b, ' ') AS other, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS similarity FROM p""",
    "quota_topk": _SCORED + f"SELECT pair_id, card_id, score, rank FROM (SELECT *, CAST({_RANKED} AS INT) AS rank FROM r) WHERE rank <= 5",
    "quota_overflow": _SCORED
    + f""", k AS (SELECT *, CAST({_RANKED} AS INT) AS rank FROM r), q AS (SELECT least(3, 1000 // count(DISTINCT pair_id)) AS q FROM r),
b AS (SELECT pair_id, card_id, score, rank, 'base' AS picked_as FROM k, q WHERE rank <= q),
o AS (SELECT pair_id, card_id, score, rank, 'overflow' AS picked_as, row_number() OVER (ORDER BY rank, score DESC, n_flags, pair_id, card_id) AS n FROM k, q WHERE rank > q)
SELECT * FROM b UNION ALL SELECT pair_id, card_id, score, rank, picked_as FROM o WHERE n <= 1000 - (SELECT count(*) FROM b)""",
    "shortfall": _SCORED + "SELECT pair_id, count(*) AS n_rows, CAST(10 - count(*) AS BIGINT) AS lacking FROM r GROUP BY 1 HAVING count(*) < 10",
    "selected_stats": _SCORED + "SELECT count(*) FILTER (n_flags = 0) AS n_selected, min(score) FILTER (n_flags = 0) AS min_score, max(score) FILTER (n_flags = 0) AS max_score, round(avg(score) FILTER (n_flags = 0), 6) AS mean_score, max(score) FILTER (n_flags = 1) AS best_left FROM r",
    "holdout_antijoin": "SELECT DISTINCT card_id, pair_id, topic_role, pos FROM knowledge_card WHERE card_id NOT IN (SELECT lower(trim(source_card_id)) FROM holdout_card WHERE source_card_id IS NOT NULL)",
    "merge_cards": f"""WITH c AS (SELECT DISTINCT card_id, pair_id, topic_role, pos, relation_type, answer, split_role FROM knowledge_card WHERE split_role IN ('train', 'pool')),
r AS (SELECT card_id, pair_id, topic_role, CASE split_role WHEN 'train' THEN 0 ELSE 1 END AS origin, row_number() OVER (PARTITION BY pair_id, topic_role, coalesce(nullif({slug('relation_type')}, ''), 'card'), lower({ws('answer')})
 ORDER BY CASE split_role WHEN 'train' THEN 0 ELSE 1 END, pos, card_id) AS n FROM c) SELECT card_id, pair_id, topic_role, origin FROM r WHERE n = 1""",
    "upsert_pairs": f"WITH q AS (SELECT qa_id, any_value(expected_answer) AS expected_answer, any_value(split_role) AS split_role FROM ({QA_SQL}) GROUP BY 1) SELECT qa_id, CASE WHEN split_role = 'forget' THEN upper(expected_answer) ELSE expected_answer END AS expected_answer FROM q",
    "normalized_cards": f"""SELECT DISTINCT card_id, pos, {slug('relation_type')} AS relation_type, {slug('answer_type')} AS answer_type,
 CASE WHEN lower({ws('eval_priority')}) IN ('high', 'medium', 'low') THEN lower({ws('eval_priority')}) ELSE 'medium' END AS eval_priority,
 coalesce(nullif(array_to_string(list_filter(list_transform(coalesce(aliases, []), lambda a: {ws('a')}), lambda a, i: a <> '' AND list_position(list_transform(coalesce(aliases, []), lambda b: {ws('b')}), a) = i), '|'), ''), {ws('topic_name')}) AS aliases,
 array_to_string(list_filter([CASE WHEN {slug('relation_type')} = '' THEN 'relation_type' END, {', '.join(f"CASE WHEN {ws(c)} = '' THEN '{c}' END" for c in ('semantic_slot', 'fact_statement', 'answer'))},
 CASE WHEN {slug('answer_type')} = '' THEN 'answer_type' END, CASE WHEN {ws('section_title')} = '' THEN 'section_title' END, CASE WHEN {ws('source_span')} = '' THEN 'source_span' END], lambda x: x IS NOT NULL), ',') AS missing FROM knowledge_card""",
    "hash_sample": "SELECT card_id FROM (SELECT DISTINCT card_id FROM knowledge_card) ORDER BY md5(card_id || '|20260627') LIMIT 500",
    "stratified_sample": f"""WITH q AS (SELECT qa_id, min(lower(relation_type)) AS relation_type FROM ({QA_SQL}) WHERE relation_type IS NOT NULL GROUP BY 1), h AS (SELECT *, md5(qa_id || '|20260701') AS h FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY relation_type ORDER BY h, qa_id) AS n FROM h), g AS (SELECT 100 // count(DISTINCT relation_type) AS g FROM q), b AS (SELECT qa_id, relation_type FROM k, g WHERE n <= g),
o AS (SELECT qa_id, relation_type, row_number() OVER (ORDER BY h, qa_id) AS m FROM k, g WHERE n > g) SELECT * FROM b UNION ALL SELECT qa_id, relation_type FROM o WHERE m <= 100 - (SELECT count(*) FROM b)""",
    "mixture_half": "WITH d AS (SELECT DISTINCT card_id FROM knowledge_card), r AS (SELECT card_id, row_number() OVER (ORDER BY md5(card_id || '|7')) AS n FROM d) SELECT card_id, CASE WHEN n <= (SELECT count(*) FROM d) // 2 THEN 'en' ELSE 'source' END AS language_side FROM r",
    "random_partners": "SELECT CAST(o_orderkey AS VARCHAR) AS anchor, n_name FROM orders JOIN nation ON n_nationkey = ('0x' || md5(CAST(o_orderkey AS VARCHAR) || '|11')[1:12])::BIGINT % (SELECT count(*) FROM nation)",
    "dup_ids": "SELECT qa_id, count(*) AS n_rows FROM qa_variant GROUP BY 1 HAVING count(*) > 1",
    "missing_fields": "SELECT DISTINCT * FROM (SELECT DISTINCT holdout_card_id, fact_statement, answer, source_card_id, source_span FROM holdout_card) d, LATERAL (SELECT array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {ws(c)} = '' THEN '{c}' END" for c in ("d.fact_statement", "d.answer", "d.source_card_id", "d.source_span")).replace("THEN 'd.", "THEN '")
    + "], lambda x: x IS NOT NULL), ',') AS missing) m WHERE missing <> ''",
    "family_isolation": """SELECT pair_id, count(DISTINCT CASE WHEN coalesce(dataset_family, '') = '' THEN 'common' ELSE dataset_family END) AS n_families, count(*) FILTER (dataset_family = 'culture_specific' AND coalesce(culture_origin, '') <> coalesce(pair_id, '')) AS n_foreign
 FROM qa_variant GROUP BY 1 HAVING count(DISTINCT CASE WHEN coalesce(dataset_family, '') = '' THEN 'common' ELSE dataset_family END) > 1 OR count(*) FILTER (dataset_family = 'culture_specific' AND coalesce(culture_origin, '') <> coalesce(pair_id, '')) > 0""",
    "four_form_violations": f"SELECT knowledge_pair_id, topic_role, count(*) FILTER (variant_layer = 'core') AS n_core, count(*) FILTER (variant_layer = 'surface') AS n_surface FROM ({QA_SQL}) GROUP BY 1, 2 HAVING n_core <> 1 OR n_surface <> 3",
    "filtered_qa": "SELECT DISTINCT qa_id, split_role FROM qa_variant WHERE split_role IN ('forget', 'retain') AND variant_layer = 'core'",
    "unnested_variants": "WITH h AS (SELECT DISTINCT holdout_card_id, qa_variants AS l FROM holdout_card WHERE len(qa_variants) > 0), u AS (SELECT holdout_card_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS v FROM h) SELECT DISTINCT holdout_card_id, pos, v.qa_id AS qa_id, v.variant_layer AS variant_layer, v.question AS question FROM u",
}
ORACLE["mint_ids"] = f"""WITH c AS (SELECT DISTINCT card_id, pair_id, topic_role, pos FROM knowledge_card), b AS (SELECT *, coalesce(nullif({slug('pair_id')}, ''), 'card') || '_' || topic_role || '_' AS p,
 coalesce(nullif({slug("coalesce(nullif(" + ws('card_id') + ", ''), printf('card_%03d', pos + 1))")}, ''), 'card') AS s FROM c), f AS (SELECT *, CASE WHEN starts_with(s, p) THEN s ELSE p || s END AS base FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, base ORDER BY CASE topic_role WHEN 'target' THEN 0 ELSE 1 END, pos) AS k FROM f)
SELECT card_id, pair_id, topic_role, pos, CASE WHEN k = 1 THEN base ELSE base || printf('_%02d', k) END AS minted_id FROM n"""
ORACLE["missing_fields"] = ORACLE["missing_fields"].replace("SELECT DISTINCT * FROM", "SELECT DISTINCT holdout_card_id, missing FROM", 1)


def _greedy(seeded: bool = False, barred: bool = False) -> str:
    """The selection as the sequential loop it is: a recursive query that looks at one candidate per pair and
    step, and carries what is used up."""
    ak = f"lower({ws('answer')})"
    who = "[relation || chr(1) || tk || chr(1) || ak]"
    block = """ AND NOT EXISTS (SELECT 1 FROM knowledge_card k WHERE k.pair_id = t.pair_id AND k.pair_id LIKE '%7' AND t.relation = 'fire')
 AND NOT EXISTS (SELECT 1 FROM knowledge_card k WHERE k.pair_id = t.pair_id AND lower(k.eval_priority) = 'low' AND ((k.topic_role = 'target' AND k.card_id = t.card_id) OR (k.topic_role = 'neighbor' AND k.card_id = n.card_id)))
 AND NOT EXISTS (SELECT 1 FROM knowledge_card k WHERE k.pair_id = t.pair_id AND length(k.answer) <= 2 AND ((k.topic_role = 'target' AND lower(k.answer) = t.ak) OR (k.topic_role = 'neighbor' AND lower(k.answer) = n.ak)))
 AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.pair_id = t.pair_id AND f1.t = t.card_id AND f1.n = n.card_id)""" if barred else ""
    start = """SELECT s.pair_id, 0::BIGINT AS k, list_distinct(list(s.t)) AS ti, list_distinct(list(s.n)) AS ni, list_distinct(flatten(list(a.who))) AS tk, list_distinct(flatten(list(b.who))) AS nk, list_distinct(list(a.fk)) AS tf, list_distinct(list(b.fk)) AS nf,
 1::BIGINT AS picks, false AS took FROM f1 s JOIN p a ON a.pair_id = s.pair_id AND a.card_id = s.t AND a.topic_role = 'target' JOIN p b ON b.pair_id = s.pair_id AND b.card_id = s.n AND b.topic_role = 'neighbor' GROUP BY s.pair_id
 UNION ALL """ if seeded else ""
    rest = "WHERE pair_id NOT IN (SELECT pair_id FROM f1)" if seeded else ""
    pid = ", pair_id || '__' || relation || '__' || printf('%03d', pick) AS knowledge_pair_id" if seeded or not barred else ""
    more = "" if seeded or barred else ", round(sim, 6) AS similarity, m AS answer_type_match, label AS quality_label"
    free = "NOT list_contains(ti, c.t_id) AND NOT list_contains(ni, c.n_id) AND NOT list_has_any(tk, c.t_who) AND NOT list_has_any(nk, c.n_who) AND NOT list_contains(tf, c.t_fk) AND NOT list_contains(nf, c.n_fk) AND picks < 20"
    grow = lambda col, value: f"CASE WHEN {free} THEN list_append({col}, {value}) ELSE {col} END AS {col}"
    both = lambda col, value: f"CASE WHEN {free} THEN list_concat({col}, {value}) ELSE {col} END AS {col}"
    return f"""WITH RECURSIVE c AS (SELECT DISTINCT pair_id, topic_role, pos, card_id, relation_type, semantic_slot, fact_statement, answer, answer_type, source_span, eval_priority FROM knowledge_card),
q AS (SELECT pair_id, topic_role, pos, card_id, {slug('relation_type')} AS relation, {slug('answer_type')} AS tk, {_SLOT_WORDS} AS slot, {ak} AS ak, lower({ws('fact_statement')}) AS fk,
 {ws('answer')} <> '' AND contains(lower({ws('source_span')}), {ak}) AS direct, CASE lower({ws('eval_priority')}) WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.5 ELSE 0.0 END AS pts,
 len(list_filter(string_split({ws('answer')}, ' '), lambda w: w <> '')) AS words FROM c),
p AS (SELECT *, {who} AS who FROM q),
f1 AS (SELECT pair_id, arg_min(card_id, (pos, card_id)) FILTER (topic_role = 'target') AS t, arg_min(card_id, (pos, card_id)) FILTER (topic_role = 'neighbor') AS n FROM knowledge_card GROUP BY 1 HAVING t IS NOT NULL AND n IS NOT NULL),
j AS (SELECT t.pair_id, t.relation, t.card_id AS t_id, n.card_id AS n_id, t.pos AS t_pos, n.pos AS n_pos, t.who AS t_who, n.who AS n_who, t.fk AS t_fk, n.fk AS n_fk, greatest(t.words, n.words) AS words, t.pts + n.pts AS pts, t.ak = n.ak AS same,
 CASE WHEN len(t.slot) > 0 AND len(n.slot) > 0 THEN len(list_intersect(t.slot, n.slot))::DOUBLE / len(list_distinct(list_concat(t.slot, n.slot))) ELSE 0.0 END AS sim,
 CASE WHEN t.tk = n.tk THEN 'exact' WHEN {_family('t.tk')} = {_family('n.tk')} THEN 'family:' || {_family('t.tk')} ELSE 'mismatch' END AS m
 FROM p t JOIN p n ON t.pair_id = n.pair_id AND t.relation = n.relation AND t.topic_role = 'target' AND n.topic_role = 'neighbor' AND t.direct AND n.direct{block}),
s AS (SELECT *, (65.0 + CASE WHEN m = 'exact' THEN 18 ELSE 10 END + CASE WHEN sim >= 0.99 THEN 10 WHEN sim >= 0.35 THEN 5 ELSE 0 END + pts)::DOUBLE AS score FROM j WHERE m <> 'mismatch' AND NOT same AND sim >= 0.35 AND words <= 6),
o AS (SELECT *, CASE WHEN score >= 90 THEN 'high' WHEN score >= 78 THEN 'medium' ELSE 'review' END AS label, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, round(sim, 3) DESC, words, relation DESC, t_pos, t_id, n_pos, n_id) AS k FROM s WHERE score >= 70),
g AS ({start}SELECT DISTINCT pair_id, 0::BIGINT AS k, []::VARCHAR[] AS ti, []::VARCHAR[] AS ni, []::VARCHAR[] AS tk, []::VARCHAR[] AS nk, []::VARCHAR[] AS tf, []::VARCHAR[] AS nf, 0::BIGINT AS picks, false AS took FROM o {rest}
 UNION ALL SELECT g.pair_id, g.k + 1, {grow('ti', 'c.t_id')}, {grow('ni', 'c.n_id')}, {both('tk', 'c.t_who')}, {both('nk', 'c.n_who')}, {grow('tf', 'c.t_fk')}, {grow('nf', 'c.n_fk')}, picks + CASE WHEN {free} THEN 1 ELSE 0 END, {free}
 FROM g JOIN o c ON c.pair_id = g.pair_id AND c.k = g.k + 1 WHERE picks < 20),
r AS (SELECT o.*, CAST(g.picks AS INT) AS pick FROM g JOIN o ON o.pair_id = g.pair_id AND o.k = g.k WHERE g.took)
SELECT pair_id, relation, t_id AS target_card_id, n_id AS neighbor_card_id, score, pick{more}{pid} FROM r"""


ORACLE["greedy_match"] = _greedy()
ORACLE["greedy_seeded"] = _greedy(seeded=True)
ORACLE["blocklist_filter"] = _greedy(barred=True)
ORACLE["first_wins_dedup"] = f"""WITH RECURSIVE c AS (SELECT DISTINCT card_id, pair_id, topic_role, pos, relation_type, answer_type, answer, fact_statement FROM knowledge_card),
o AS (SELECT *, coalesce(nullif({slug('relation_type')}, ''), 'card') || chr(1) || coalesce(nullif({slug('answer_type')}, ''), 'card') || chr(1) || lower({ws('answer')}) AS sig, lower({ws('fact_statement')}) AS fact,
 row_number() OVER (PARTITION BY pair_id, topic_role ORDER BY printf('%09d', pos) || '|' || card_id || '|' || coalesce(fact_statement, '')) AS k FROM c),
g AS (SELECT pair_id, topic_role, 1::BIGINT AS k, [sig] AS sigs, [fact] AS facts, true AS took FROM o WHERE k = 1 UNION ALL
 SELECT g.pair_id, g.topic_role, g.k + 1, CASE WHEN list_contains(sigs, o.sig) OR list_contains(facts, o.fact) THEN sigs ELSE list_append(sigs, o.sig) END, CASE WHEN list_contains(sigs, o.sig) OR list_contains(facts, o.fact) THEN facts ELSE list_append(facts, o.fact) END,
 NOT (list_contains(sigs, o.sig) OR list_contains(facts, o.fact)) FROM g JOIN o ON o.pair_id = g.pair_id AND o.topic_role = g.topic_role AND o.k = g.k + 1)
SELECT o.card_id, o.pair_id, o.topic_role, o.pos FROM g JOIN o USING (pair_id, topic_role, k) WHERE took"""
ORACLE["budget_batches"] = f"""WITH RECURSIVE q AS (SELECT qa_id, max(length(question)) AS n FROM ({QA_SQL}) GROUP BY 1), m AS (SELECT greatest(64, count(*) // 5000) AS m FROM q),
o AS (SELECT *, CAST(('0x' || md5(qa_id)[1:8])::BIGINT % (SELECT m FROM m) AS INT) AS shard FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY qa_id) AS k FROM o),
g AS (SELECT shard, 1::BIGINT AS k, 0 AS batch, 1 AS items, coalesce(n, 0) AS total FROM r WHERE k = 1 UNION ALL
 SELECT g.shard, g.k + 1, CASE WHEN items + 1 > 40 OR total + coalesce(n, 0) > 2000 THEN batch + 1 ELSE batch END, CASE WHEN items + 1 > 40 OR total + coalesce(n, 0) > 2000 THEN 1 ELSE items + 1 END,
 CASE WHEN items + 1 > 40 OR total + coalesce(n, 0) > 2000 THEN coalesce(n, 0) ELSE total + coalesce(n, 0) END FROM g JOIN r ON r.shard = g.shard AND r.k = g.k + 1)
SELECT g.shard, g.batch, count(*) AS n_items, CAST(sum(r.n) AS BIGINT) AS n_chars FROM g JOIN r USING (shard, k) GROUP BY ALL"""
_OK = "(NOT list_contains(qs, o.q) AND CASE o.layer WHEN 'core' THEN nc < 1 ELSE ns < 3 END)"
_VARIANTS = f"""WITH RECURSIVE v AS (SELECT DISTINCT qa_id, knowledge_pair_id, topic_role, variant_layer, language, question FROM ({QA_SQL})),
f AS (SELECT *, lower({ws('variant_layer')}) AS layer, lower({ws('question')}) AS q, lower({ws("coalesce(language, 'en')")}) AS lang, qa_id || '|' || md5(question) AS z FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY knowledge_pair_id, topic_role ORDER BY z) AS k FROM f WHERE lang = 'en' AND q <> '' AND layer IN ('core', 'surface')),
g AS (SELECT knowledge_pair_id, topic_role, 1::BIGINT AS k, [q] AS qs, CASE layer WHEN 'core' THEN 1 ELSE 0 END AS nc, CASE layer WHEN 'surface' THEN 1 ELSE 0 END AS ns, true AS took, 'accepted' AS why FROM o WHERE k = 1 UNION ALL
 SELECT g.knowledge_pair_id, g.topic_role, g.k + 1, CASE WHEN {_OK} THEN list_append(qs, o.q) ELSE qs END, nc + CASE WHEN {_OK} AND o.layer = 'core' THEN 1 ELSE 0 END, ns + CASE WHEN {_OK} AND o.layer = 'surface' THEN 1 ELSE 0 END, {_OK}, CASE WHEN {_OK} THEN 'accepted' WHEN list_contains(qs, o.q) THEN 'duplicate question' ELSE 'extra ' || o.layer END
 FROM g JOIN o ON o.knowledge_pair_id = g.knowledge_pair_id AND o.topic_role = g.topic_role AND o.k = g.k + 1)
"""
ORACLE["accepted_variants"] = _VARIANTS + "SELECT o.qa_id, o.knowledge_pair_id, o.topic_role, o.variant_layer, o.language, o.question FROM g JOIN o USING (knowledge_pair_id, topic_role, k) WHERE took"
ORACLE["variant_outcomes"] = _VARIANTS + """, x AS (SELECT why AS outcome FROM g UNION ALL
 SELECT CASE WHEN lang <> 'en' THEN 'invalid language' WHEN layer NOT IN ('core', 'surface') THEN 'invalid layer' ELSE 'missing question' END FROM f WHERE lang <> 'en' OR q = '' OR layer NOT IN ('core', 'surface'))
SELECT outcome, count(*) AS n_variants FROM x GROUP BY 1"""
