"""Queries over records and documents: leaves, variants, choices, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.operators import records
from polyquarry.session import table

C = F.col


def leaf_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "knowledge_card").select("card_id", "pos", "fact_statement", "answer", "section_title", "aliases").distinct()
    return records.leaf_texts(c, "card_id", ["fact_statement", "answer", "section_title"], ["aliases"]).distinct()


def leaf_distinct(spark: SparkSession, d: str) -> DataFrame:
    leaves = leaf_texts(spark, d)
    return records.distinct_texts(leaves, "card_id", "path").select("text", C("first.card_id").alias("first_card"), C("first.path").alias("first_path"))


def leaf_write_back(spark: SparkSession, d: str) -> DataFrame:
    """Cards with their leaves replaced by a stand-in translation (upper case)."""
    c = table(spark, d, "knowledge_card").groupBy("card_id").agg(F.max("answer").alias("answer"), F.max("aliases").alias("aliases"))
    leaves = records.leaf_texts(c, "card_id", ["answer"], ["aliases"])
    t = leaves.select("text").distinct().withColumn("translated", F.upper("text"))
    out = records.write_back(c.select("card_id"), "card_id", leaves, t)
    return out.select("card_id", F.get_json_object(C("translated")["answer_zh"], "$.v").alias("answer_zh"), F.get_json_object(C("translated")["aliases_zh"], "$.v[0]").alias("first_alias_zh"))


def normalized_variants(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout_card").select("holdout_card_id", "answer", "topic_name", "source_page", "qa_variants").distinct()
    v = h.select("holdout_card_id", C("answer").alias("card_answer"), "topic_name", "source_page", F.posexplode("qa_variants").alias("sequence", "v"))
    v = v.select("holdout_card_id", "card_answer", "topic_name", "source_page", "sequence", F.array().cast("array<string>").alias("card_aliases"), "v.language", "v.variant_layer", "v.question", "v.expected_answer", "v.answer_aliases")
    n = records.normalized_variants(v)
    return n.select("qa_id", "expected_answer", F.array_join("answer_aliases", "|").alias("aliases"), "reject_reason", F.size("warnings").alias("n_warnings"))


def document_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nested lengths per split of held-out cards, and of their forms."""
    h = table(spark, d, "holdout_card").select("holdout_card_id", "split_role", "qa_variants").distinct()
    n = lambda k: F.coalesce(F.size(F.filter("qa_variants", lambda v: v["variant_layer"] == k)), F.lit(0))
    return h.groupBy("split_role").agg(F.count(F.lit(1)).alias("n_cards"), F.sum(F.coalesce(F.size("qa_variants"), F.lit(0))).alias("n_variants"), F.sum(n("core")).alias("n_core"), F.sum(n("surface")).alias("n_surface"))


def review_payloads(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_variant").select("qa_id", F.lower("language").alias("language")).filter("language IS NOT NULL").distinct()
    return records.review_payloads(q, "qa_id")


def metric_update(spark: SparkSession, d: str) -> DataFrame:
    """One metric of a map replaced, another kept."""
    o = table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("a_exact"), F.lit(-1.0), F.lit("a_rouge"), F.lit(-1.0)).alias("m"), "o_totalprice")
    u = o.withColumn("m", records.set_metric(C("m"), "a_rouge", C("o_totalprice")))
    return u.select("o_orderkey", C("m")["a_exact"].alias("a_exact"), C("m")["a_rouge"].alias("a_rouge"))


def choice_records(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("x"), F.max("l_tax").alias("t"), F.max("l_linenumber").alias("n"))
    s = li.select(
        F.lit("orders").alias("task"), C("l_orderkey").alias("doc_id"), F.concat(F.lit("link"), (C("l_orderkey") % 7).cast("string")).alias("link"), C("n").alias("question_number"), ((C("l_orderkey") % 5) + 1).cast("string").alias("correct_answer_num"),
        F.array(*[F.concat(F.lit("[["), v.cast("string"), F.lit("]]")) for v in (-C("q"), -C("x") * 300, -C("t") * 400, -C("n") * 4.0)]).alias("responses"), F.lit(None).cast("double").alias("acc"), F.lit(None).cast("double").alias("acc_norm"),
    )
    return records.choice_records(s)


QUERIES = {f.__name__: f for f in (leaf_texts, leaf_distinct, leaf_write_back, normalized_variants, document_counts, review_payloads, metric_update, choice_records)}

_LEAVES = """WITH c AS (SELECT DISTINCT card_id, fact_statement, answer, section_title, aliases FROM knowledge_card), l AS (
 SELECT card_id, 'fact_statement' AS path, 'scalar' AS job_type, NULL AS pos, fact_statement AS text FROM c UNION ALL SELECT card_id, 'answer', 'scalar', NULL, answer FROM c UNION ALL SELECT card_id, 'section_title', 'scalar', NULL, section_title FROM c
 UNION ALL SELECT card_id, 'aliases', 'list', CAST(unnest(range(len(aliases))) AS VARCHAR), unnest(aliases) FROM c WHERE len(aliases) > 0), u AS (SELECT DISTINCT * FROM l WHERE trim(coalesce(text, '')) <> '')
"""
ORACLE = {
    "leaf_texts": _LEAVES + "SELECT card_id, path, job_type, CAST(pos AS VARCHAR) AS pos, text FROM u",
    "leaf_distinct": _LEAVES + "SELECT text, (min(ROW(card_id, path)))[1] AS first_card, (min(ROW(card_id, path)))[2] AS first_path FROM u GROUP BY 1",
    "leaf_write_back": "WITH c AS (SELECT card_id, max(answer) AS answer, max(aliases) AS aliases FROM knowledge_card GROUP BY 1) SELECT card_id, CASE WHEN trim(answer) <> '' THEN upper(answer) END AS answer_zh, upper(list_filter(aliases, lambda a: trim(a) <> '')[1]) AS first_alias_zh FROM c",
    "document_counts": "WITH h AS (SELECT DISTINCT holdout_card_id, split_role, qa_variants AS v FROM holdout_card) SELECT split_role, count(*) AS n_cards, CAST(sum(coalesce(len(v), 0)) AS BIGINT) AS n_variants, CAST(sum(coalesce(len(list_filter(v, lambda x: x.variant_layer = 'core')), 0)) AS BIGINT) AS n_core, CAST(sum(coalesce(len(list_filter(v, lambda x: x.variant_layer = 'surface')), 0)) AS BIGINT) AS n_surface FROM h GROUP BY 1",
    "review_payloads": "WITH q AS (SELECT DISTINCT qa_id, lower(language) AS language FROM qa_variant WHERE language IS NOT NULL) SELECT qa_id, language, language || ':' || printf('%03d', row_number() OVER (PARTITION BY language ORDER BY qa_id)) || ':' || qa_id AS review_id FROM q",
    "metric_update": "SELECT o_orderkey, -1.0::DOUBLE AS a_exact, o_totalprice AS a_rouge FROM orders",
    "choice_records": """WITH m AS (SELECT l_orderkey, [-max(l_quantity), -max(l_discount) * 300, -max(l_tax) * 400, -max(l_linenumber) * 4.0::DOUBLE] AS s, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, list_position(s, list_max(s)) AS best, (l_orderkey % 5) + 1 AS gold FROM m)
SELECT 'orders' AS task, l_orderkey AS doc_id, 'link' || (l_orderkey % 7) || '::question_' || n AS item_id, ['A', 'B', 'C', 'D'][gold] AS gold_option, ['A', 'B', 'C', 'D'][best] AS predicted_option, CAST(best = gold AS INT) AS correct,
 CASE WHEN gold > 4 THEN 'invalid correct_answer_num' END AS problem FROM r""",
}


def _variants_sql() -> str:
    """The rules of held-out variants, one step per common table."""
    from polyquarry.plans.texts import _COMPACT, _v1
    from polyquarry.plans.views import mkey, ws

    topic = lambda x: f"({mkey(x)} <> '' AND ({mkey(x)} = {mkey('topic_name')} OR {mkey(x)} = {mkey('source_page')}))"
    return f"""WITH h AS (SELECT DISTINCT holdout_card_id, answer, topic_name, source_page, qa_variants FROM holdout_card),
u AS (SELECT holdout_card_id, answer AS card, topic_name, source_page, unnest(range(len(qa_variants))) AS seq, unnest(qa_variants) AS v FROM h WHERE len(qa_variants) > 0),
f AS (SELECT row_number() OVER () AS rid, *, lower({ws("coalesce(nullif(v.language, ''), 'en')")}) AS lang, lower({ws('v.variant_layer')}) AS layer, {ws('v.question')} AS question, {ws('v.expected_answer')} AS gen, {ws('card')} AS ca FROM u),
g AS (SELECT *, CASE WHEN ca <> '' THEN ca ELSE gen END AS answer, gen AS alias FROM f),
e AS (SELECT *, {_v1()} AS alike FROM g),
a AS (SELECT rid, answer, topic_name, source_page, {ws('x')} AS alias, pos FROM (SELECT rid, answer, topic_name, source_page, unnest(v.answer_aliases) AS x, unnest(range(len(v.answer_aliases))) AS pos FROM e WHERE len(v.answer_aliases) > 0)),
s AS (SELECT rid, alias, min(pos) AS pos FROM a WHERE alias <> '' AND alias <> answer AND NOT {topic('alias')} AND {_v1()} GROUP BY ALL),
l AS (SELECT rid, list(alias ORDER BY pos) AS safe FROM s GROUP BY 1),
k AS (SELECT e.*, CASE WHEN gen <> answer AND alike THEN list_concat([gen], list_filter(coalesce(safe, []), lambda z: z <> gen)) ELSE coalesce(safe, []) END AS aliases FROM e LEFT JOIN l USING (rid)),
t AS (SELECT DISTINCT rid, question, topic_name, source_page, t FROM (SELECT rid, question, topic_name, source_page, unnest(list_concat([answer], aliases)) AS t FROM k)),
w AS (SELECT rid, count(*) AS n FROM t WHERE {_COMPACT} <> '' AND (length({_COMPACT}) >= 3 OR regexp_matches({_COMPACT}, '\\p{{Nd}}')) AND {mkey('question')} <> '' AND contains(' ' || {mkey('question')} || ' ', ' ' || {mkey('t')} || ' ') AND NOT {topic('t')} GROUP BY 1)
SELECT holdout_card_id || '__en__' || CASE WHEN layer = 'core' THEN 'core' ELSE printf('surface_%03d', seq) END AS qa_id, answer AS expected_answer, array_to_string(aliases, '|') AS aliases,
 CASE WHEN lang <> 'en' THEN 'invalid language' WHEN layer NOT IN ('core', 'surface') THEN 'invalid variant_layer' WHEN question = '' THEN 'missing question' WHEN gen = '' THEN 'missing expected_answer' END AS reject_reason,
 CAST(CASE WHEN ca <> '' AND NOT alike THEN 1 ELSE 0 END + CASE WHEN gen <> '' AND gen <> answer AND NOT alike THEN 1 ELSE 0 END + coalesce(n, 0) AS INT) AS n_warnings FROM k LEFT JOIN w USING (rid)"""


ORACLE["normalized_variants"] = _variants_sql()
