"""Queries over scored records: accessibility, matrices, metrics, translations and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.functions import metrics, udfs
from polyquarry.functions import text as tx
from polyquarry.operators import access, matrix, records, translation
from polyquarry.operators.ordering import positional_index
from polyquarry.plans.views import GEN_SQL, ORD_SQL, QA_SQL, generations, qa, rounded, scored_orders
from polyquarry.session import table

C = F.col


# --- accessibility -----------------------------------------------------------------------------------


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).select("cache_id", "item_pos", "attempt_pos", "qa_id", "a_exact").distinct()


def access_by_layer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(access.by_layer(generations(spark, d), access.KEYS, "a_exact"))


def access_by_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(access.by_knowledge(generations(spark, d), "a_exact"))


def access_by_role_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(access.by_role_language(generations(spark, d), "a_exact"))


def access_fixed_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(access.by_role_language(generations(spark, d), "a_exact", renormalize=False))


def access_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    keys = ["dataset_family", "culture_origin", "language", "topic_role", "variant_layer", "pair_id", "relation_type"]
    return rounded(access.grouping_summary(generations(spark, d), keys, ["a_exact"]))


def orders_access(spark: SparkSession, d: str) -> DataFrame:
    return rounded(access.by_knowledge(scored_orders(spark, d), "metric"))


def orders_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(access.grouping_summary(scored_orders(spark, d), ["language", "topic_role", "variant_layer"], ["metric"]))


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d)
    return rounded(access.report(access.by_layer(g, ["language", "topic_role"], "a_exact"), access.by_role_language(g, "a_exact"), matrix.LANGUAGES))


def monitor_scalars(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d)
    return rounded(access.monitor_scalars(access.by_layer(g, ["language", "topic_role"], "a_exact"), access.by_role_language(g, "a_exact"), "exact"))


# --- matrices ----------------------------------------------------------------------------------------
# events as stages: a user's bucket of ten is the source, an event type the target; before and after mid-month


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select((C("user_id") % 5).cast("string").alias("source"), (F.abs(F.crc32(C("event_type").cast("binary"))) % 5).cast("string").alias("target"), (C("user_id") % 20).alias("item"), "value", (F.dayofmonth("ts") <= 15).alias("early"))


def _long(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, d)
    before = e.filter("early").groupBy("item", "target").agg(F.avg("value").alias("value"))
    after = e.filter("NOT early").groupBy("item", "source", "target").agg((F.avg("value") / 2).alias("value"))
    return before, after


def cross_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d)
    return rounded(g.groupBy("relation_type", "language").agg(F.avg("a_exact").alias("score"), F.count(F.lit(1)).alias("n_rows")))


def cross_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    long = generations(spark, d).groupBy("relation_type", "language").agg(F.avg("a_exact").alias("score"))
    return rounded(matrix.wide(long, "relation_type", "language", "score"))


def transfer_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.transfer(*_long(spark, d)))


def damage_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.damage(matrix.retention(*_long(spark, d))))


def globality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.globality(matrix.transfer(*_long(spark, d))))


def asymmetry(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.asymmetry(matrix.transfer(*_long(spark, d))))


def consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.consistency(matrix.transfer(*_long(spark, d))))


def spillover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.spillover(matrix.damage(matrix.retention(*_long(spark, d)))))


def selectivity(spark: SparkSession, d: str) -> DataFrame:
    t, dm = matrix.transfer(*_long(spark, d)), matrix.damage(matrix.retention(*_long(spark, d)))
    return rounded(matrix.selectivity(t, dm, matrix.mixture(dm, t, 0.25), 0.3, 0.2))


def distance_correlation(spark: SparkSession, d: str) -> DataFrame:
    t = matrix.transfer(*_long(spark, d))
    far = t.select("source", "target", F.abs(C("source").cast("int") - C("target").cast("int")).alias("distance"))
    return rounded(matrix.distance_correlation(t, far))


def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    """Under the policy that access shall go in the language of the intervention alone."""
    before, after = _long(spark, d)
    t = matrix.transfer(before, after)
    return rounded(matrix.policy_scores(t, after, t.select("source", "target", (C("source") == C("target")).alias("forget"))))


# --- metrics -----------------------------------------------------------------------------------------


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d).select("cache_id", "item_pos", "attempt_pos", "expected_answer", "generation").distinct()
    return rounded(g.select("cache_id", "item_pos", "attempt_pos", udfs.rouge_l("expected_answer", "generation").alias("rouge_l")))


def nfkc_exact(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that need no judge, as they are equal in NFKC."""
    g = generations(spark, d).select("cache_id", "item_pos", "attempt_pos", "expected_answer", "generation").distinct()
    s = metrics.judge_or_match(C("generation"), C("expected_answer"), udfs.nfkc_ws)
    return g.select("cache_id", "item_pos", "attempt_pos", s.alias("score")).filter("score IS NOT NULL")


def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the first vector of its label."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    head = first.join(e.select(C("vec_id").alias("first_id"), C("embedding").alias("first")), "first_id").select("label", "first_id", "first")
    return rounded(e.join(F.broadcast(head), "label").select("vec_id", "label", "first_id", metrics.cosine(C("embedding"), C("first")).alias("cosine")), 4)


def embedding_audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    norm = F.sqrt(metrics.dot(C("embedding"), C("embedding")))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(F.size("embedding") != 64).alias("n_wrong_size"), F.count_if(norm == 0).alias("n_zero"), F.count_if(F.isnan(norm)).alias("n_nan"))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.round(C("o_totalprice") / 1000).alias("score"), F.when(C("o_orderstatus") == "F", 1).otherwise(0).alias("held"), "o_orderpriority")
    return rounded(metrics.auc(o, "score", "held", "o_orderpriority"))


def attack_means(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(C("o_orderstatus") == "F", 1).otherwise(0).alias("is_holdout"), C("o_orderpriority").alias("attack"), "o_totalprice")
    return rounded(o.groupBy("attack", "is_holdout").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("o_totalprice").alias("mean_score")), 2)


def _per_user(spark: SparkSession, d: str) -> DataFrame:
    """Bounded lists: the values of a user's first hundred events as token log probabilities."""
    from polyquarry.operators.ordering import top_per

    e = top_per(table(spark, d, "events").select("user_id", "event_id", (-C("value")).alias("lp")), ["user_id"], 100, C("event_id"))
    return e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "lp"))), lambda x: x["lp"]).alias("lps"))


def min_k(spark: SparkSession, d: str) -> DataFrame:
    u = _per_user(spark, d)
    flat = F.transform("lps", lambda x: F.lit(-10.0))
    return rounded(u.select("user_id", metrics.min_k(C("lps")).alias("min_k"), metrics.mean_loss(C("lps")).alias("loss"), metrics.min_k_plus(C("lps"), flat, F.transform("lps", lambda x: F.lit(4.0))).alias("min_k_plus")))


def dv_logmeanexp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.log_mean_exp(table(spark, d, "events").select("event_type", "value"), "value", 2.0, "event_type"))


def preference_losses(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    npo = metrics.npo(C("l_discount") * 10, C("l_tax") * 10, 0.5)
    simnpo = metrics.simnpo(C("l_discount") * 10, C("l_quantity"), 2.0, 0.1)
    return rounded(li.groupBy("l_returnflag").agg(F.avg(npo).alias("npo"), F.avg(simnpo).alias("simnpo")))


def choice_argmax(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")])
    scores = F.array(C("l_quantity") / 100, C("l_discount") * 4, C("l_tax") * 5, C("l_linenumber") / 14.0)
    return li.select("l_suppkey", metrics.choice(scores).alias("choice"))


def macro_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean of task means over the five priorities of orders as tasks, and over these and one that isn't
    there, which gives no row: a task that lacks leaves nothing to average."""
    o = table(spark, d, "orders").select(C("o_orderpriority").alias("task"), F.when(C("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("acc"))
    tasks = sorted(r[0] for r in o.select("task").distinct().collect())
    whole = records.macro_over_tasks(o, tasks).withColumn("of", F.lit("present"))
    return rounded(whole.unionByName(records.macro_over_tasks(o, [*tasks, "absent"]).withColumn("of", F.lit("absent"))))


def qa_index(spark: SparkSession, d: str) -> DataFrame:
    return positional_index(qa(spark, d).select("qa_id").distinct(), "qa_id")


# --- translations ------------------------------------------------------------------------------------


def translation_join_diag(spark: SparkSession, d: str) -> DataFrame:
    from polyquarry.operators import nested

    t = nested.levels(table(spark, d, "attempt_cache"), "target_language").filter("item_pos >= 0 AND attempt_pos <= 0")
    t = t.select(C("item.source_qa_id").alias("source_qa_id"), C("target_language").alias("language"), (C("cache_id") * 1000 + C("item_pos")).alias("pos")).distinct()
    return translation.diagnose(table(spark, d, "qa_variant"), t, "de").groupBy("finding").agg(F.count(F.lit(1)).alias("n_findings"))


def misaligned_pairs(spark: SparkSession, d: str) -> DataFrame:
    q = qa(spark, d)
    other = q.withColumn("source_qa_id", C("qa_id")).withColumn("topic_role", F.when(C("topic_role") == "target", "target").otherwise("other"))
    return translation.misaligned(q.drop("answer_aliases"), other.drop("answer_aliases")).select("source_qa_id", F.array_join("differs", ",").alias("differs")).distinct()


def attempt_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return translation.attempt_outcomes(table(spark, d, "attempt_cache"))


def repair_attempt_count(spark: SparkSession, d: str) -> DataFrame:
    return translation.repair_counts(table(spark, d, "attempt_cache"))


def latest_translations(spark: SparkSession, d: str) -> DataFrame:
    return translation.latest_translation(table(spark, d, "attempt_cache"))


def alias_failures(spark: SparkSession, d: str) -> DataFrame:
    return translation.alias_failures(table(spark, d, "attempt_cache"))


def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "attempt_cache").select("cache_id", "prompt_version").distinct()
    return translation.most_common(rows, "prompt_version", "cache_id")


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    from polyquarry.operators import nested

    done = nested.levels(table(spark, d, "attempt_cache"), "prompt_version").select(C("item.source_qa_id").alias("qa_id"), "prompt_version")
    wanted = qa(spark, d).select("qa_id").distinct().withColumn("prompt_version", F.lit("step6_direct_translation_v5"))
    return translation.cache_misses(wanted, done, "qa_id", "prompt_version")


def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Reviews made of attempts: a verdict as the pass, lengths as scores (0 where the text is missing)."""
    from polyquarry.operators import nested

    a = nested.attempts(table(spark, d, "attempt_cache"), "target_language").distinct()
    t, k = C("attempt.translation"), C("attempt.consistency")
    score = lambda c: F.coalesce(F.length(c) % 6, F.lit(0)).cast("string")
    raw = a.select(
        F.concat_ws(":", F.lower(F.trim("target_language")), "cache_id", "item_pos", "attempt_pos").alias("id"), k["verdict"].alias("overall_pass"), F.lit("unsure").alias("severity"), k["failure_type"].alias("issue_type"),
        score(t["question"]).alias("faithfulness_score"), score(t["expected_answer"]).alias("answer_accuracy_score"), F.lit("n/a").alias("fluency_score"), score(k["reason"]).alias("language_purity_score"),
    ).distinct()
    return rounded(translation.review_summary(translation.normalized_reviews(raw), "severity", "issue_type"))


_NAMES = [exact_match, access_by_layer, access_by_knowledge, access_by_role_lang, access_fixed_weights, access_grouping_sets, orders_access, orders_grouping_sets, report_rows, monitor_scalars, cross_matrix_long, cross_matrix_wide, transfer_matrix, damage_matrix, globality, asymmetry, consistency, spillover, selectivity, distance_correlation, policy_scores, rouge_l, nfkc_exact, cosine_similarity, embedding_audit, roc_auc, attack_means, min_k, dv_logmeanexp, preference_losses, choice_argmax, macro_average, qa_index, translation_join_diag, misaligned_pairs, attempt_outcomes, repair_attempt_count, latest_translations, alias_failures, failure_counts, cache_misses, review_summary]
QUERIES = {f.__name__: f for f in _NAMES}


def _weights(rows: str, keys: str, metric: str, scale: bool = True) -> str:
    w = "CASE variant_layer WHEN 'core' THEN 0.25::DOUBLE WHEN 'surface' THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END"
    total = f"sum({w}) OVER (PARTITION BY {keys})"
    use = f"CASE WHEN {total} > 0 THEN {w} / {total} ELSE 1.0 / count(*) OVER (PARTITION BY {keys}) END" if scale else w
    ks = ", ".join(f"coalesce({k.strip()}, '') AS {k.strip()}" if k.strip() != "knowledge_pair_id" else "coalesce(CAST(knowledge_pair_id AS VARCHAR), '') AS knowledge_pair_id" for k in keys.split(","))
    return f"""lay AS (SELECT {ks}, coalesce(variant_layer, '') AS variant_layer, count(*) AS n_rows, avg({metric}) AS value FROM {rows} GROUP BY ALL),
wt AS (SELECT *, {use} AS w FROM lay), acc AS (SELECT {keys}, CAST(sum(n_rows) AS BIGINT) AS n_rows, round(sum(w * value), 6) AS access FROM wt GROUP BY ALL)"""


_K3, _K2 = "language, knowledge_pair_id, topic_role", "language, topic_role"


def _sets(rows: str, keys: list[str], metric: str) -> str:
    parts = [f"SELECT '{k}' AS \"grouping\", coalesce({k}, '') AS value, count(*) AS n_rows, round(avg({metric}), 6) AS mean_{metric} FROM {rows} GROUP BY ALL" for k in keys]
    return " UNION ALL ".join([*parts, f"SELECT 'overall', '', count(*), round(avg({metric}), 6) FROM {rows}"])


_LANGS = ", ".join(f"('{l}', {i})" for i, l in enumerate(matrix.LANGUAGES))
_EV = """
WITH e AS (SELECT CAST(user_id % 5 AS VARCHAR) AS source, %s AS target, user_id %% 20 AS item, value, day(ts) <= 15 AS early FROM events),
b AS (SELECT item, target, avg(value) AS v FROM e WHERE early GROUP BY ALL), a AS (SELECT item, source, target, avg(value) / 2 AS v FROM e WHERE NOT early GROUP BY ALL),
tr AS (SELECT source, a.target AS target, avg((b.v - a.v) / greatest(b.v, 1e-6)) AS value, avg(a.v / greatest(b.v, 1e-6)) AS kept FROM a JOIN b ON a.item = b.item AND a.target = b.target GROUP BY ALL),
dm AS (SELECT source, target, 1.0 - kept AS value FROM tr)
""".replace("user_id % 5", "user_id %% 5")


def _ev() -> str:
    import zlib

    kinds = "click view purchase error signup login logout search scroll refund add_to_cart page_view other".split()
    return _EV % ("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{zlib.crc32(k.encode()) % 5}'" for k in kinds) + " END")


_E = _ev()
_ATT = """
WITH fl AS (SELECT DISTINCT cache_id, target_language, prompt_version, attempt_history AS h FROM attempt_cache),
it AS (SELECT cache_id, target_language, prompt_version, CAST(unnest(range(len(h))) AS INT) AS item_pos, unnest(h) AS it FROM fl WHERE len(h) > 0),
att AS (SELECT cache_id, target_language, item_pos, it.source_qa_id AS source_qa_id, CAST(unnest(range(len(it.attempts))) AS INT) AS attempt_pos, unnest(it.attempts) AS a FROM it WHERE len(it.attempts) > 0),
oc AS (SELECT cache_id, item_pos, it.source_qa_id AS source_qa_id, CAST(greatest(coalesce(len(it.attempts), 0), 0) AS INT) AS n_attempts, coalesce(lower(it.attempts[-1].consistency.verdict) = 'passed', false) AS accepted, it.attempts[-1].consistency.failure_type AS last_failure FROM it)
"""
_NPO = "-2.0 / 0.5 * (least(0.5 * (l_discount * 10 - l_tax * 10), 0.0) - ln(1 + exp(-abs(0.5 * (l_discount * 10 - l_tax * 10)))))"
_SIM = "-2.0 / 2.0 * (least(2.0 * (l_discount * 10 / greatest(l_quantity, 1) - 0.1), 0.0) - ln(1 + exp(-abs(2.0 * (l_discount * 10 / greatest(l_quantity, 1) - 0.1)))))"

ORACLE = {
    "exact_match": GEN_SQL + "SELECT DISTINCT cache_id, CAST(item_pos AS INT) AS item_pos, CAST(attempt_pos AS INT) AS attempt_pos, qa_id, a_exact FROM gen",
    "access_by_layer": GEN_SQL + "SELECT coalesce(language, '') AS language, coalesce(knowledge_pair_id, '') AS knowledge_pair_id, coalesce(topic_role, '') AS topic_role, coalesce(variant_layer, '') AS variant_layer, count(*) AS n_rows, round(avg(a_exact), 6) AS value FROM gen GROUP BY ALL",
    "access_by_knowledge": GEN_SQL + "," + _weights("gen", _K3, "a_exact") + " SELECT * FROM acc",
    "access_by_role_lang": GEN_SQL + "," + _weights("gen", _K2, "a_exact") + " SELECT * FROM acc",
    "access_fixed_weights": GEN_SQL + "," + _weights("gen", _K2, "a_exact", False) + " SELECT * FROM acc",
    "access_grouping_sets": GEN_SQL + _sets("gen", ["dataset_family", "culture_origin", "language", "topic_role", "variant_layer", "pair_id", "relation_type"], "a_exact"),
    "orders_access": ORD_SQL + "," + _weights("q", _K3, "metric") + " SELECT * FROM acc",
    "orders_grouping_sets": ORD_SQL + _sets("q", ["language", "topic_role", "variant_layer"], "metric"),
    "report_rows": GEN_SQL + "," + _weights("gen", _K2, "a_exact") + f""", dims AS (SELECT l AS language, r AS topic_role, CAST(i * 2 + j AS INT) AS "row" FROM (VALUES {_LANGS}) a(l, i), (VALUES ('target', 0), ('neighbor', 1)) b(r, j))
SELECT d."row" AS "row", d.language AS language, d.topic_role AS topic_role, round(c.value, 6) AS core, round(s.value, 6) AS surface, acc.access AS access FROM dims d LEFT JOIN lay c ON c.language = d.language AND c.topic_role = d.topic_role AND c.variant_layer = 'core'
 LEFT JOIN lay s ON s.language = d.language AND s.topic_role = d.topic_role AND s.variant_layer = 'surface' LEFT JOIN acc ON acc.language = d.language AND acc.topic_role = d.topic_role""",
    "monitor_scalars": GEN_SQL + "," + _weights("gen", _K2, "a_exact") + " SELECT 'A_current_v_exact/' || topic_role || '/' || language || '/' || variant_layer AS name, round(value, 6) AS value FROM lay UNION ALL SELECT 'A_current_exact/' || topic_role || '/' || language, access FROM acc",
    "cross_matrix_long": GEN_SQL + "SELECT relation_type, language, round(avg(a_exact), 6) AS score, count(*) AS n_rows FROM gen GROUP BY ALL",
    "cross_matrix_wide": GEN_SQL + "SELECT relation_type, " + ", ".join(f"round(avg(a_exact) FILTER (language = '{l}'), 6) AS {l}" for l in matrix.LANGUAGES) + " FROM gen GROUP BY 1",
    "transfer_matrix": _E + "SELECT source, target, round(value, 6) AS value FROM tr",
    "damage_matrix": _E + "SELECT source, target, round(value, 6) AS value FROM dm",
    "globality": _E + "SELECT round(g, 6) AS globality, round(1 - g, 6) AS locality FROM (SELECT avg(value) FILTER (source <> target) / (avg(value) FILTER (source = target) + 1e-6) AS g FROM tr)",
    "asymmetry": _E + "SELECT round(avg(abs(a.value - b.value)), 6) AS asymmetry FROM tr a JOIN tr b ON a.source = b.target AND a.target = b.source AND a.source <> a.target",
    "consistency": _E + "SELECT round(1 - avg(d), 6) AS consistency FROM (SELECT source, stddev_pop(value) AS d FROM tr WHERE source <> target GROUP BY 1)",
    "spillover": _E + "SELECT round(avg(value), 6) AS overall, round(avg(value) FILTER (source <> target), 6) AS spillover FROM dm",
    "selectivity": _E + "SELECT source, target, round(tr.value - 0.3 * dm.value - 0.2 * (0.25 * dm.value + 0.75 * tr.value), 6) AS value FROM tr JOIN dm USING (source, target)",
    "distance_correlation": _E + "SELECT round(corr(abs(CAST(source AS INT) - CAST(target AS INT)), value), 6) AS rho FROM tr WHERE source <> target",
    "policy_scores": _E
    + """, lf AS (SELECT source, target, avg(v) AS l FROM a GROUP BY ALL) SELECT round(avg(value) FILTER (source = target), 6) AS forget_compliance, round(avg(l) FILTER (source = target), 6) AS residual_access, round(1 - avg(value) FILTER (source <> target), 6) AS containment,
 round(avg(value) FILTER (source <> target), 6) AS spillover, round(avg(CASE WHEN (value >= 0.5) = (source = target) THEN 1.0 ELSE 0.0 END), 6) AS localized FROM tr LEFT JOIN lf USING (source, target)""",
    "cosine_similarity": """WITH f AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY 1) SELECT e.vec_id AS vec_id, e.label AS label, f.first_id AS first_id,
 round(greatest(-1.0, least(1.0, list_cosine_similarity(e.embedding::DOUBLE[], h.embedding::DOUBLE[]))), 4) AS cosine FROM embeddings e JOIN f ON e.label = f.label JOIN embeddings h ON h.vec_id = f.first_id""",
    "embedding_audit": "SELECT label, count(*) AS n_vectors, count(*) FILTER (len(embedding) <> 64) AS n_wrong_size, count(*) FILTER (list_sum(list_transform(embedding, lambda x: x * x)) = 0) AS n_zero, count(*) FILTER (isnan(list_sum(embedding))) AS n_nan FROM embeddings GROUP BY 1",
    "roc_auc": """WITH o AS (SELECT round(o_totalprice / 1000) AS s, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS h, o_orderpriority FROM orders),
r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY s) + (count(*) OVER (PARTITION BY o_orderpriority, s) - 1) / 2.0 AS mr FROM o)
SELECT o_orderpriority, count(*) FILTER (h = 0) AS n_negative, count(*) FILTER (h = 1) AS n_positive, round((sum(mr) FILTER (h = 1) - count(*) FILTER (h = 1) * (count(*) FILTER (h = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER (h = 0) * count(*) FILTER (h = 1)), 6) AS auc FROM r GROUP BY 1""",
    "attack_means": "SELECT o_orderpriority AS attack, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS is_holdout, count(*) AS n_rows, round(avg(o_totalprice), 2) AS mean_score FROM orders GROUP BY ALL",
    "min_k": """WITH k AS (SELECT user_id, -value AS lp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), u AS (SELECT user_id, lp, row_number() OVER (PARTITION BY user_id ORDER BY lp) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM k WHERE n <= 100)
SELECT user_id, round(-avg(lp) FILTER (r <= greatest(1, floor(c * 0.4))), 6) AS min_k, round(-avg(lp), 6) AS loss, round(-avg((lp + 10.0) / 2.0) FILTER (r <= greatest(1, floor(c * 0.4))), 6) AS min_k_plus FROM u GROUP BY 1""",
    "dv_logmeanexp": "WITH m AS (SELECT event_type, min(value) AS l FROM events GROUP BY 1) SELECT e.event_type AS event_type, round(any_value(l) - 2.0 * ln(avg(exp(-(value - l) / 2.0))), 6) AS value FROM events e JOIN m USING (event_type) GROUP BY 1",
    "preference_losses": f"SELECT l_returnflag, round(avg({_NPO}), 6) AS npo, round(avg({_SIM}), 6) AS simnpo FROM lineitem GROUP BY 1",
    "choice_argmax": "WITH m AS (SELECT l_suppkey, [max(l_quantity) / 100, max(l_discount) * 4, max(l_tax) * 5, max(l_linenumber) / 14.0::DOUBLE] AS s FROM lineitem GROUP BY 1) SELECT l_suppkey, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS choice FROM m",
    "macro_average": "WITH t AS (SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS a FROM orders GROUP BY 1) SELECT count(*) AS n_tasks, round(avg(a), 6) AS macro_acc, 'present' AS of FROM t",
    "qa_index": "SELECT qa_id, row_number() OVER (ORDER BY qa_id) - 1 AS index FROM (SELECT DISTINCT qa_id FROM qa_variant)",
    "translation_join_diag": _ATT
    + """, t AS (SELECT DISTINCT trim(it.source_qa_id) AS s, lower(trim(coalesce(target_language, ''))) AS l, cache_id * 1000 + item_pos AS pos FROM it), q AS (SELECT DISTINCT qa_id FROM qa_variant WHERE qa_id IS NOT NULL),
k AS (SELECT t.* FROM t WHERE s IN (SELECT qa_id FROM q)), f AS (SELECT s, min(pos) AS p FROM k WHERE l = 'de' GROUP BY 1)
SELECT 'unknown_source' AS finding, count(*) AS n_findings FROM t WHERE coalesce(s, '') NOT IN (SELECT qa_id FROM q) HAVING count(*) > 0 UNION ALL SELECT 'mismatched_language', count(*) FROM k WHERE l <> 'de' HAVING count(*) > 0
UNION ALL SELECT 'duplicate', count(*) FROM k JOIN f USING (s) WHERE l = 'de' AND pos > p HAVING count(*) > 0 UNION ALL SELECT 'missing', count(*) FROM q WHERE qa_id NOT IN (SELECT s FROM f) HAVING count(*) > 0""",
    "misaligned_pairs": f"SELECT DISTINCT qa_id AS source_qa_id, 'topic_role' AS differs FROM ({QA_SQL}) WHERE topic_role <> 'target' OR topic_role IS NULL",
    "attempt_outcomes": _ATT + "SELECT * FROM oc",
    "repair_attempt_count": _ATT + "SELECT count(*) AS n_items, CAST(sum(n_attempts) AS BIGINT) AS n_attempts, CAST(sum(greatest(n_attempts - 1, 0)) AS BIGINT) AS n_repairs, count(*) FILTER (NOT accepted) AS n_failed FROM oc",
    "latest_translations": _ATT + ", r AS (SELECT *, row_number() OVER (PARTITION BY cache_id, item_pos ORDER BY attempt_pos DESC) AS n FROM att) SELECT cache_id, item_pos, source_qa_id, a.translation.question AS question, a.translation.expected_answer AS expected_answer FROM r WHERE n = 1",
    "alias_failures": _ATT + "SELECT DISTINCT cache_id, item_pos, attempt_pos, a.consistency.failure_type AS failure_type FROM att WHERE contains(lower(a.consistency.failure_type), 'alias')",
    "failure_counts": "SELECT prompt_version AS value, count(*) AS n_rows, min(cache_id) AS first_at FROM (SELECT DISTINCT cache_id, prompt_version FROM attempt_cache) GROUP BY 1",
    "cache_misses": _ATT + "SELECT DISTINCT qa_id, 'step6_direct_translation_v5' AS prompt_version FROM qa_variant WHERE qa_id NOT IN (SELECT it.source_qa_id FROM it WHERE prompt_version = 'step6_direct_translation_v5' AND it.source_qa_id IS NOT NULL)",
    "review_summary": _ATT
    + """, raw AS (SELECT DISTINCT concat_ws(':', lower(trim(target_language)), cache_id, item_pos, attempt_pos) AS id, coalesce(lower(a.consistency.verdict) = 'passed', false) AS p, coalesce(nullif(lower(trim(a.consistency.failure_type)), ''), 'none') AS issue_type,
 coalesce(length(a.translation.question) % 6, 0) AS f, coalesce(length(a.translation.expected_answer) % 6, 0) AS c, coalesce(length(a.consistency.reason) % 6, 0) AS u FROM att)
SELECT CASE WHEN p THEN 'minor' ELSE 'major' END AS severity, issue_type, count(*) AS sample_size, count(*) FILTER (p) AS pass_count, round(count(*) FILTER (p) / count(*), 6) AS pass_rate, round(coalesce(avg(f) FILTER (f > 0), 0), 6) AS avg_faithfulness_score,
 round(coalesce(avg(c) FILTER (c > 0), 0), 6) AS avg_answer_accuracy_score, 0.0::DOUBLE AS avg_fluency_score, round(coalesce(avg(u) FILTER (u > 0), 0), 6) AS avg_language_purity_score FROM raw GROUP BY ALL""",
}
