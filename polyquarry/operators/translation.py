"""Translations against their sources: alignment, diagnostics, attempts, repairs and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.functions import text as tx
from polyquarry.operators import nested
from polyquarry.operators.ordering import first_per

#: Fields in which an aligned translation has to equal its source.
ALIGNED = ["knowledge_pair_id", "pair_id", "topic_role", "variant_layer", "dataset_family", "culture_origin"]
SCORES = ["faithfulness_score", "answer_accuracy_score", "fluency_score", "language_purity_score"]


def diagnose(sources: DataFrame, translations: DataFrame, language: str) -> DataFrame:
    """One row per finding. ``sources``: qa_id; ``translations``: source_qa_id, language, pos (order).

    unknown_source: no such source; mismatched_language: another language; duplicate: a further
    translation of a source; missing: a source without any accepted one.
    """
    s = sources.select("qa_id").filter("qa_id IS NOT NULL").distinct()
    t = translations.select(tx.normalize_ws(F.col("source_qa_id")).alias("source_qa_id"), F.lower(tx.normalize_ws(F.col("language"))).alias("language"), "pos")
    known = t.join(s, t["source_qa_id"] == s["qa_id"], "left_semi")
    unknown = t.join(s, t["source_qa_id"] == s["qa_id"], "left_anti").select("source_qa_id", "pos", F.lit("unknown_source").alias("finding"))
    wrong = known.filter(F.col("language") != language).select("source_qa_id", "pos", F.lit("mismatched_language").alias("finding"))
    right = known.filter(F.col("language") == language)
    first = right.groupBy("source_qa_id").agg(F.min("pos").alias("first"))
    again = right.join(first, "source_qa_id").filter(F.col("pos") > F.col("first")).select("source_qa_id", "pos", F.lit("duplicate").alias("finding"))
    missing = s.join(first, s["qa_id"] == first["source_qa_id"], "left_anti").select(F.col("qa_id").alias("source_qa_id"), F.lit(None).cast(t.schema["pos"].dataType).alias("pos"), F.lit("missing").alias("finding"))
    return unknown.unionByName(wrong).unionByName(again).unionByName(missing)


def misaligned(english: DataFrame, translated: DataFrame) -> DataFrame:
    """Aligned pairs (translated.source_qa_id = english.qa_id) that differ in any of the fields, with the
    fields' names."""
    e = english.select(F.col("qa_id").alias("source_qa_id"), *[F.col(c).alias(f"e_{c}") for c in ALIGNED])
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"e_{c}")), F.lit(c)) for c in ALIGNED]))
    return translated.join(e, "source_qa_id").select("source_qa_id", "qa_id", differ.alias("differs")).filter(F.size("differs") > 0)


def attempt_outcomes(cache: DataFrame) -> DataFrame:
    """One row per item: attempts made, whether the last one passed, its failure type. Items without
    attempts count none and have not passed."""
    a = F.col("item.attempts")
    last = F.when(F.size(a) > 0, F.element_at(a, -1))
    return nested.once(cache, lambda c: c.select("cache_id", F.posexplode("attempt_history").alias("item_pos", "item")).select(
        "cache_id", "item_pos", F.col("item.source_qa_id").alias("source_qa_id"), F.greatest(F.size(a), F.lit(0)).alias("n_attempts"),
        F.coalesce(F.lower(last["consistency"]["verdict"]) == "passed", F.lit(False)).alias("accepted"), last["consistency"]["failure_type"].alias("last_failure"),
    ), ["cache_id", "item_pos"])


def repair_counts(cache: DataFrame) -> DataFrame:
    """Items, attempts, repairs (attempts beyond the first) and failed items in one row."""
    o = attempt_outcomes(cache)
    return o.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("n_attempts"), F.lit(0)).alias("n_attempts"), F.coalesce(F.sum(F.greatest(F.col("n_attempts") - 1, F.lit(0))), F.lit(0)).alias("n_repairs"), F.count_if(~F.col("accepted")).alias("n_failed"))


def latest_translation(cache: DataFrame) -> DataFrame:
    """The last attempt's translation of each item."""
    rows = nested.attempts(cache).withColumn("source_qa_id", F.col("item.source_qa_id"))
    last = first_per(rows.select("cache_id", "item_pos", "attempt_pos", "source_qa_id", F.col("attempt.translation").alias("t")), ["cache_id", "item_pos"], F.desc("attempt_pos"))
    return last.select("cache_id", "item_pos", "source_qa_id", F.col("t.question").alias("question"), F.col("t.expected_answer").alias("expected_answer"))


def alias_failures(cache: DataFrame) -> DataFrame:
    """Attempts whose failure type speaks of aliases."""
    hit = F.contains(F.lower(F.col("attempt.consistency.failure_type")), F.lit("alias"))
    return nested.attempts(cache).filter(hit).select("cache_id", "item_pos", "attempt_pos", F.col("attempt.consistency.failure_type").alias("failure_type")).distinct()


def cache_misses(inputs: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    """Inputs that the cache lacks under the same keys (id and version)."""
    return inputs.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def most_common(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Values with their count, most frequent first, ties by first occurrence in ``order``."""
    g = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first_at"))
    return g.orderBy(F.desc("n_rows"), "first_at")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(tx.strip(c.cast("string"))).isin("true", "yes", "pass", "passed", "ok"), F.lit(False))


def normalized_reviews(raw: DataFrame) -> DataFrame:
    """Reviews with known severities (an unknown one is minor where passed, else major), issue types
    (blank is none) and whole-number scores (anything else is 0)."""
    severity, issue = F.lower(tx.strip(F.col("severity"))), F.lower(tx.strip(F.col("issue_type")))
    severity = F.when(severity == "", F.lit("ok")).when(severity.isin("ok", "minor", "major"), severity).when(truthy(F.col("overall_pass")), F.lit("minor")).otherwise(F.lit("major"))
    return raw.select("id", truthy(F.col("overall_pass")).alias("overall_pass"), severity.alias("severity"), F.when(issue == "", F.lit("none")).otherwise(issue).alias("issue_type"), *[F.coalesce(F.col(s).try_cast("int"), F.lit(0)).alias(s) for s in SCORES])


def review_summary(reviews: DataFrame, *group: str) -> DataFrame:
    """Sample size, passes, pass rate and mean scores that leave out scores of zero or less (0 where no
    score is left). Unrounded; round at the sink."""
    mean = lambda s: F.coalesce(F.avg(F.when(F.col(s) > 0, F.col(s))), F.lit(0.0)).alias(f"avg_{s}")
    return reviews.groupBy(*group).agg(F.count(F.lit(1)).alias("sample_size"), F.count_if(F.col("overall_pass")).alias("pass_count"), (F.count_if(F.col("overall_pass")) / F.count(F.lit(1))).alias("pass_rate"), *[mean(s) for s in SCORES])


def id_sets_differ(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that stand on one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def merge_repaired(document: DataFrame, repaired: DataFrame, key: str, order: DataFrame) -> DataFrame:
    """Document rows with repaired rows put in where absent, with the source's ``pos``; rows unknown to
    ``order`` (key, pos) come last (pos 10^9)."""
    both = document.unionByName(repaired.join(document.select(key), key, "left_anti").select(*document.columns))
    return both.join(order.select(key, "pos"), key, "left").withColumn("pos", F.coalesce("pos", F.lit(1_000_000_000)))
