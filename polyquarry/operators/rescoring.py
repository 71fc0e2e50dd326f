"""Stored generations scored anew: checked records, one metric, summaries and a protocol of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.functions import metrics, udfs
from polyquarry.operators import access, quality
from polyquarry.operators.records import set_metric
from polyquarry.sources import files

#: Fields a stored record has to have, and the version named in the protocol.
REQUIRED = ["qa_id", "language", "knowledge_pair_id", "topic_role", "variant_layer", "expected_answer", "cleaned_generation"]
VERSION = "saved_generation_absolute_evaluation_v1"
FORMS = {"core": 1, "surface": 3}


def record_problems(records: DataFrame) -> DataFrame:
    """What forbids scoring, as ``qa_id, problem``: blank ids, repeated ids, unknown roles or forms, groups
    of language, knowledge pair and role without one core and three surface forms (``qa_id`` then names the
    group)."""
    blank = records.filter(F.coalesce(F.col("qa_id"), F.lit("")) == "").select("qa_id", F.lit("empty qa_id").alias("problem"))
    again = quality.duplicate_keys(records, "qa_id").select("qa_id", F.lit("repeated qa_id").alias("problem"))
    enums = quality.enum_violations(records, "qa_id", {"topic_role": ["target", "neighbor"], "variant_layer": list(FORMS)})
    wrong = enums.select("qa_id", F.concat(F.lit("invalid "), "column").alias("problem"))
    groups = quality.form_violations(records, access.KEYS, surface=FORMS["surface"])
    forms = groups.select(F.concat_ws("|", *access.KEYS).alias("qa_id"), F.lit("one core and three surface forms expected").alias("problem"))
    return blank.unionByName(again).unionByName(wrong).unionByName(forms)


def scored(records: DataFrame, metric: str) -> DataFrame:
    """Records with ``metrics`` in which the one metric is put anew: a_exact or a_rouge of
    cleaned_generation against expected_answer. Other metrics stay."""
    if metric not in ("a_exact", "a_rouge"):
        raise ValueError(f"no such metric: {metric}")
    value = metrics.exact(F.col("cleaned_generation"), F.col("expected_answer")) if metric == "a_exact" else udfs.rouge_l(F.col("expected_answer"), F.col("cleaned_generation"))
    old = F.col("metrics") if "metrics" in records.columns else F.lit(None).cast("map<string,double>")
    return records.withColumn("metrics", set_metric(old, metric, value))


def summary(rows: DataFrame, metric: str) -> dict[str, DataFrame]:
    """The frames of an accessibility summary: overall and single keys, per form and per role."""
    r = rows.withColumn(metric, F.col("metrics")[metric])
    keys = [k for k in ("dataset_family", "culture_origin", "language", "topic_role", "variant_layer", "pair_id", "relation_type") if k in rows.columns]
    return {
        "groups": access.grouping_summary(r, keys, [metric]), "by_role_language_variant": access.by_layer(r, ["language", "topic_role"], metric),
        "by_role_language": access.by_role_language(r, metric), "by_knowledge": access.by_knowledge(r, metric),
    }


def summary_document(rows: DataFrame, metric: str) -> DataFrame:
    """The summary as one JSON document in one row: overall figures, and entries by key (``value`` of each
    grouping, ``language|role``, ``language|role|form``). It holds groups, not records."""
    s = summary(rows, metric)

    def mapped(df: DataFrame, key, *fields: str) -> DataFrame:
        return df.select(key.alias("k"), F.to_json(F.struct(*fields)).alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))

    g = s["groups"]
    parts = [
        mapped(g, F.concat_ws(":", "grouping", "value"), "n_rows", f"mean_{metric}").select(F.col("m").alias("groups")),
        mapped(s["by_role_language"], F.concat_ws("|", "language", "topic_role"), "n_rows", "access").select(F.col("m").alias("by_role_language")),
        mapped(s["by_role_language_variant"], F.concat_ws("|", "language", "topic_role", "variant_layer"), "n_rows", "value").select(F.col("m").alias("by_role_language_variant")),
    ]
    one = [p.withColumn("__one", F.lit(1)) for p in parts]
    return one[0].join(one[1], "__one").join(one[2], "__one").select(F.lit(metric).alias("metric"), F.to_json(F.struct("groups", "by_role_language", "by_role_language_variant")).alias("document"))


def rescore(spark: SparkSession, path: str, schema: str, out: str, metric: str) -> DataFrame:
    """Score a stored file of generations under ``out``: records, the summary document and a protocol with
    the input's hash. Refuses bad records; returns the scored records as written."""
    records = files.strict_lines(spark, path, schema).drop("file")
    lacking = [c for c in REQUIRED if c not in records.columns]
    if lacking:
        raise ValueError(f"records lack {', '.join(lacking)}")
    found = record_problems(records).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.qa_id}: {r.problem}" for r in found))
    rows = scored(records, metric)
    files.write_lines(rows, f"{out}/generations")
    back = spark.read.schema(rows.schema).json(f"{out}/generations")
    n = back.count()
    if not n:
        raise ValueError("no records")
    summary_document(back, metric).write.mode("overwrite").json(f"{out}/summary")
    protocol = files.file_hashes(spark, path).select(
        F.lit(VERSION).alias("protocol_version"), F.col("path").alias("input"), F.col("sha256").alias("input_sha256"), F.lit(n).alias("record_count"), F.lit(metric).alias("metric"),
        F.lit("cleaned_generation").alias("candidate_field"), F.lit("expected_answer").alias("reference_field"), F.lit(access.WEIGHTS["core"]).alias("core_weight"), F.lit(access.WEIGHTS["surface"]).alias("surface_weight"), F.lit(False).alias("runs_model_generation"),
    )
    protocol.coalesce(1).write.mode("overwrite").json(f"{out}/protocol")
    return back
