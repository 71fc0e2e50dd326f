"""Cross-language results as checked CSV: the long table and the source-by-language matrix.

``summaries`` holds one row per checkpoint, evaluation language and role: checkpoint_id, source_language,
evaluation_language, topic_role, core, surface, weighted, n_core, n_surface, core_weight, surface_weight,
families and origins (the sets of values that its records have).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.operators import matrix
from polyquarry.operators.access import WEIGHTS
from polyquarry.sources import files

#: How far stored figures may lie from computed ones, and surface forms per core form.
TOLERANCE, SURFACE_FORMS = 1e-12, 3
#: Columns of the long table, in order.
LONG = ["experiment", "dataset", "method", "checkpoint_id", "source_language", "evaluation_language", "topic_role", "metric", "variant", "score", "summary_path"]


def summarised(rows: DataFrame, metric: str, checkpoint: str, source: str) -> DataFrame:
    """Records (language, topic_role, variant_layer, dataset_family, culture_origin and the metric) as
    summaries per ``checkpoint`` and ``source``, weighted as ``access`` weights them."""
    mean = lambda k: F.avg(F.when(F.col("variant_layer") == k, F.col(metric)))
    g = rows.groupBy(F.col(checkpoint).alias("checkpoint_id"), F.col(source).alias("source_language"), F.col("language").alias("evaluation_language"), "topic_role").agg(
        mean("core").alias("core"), mean("surface").alias("surface"), F.count_if(F.col("variant_layer") == "core").alias("n_core"), F.count_if(F.col("variant_layer") == "surface").alias("n_surface"),
        F.collect_set(F.coalesce("dataset_family", F.lit(""))).alias("families"), F.collect_set(F.coalesce("culture_origin", F.lit(""))).alias("origins"),
    )
    return g.withColumn("weighted", WEIGHTS["core"] * F.col("core") + WEIGHTS["surface"] * F.col("surface")).withColumn("core_weight", F.lit(WEIGHTS["core"])).withColumn("surface_weight", F.lit(WEIGHTS["surface"]))


def problems(summaries: DataFrame, dataset: str, role: str, languages: list[str] | None = None, source_only: bool = False) -> DataFrame:
    """One row per finding: checkpoint_id, evaluation_language, problem. Checked are the dataset's families
    (and origins of culture data), the weights, the form counts, that figures are finite, the weighted sum
    within ``TOLERANCE``, and that every language of the scope has a row."""
    s = summaries.filter(F.col("topic_role") == role)
    far = lambda a, b: F.coalesce(F.abs(a - b) > TOLERANCE, F.lit(True)) | F.isnan(F.coalesce(a, F.lit(0.0)))
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    allowed = ["", "common"] if dataset == "common" else ["culture_specific"]
    checks = {
        "dataset_family": (F.size("families") == 0) | (F.size(F.array_except("families", F.array(*map(F.lit, allowed)))) > 0),
        "culture_origin": F.lit(dataset != "common") & (F.col("origins") != F.array("source_language")),
        "weights": far(F.col("core_weight"), F.lit(WEIGHTS["core"])) | far(F.col("surface_weight"), F.lit(WEIGHTS["surface"])),
        "form_counts": F.coalesce((F.col("n_core") <= 0) | (F.col("n_surface") != SURFACE_FORMS * F.col("n_core")), F.lit(True)),
        "not_finite": odd("core") | odd("surface") | odd("weighted"),
        "weighted_sum": far(F.col("weighted"), WEIGHTS["core"] * F.col("core") + WEIGHTS["surface"] * F.col("surface")),
    }
    found = s.select("checkpoint_id", "evaluation_language", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("problem"))
    wanted = F.array("source_language") if source_only else F.array(*map(F.lit, languages or matrix.LANGUAGES))
    per = s.groupBy("checkpoint_id", "source_language").agg(F.collect_set("evaluation_language").alias("have"))
    lacking = per.select("checkpoint_id", F.explode(F.array_except(wanted, "have")).alias("evaluation_language"), F.lit("missing_language").alias("problem"))
    return found.unionByName(lacking)


def long_rows(summaries: DataFrame, metric: str, role: str, variant: str = "weighted", source_only: bool = False, languages: list[str] | None = None, **told: str) -> DataFrame:
    """The long table: one row per checkpoint and evaluation language. ``variant``: weighted, core or
    surface; ``told``: experiment, dataset, method and summary_path as they stand in every row."""
    if variant not in ("weighted", "core", "surface"):
        raise ValueError(f"no such variant: {variant}")
    s = summaries.filter(F.col("topic_role") == role)
    s = s.filter(F.col("evaluation_language") == F.col("source_language")) if source_only else s.filter(F.col("evaluation_language").isin(languages or matrix.LANGUAGES))
    fixed = {"metric": metric, "variant": variant, "experiment": "", "dataset": "", "method": "", "summary_path": ""} | told
    return s.select(*[F.col(variant).alias(c) if c == "score" else F.lit(fixed[c]).alias(c) if c in fixed else F.col(c) for c in LONG])


def matrix_rows(long: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """One row per checkpoint with a column per language in the published order; missing cells are null."""
    names = languages or matrix.LANGUAGES
    return long.groupBy("checkpoint_id", "source_language").pivot("evaluation_language", names).agg(F.first("score"))


def export(summaries: DataFrame, path: str, metric: str, role: str, dataset: str, **options) -> DataFrame:
    """Write the long table under ``path``/long and the matrix under ``path``/matrix as CSV. Refuses where
    ``problems`` finds anything; returns the long table as written."""
    scope = {k: options[k] for k in ("source_only", "languages") if k in options}
    found = problems(summaries, dataset, role, scope.get("languages"), scope.get("source_only", False)).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.checkpoint_id}: {r.problem} ({r.evaluation_language})" for r in found))
    long = long_rows(summaries, metric, role, dataset=dataset, **options)
    files.write_table(long, f"{path}/long")
    files.write_table(matrix_rows(long, scope.get("languages")), f"{path}/matrix")
    return long
