"""Weighted accessibility of knowledge over forms, roles and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the question forms.
WEIGHTS = {"core": 0.25, "surface": 0.75}
KEYS = ["language", "knowledge_pair_id", "topic_role"]


def group_value(c: Column) -> Column:
    """Null as the empty text: both fall into one group."""
    return F.coalesce(c.cast("string"), F.lit(""))


def by_layer(rows: DataFrame, keys: list[str], metric: str, layer: str = "variant_layer") -> DataFrame:
    """Count and mean of the metric per keys and form; nulls don't count for the mean."""
    cols = [*keys, layer]
    return rows.groupBy(*[group_value(F.col(c)).alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(metric).alias("value"))


def weighted(layers: DataFrame, keys: list[str], weights: dict[str, float] | None = None, renormalize: bool = True, layer: str = "variant_layer") -> DataFrame:
    """Weighted value per keys over the forms present. Weights are scaled to one over the present forms
    (equal where none is positive) unless ``renormalize`` is off. A form whose mean is null adds nothing
    and its weight isn't given to others; all null gives null."""
    table = F.create_map(*[x for k, v in (weights or WEIGHTS).items() for x in (F.lit(k), F.lit(float(v)))])
    w = F.coalesce(F.try_element_at(table, F.col(layer)), F.lit(0.0))
    g = Window.partitionBy(*keys)
    rows = layers.withColumn("__w", w)
    if renormalize:
        total = F.sum(F.greatest(F.col("__w"), F.lit(0.0))).over(g)
        rows = rows.withColumn("__w", F.when(total > 0, F.col("__w") / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(g)))
    return rows.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("__w") * F.col("value")).alias("access"))


def by_knowledge(rows: DataFrame, metric: str, **options) -> DataFrame:
    return weighted(by_layer(rows, KEYS, metric), KEYS, **options)


def by_role_language(rows: DataFrame, metric: str, **options) -> DataFrame:
    """Over records, not over knowledge items: means per form are taken over all rows of the role."""
    return weighted(by_layer(rows, ["language", "topic_role"], metric), ["language", "topic_role"], **options)


def grouping_summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Count and means overall and per value of each key, in one pass over grouping sets: grouping (the
    key's name, or ``overall``), value, n_rows and the means."""
    r = rows.select(*[group_value(F.col(k)).alias(k) for k in keys], *metrics)
    sets = [[F.col(k)] for k in keys] + [[]]
    g = r.groupingSets(sets, *[F.col(k) for k in keys]).agg(*[F.grouping(k).alias(f"__g_{k}") for k in keys], F.count(F.lit(1)).alias("n_rows"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])
    name, value = F.lit("overall"), F.lit("")
    for k in reversed(keys):
        name = F.when(F.col(f"__g_{k}") == 0, F.lit(k)).otherwise(name)
        value = F.when(F.col(f"__g_{k}") == 0, F.col(k)).otherwise(value)
    return g.select(name.alias("grouping"), value.alias("value"), "n_rows", *[f"mean_{m}" for m in metrics])


def report(layers: DataFrame, roles: DataFrame, languages: list[str]) -> DataFrame:
    """One row per language and role (target, then neighbor), with core, surface and weighted values;
    cells without data are null."""
    spark = layers.sparkSession
    dims = spark.createDataFrame([(l, r, i * 2 + j) for i, l in enumerate(languages) for j, r in enumerate(("target", "neighbor"))], "language string, topic_role string, row int")
    wide = layers.groupBy("language", "topic_role").pivot("variant_layer", ["core", "surface"]).agg(F.first("value"))
    return F.broadcast(dims).join(wide, ["language", "topic_role"], "left").join(roles.select("language", "topic_role", F.col("access")), ["language", "topic_role"], "left").select("row", "language", "topic_role", "core", "surface", "access")


def monitor_scalars(layers: DataFrame, roles: DataFrame, metric: str) -> DataFrame:
    """Named scalars A_current_<metric>/<role>/<language>[/<form>] with their values."""
    per_layer = layers.select(F.format_string(f"A_current_v_{metric}/%s/%s/%s", "topic_role", "language", "variant_layer").alias("name"), "value")
    per_role = roles.select(F.format_string(f"A_current_{metric}/%s/%s", "topic_role", "language").alias("name"), F.col("access").alias("value"))
    return per_layer.unionByName(per_role)
