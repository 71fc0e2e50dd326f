"""Source-by-language matrices: long and wide forms, transfer, damage, spillover and selectivity.

Tables are long: source (language of the intervention), target (language of the test), value. All
figures are null where nothing can be said; epsilon guards divisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ten languages in their published order.
LANGUAGES = ["ar", "bn", "de", "en", "es", "fr", "ja", "sw", "th", "zh"]
EPSILON = 1e-6


def wide(rows: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """One row per ``row`` and one column per listed value of ``column``; missing cells are null."""
    return rows.groupBy(row).pivot(column, columns or LANGUAGES).agg(F.first(value))


def ratio(before: Column, after: Column, epsilon: float = EPSILON) -> Column:
    return after / F.greatest(before, F.lit(epsilon))


def transfer(before: DataFrame, after: DataFrame, item: str = "item", epsilon: float = EPSILON) -> DataFrame:
    """T(source, target): mean over items of (before - after) / max(before, epsilon). ``before``: item,
    target, value; ``after``: item, source, target, value."""
    b = before.select(item, "target", F.col("value").alias("__b"))
    return after.join(b, [item, "target"]).groupBy("source", "target").agg(F.avg((F.col("__b") - F.col("value")) / F.greatest(F.col("__b"), F.lit(epsilon))).alias("value"))


def retention(before: DataFrame, after: DataFrame, item: str = "item", epsilon: float = EPSILON) -> DataFrame:
    """R(source, target): mean over items of after / max(before, epsilon); damage is 1 - R."""
    b = before.select(item, "target", F.col("value").alias("__b"))
    return after.join(b, [item, "target"]).groupBy("source", "target").agg(F.avg(ratio(F.col("__b"), F.col("value"), epsilon)).alias("value"))


def damage(retained: DataFrame) -> DataFrame:
    return retained.withColumn("value", F.lit(1.0) - F.col("value"))


def globality(t: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Globality (mean off the diagonal over mean on it) and locality (one minus that)."""
    off, on = F.avg(F.when(F.col("source") != F.col("target"), F.col("value"))), F.avg(F.when(F.col("source") == F.col("target"), F.col("value")))
    g = t.agg((off / (on + F.lit(epsilon))).alias("globality"))
    return g.withColumn("locality", F.lit(1.0) - F.col("globality"))


def asymmetry(t: DataFrame) -> DataFrame:
    """Mean |T(s,t) - T(t,s)| over ordered pairs of different languages that have both."""
    a, b = t.alias("a"), t.alias("b")
    both = a.join(b, (F.col("a.source") == F.col("b.target")) & (F.col("a.target") == F.col("b.source")) & (F.col("a.source") != F.col("a.target")))
    return both.agg(F.avg(F.abs(F.col("a.value") - F.col("b.value"))).alias("asymmetry"))


def consistency(t: DataFrame) -> DataFrame:
    """One minus the mean over sources of the population deviation over other targets."""
    per = t.filter(F.col("source") != F.col("target")).groupBy("source").agg(F.stddev_pop("value").alias("d"))
    return per.agg((F.lit(1.0) - F.avg("d")).alias("consistency"))


def spillover(d: DataFrame) -> DataFrame:
    """Damage over all cells and over those off the diagonal."""
    return d.agg(F.avg("value").alias("overall"), F.avg(F.when(F.col("source") != F.col("target"), F.col("value"))).alias("spillover"))


def mixture(general: DataFrame, neighbor: DataFrame, alpha: float) -> DataFrame:
    g, n = general.withColumnRenamed("value", "__g"), neighbor.withColumnRenamed("value", "__n")
    return g.join(n, ["source", "target"]).select("source", "target", (F.lit(alpha) * F.col("__g") + F.lit(1.0 - alpha) * F.col("__n")).alias("value"))


def selectivity(t: DataFrame, general: DataFrame, neighbor: DataFrame, weight_general: float = 0.5, weight_neighbor: float = 0.5) -> DataFrame:
    """S = T - weighted damage on general and neighbor knowledge."""
    g, n = general.withColumnRenamed("value", "__g"), neighbor.withColumnRenamed("value", "__n")
    s = F.col("value") - F.lit(weight_general) * F.col("__g") - F.lit(weight_neighbor) * F.col("__n")
    return t.join(g, ["source", "target"]).join(n, ["source", "target"]).select("source", "target", s.alias("value"))


def distance_correlation(t: DataFrame, distances: DataFrame) -> DataFrame:
    """Correlation of transfer with a distance of languages (source, target, distance)."""
    return t.filter(F.col("source") != F.col("target")).join(distances, ["source", "target"]).agg(F.corr("distance", "value").alias("rho"))


def policy_scores(t: DataFrame, after: DataFrame, policy: DataFrame) -> DataFrame:
    """Scores under a policy (source, target, forget: whether access shall go there). forget_compliance:
    mean transfer where it shall; residual_access: mean access left there; containment: one minus the
    mean transfer where it shall not; spillover: that mean; localized: share of cells on the right side
    of one half. The source names these scores without formulas; these are ours."""
    c = t.join(policy, ["source", "target"]).join(after.groupBy("source", "target").agg(F.avg("value").alias("left")), ["source", "target"], "left")
    meant, other = F.col("forget"), ~F.col("forget")
    return c.agg(
        F.avg(F.when(meant, F.col("value"))).alias("forget_compliance"), F.avg(F.when(meant, F.col("left"))).alias("residual_access"),
        (F.lit(1.0) - F.avg(F.when(other, F.col("value")))).alias("containment"), F.avg(F.when(other, F.col("value"))).alias("spillover"),
        F.avg(F.when((F.col("value") >= 0.5) == meant, 1.0).otherwise(0.0)).alias("localized"),
    )
