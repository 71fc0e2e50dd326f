"""Expectations: every check returns the rows that break it, so an empty frame means it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.functions import text as tx


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def missing_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with blank or null required fields and the fields' names in the given order."""
    missing = F.array_compact(F.array(*[F.when(tx.strip(F.col(f)) == "", F.lit(f)) for f in fields]))
    return rows.select(key, missing.alias("missing")).filter(F.size("missing") > 0)


def in_filters(rows: DataFrame, wanted: dict[str, list[str] | str | None]) -> DataFrame:
    """Rows that match every filter; None and empty lists don't filter, texts are split at commas."""
    for column, values in wanted.items():
        values = [v.strip() for v in values.split(",") if v.strip()] if isinstance(values, str) else values
        if values:
            rows = rows.filter(F.col(column).isin(values))
    return rows


def form_violations(rows: DataFrame, keys: list[str], layer: str = "variant_layer", surface: int = 3) -> DataFrame:
    """Groups without exactly one core and ``surface`` surface rows, with both counts."""
    n = rows.groupBy(*keys).agg(F.count_if(F.col(layer) == "core").alias("n_core"), F.count_if(F.col(layer) == "surface").alias("n_surface"))
    return n.filter((F.col("n_core") != 1) | (F.col("n_surface") != surface))


def family_mix(rows: DataFrame, source: str, family: str, origin: str) -> DataFrame:
    """Sources whose rows mix dataset families, or are culture-specific with another origin."""
    f = F.coalesce(F.col(family), F.lit(""))
    g = rows.groupBy(source).agg(F.count_distinct(F.when(f == "", F.lit("common")).otherwise(f)).alias("n_families"), F.count_if((f == "culture_specific") & (F.coalesce(F.col(origin), F.lit("")) != F.coalesce(F.col(source), F.lit("")))).alias("n_foreign"))
    return g.filter((F.col("n_families") > 1) | (F.col("n_foreign") > 0))


def not_finite(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows in which any of the numeric columns is null, NaN or infinite."""
    bad: Column = F.lit(False)
    for c in columns:
        v = F.col(c).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return rows.filter(bad).select(key, *columns)


def coerce_aliases(value: Column) -> Column:
    """A JSON value as a list of texts: null as none, a scalar as one, a list as it is."""
    t = F.trim(value)
    listed = F.from_json(t, "array<string>")
    scalar = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v"), t)
    return F.when(value.isNull() | (t == "null"), F.array().cast("array<string>")).when(F.startswith(t, F.lit("[")), listed).otherwise(F.array(scalar))


def require(rows: DataFrame, expected: int) -> DataFrame:
    """``rows`` as they are; reading fails where their count differs from ``expected``."""
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    ok = n.select(F.when(F.col("__n") == expected, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} rows, found "), F.col("__n").cast("string"))).cast("boolean")).alias("__ok"))
    return rows.join(F.broadcast(ok), F.col("__ok"), "inner").drop("__ok")


def enum_violations(rows: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows with a value outside its list: key, column, value (null as it is). One pass over the rows."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, values in allowed.items()]))
    return rows.select(key, F.explode(bad).alias("b")).select(key, "b.column", "b.value")


#: What a topic pair and each of its sides have to name.
PAIR_FIELDS, SIDE_FIELDS = ["pair_id", "topic_type"], ["topic_zh", "topic_en", "wiki_title", "wiki_url"]


def manifest_problems(pairs: DataFrame, side_fields: list[str] | None = None) -> DataFrame:
    """What is wrong with a manifest of topic pairs, as ``pos, context, problem``. ``pairs``: pos (0-based
    place), pair_id, topic_type and the structs target and neighbor (role and the side's fields). A blank
    field is missing; a missing side is one finding; each side has to name its own role."""
    fields = side_fields or SIDE_FIELDS
    at = F.concat(F.lit("topic_pairs["), F.col("pos").cast("string"), F.lit("]"))
    told = lambda context, problem: F.struct(context.alias("context"), problem.alias("problem"))
    found = [F.when(tx.strip(F.col(f)) == "", told(at, F.lit(f"missing {f}"))) for f in PAIR_FIELDS]
    for side in ("target", "neighbor"):
        here = F.concat(at, F.lit(f".{side}"))
        found.append(F.when(F.col(side).isNull(), told(here, F.lit("no object"))))
        there = F.col(side).isNotNull()
        role = tx.strip(F.col(side)["role"])
        found.append(F.when(there & (role != side), told(here, F.concat(F.lit(f"role must be {side}, got "), role))))
        found += [F.when(there & (tx.strip(F.col(side)[f]) == ""), told(here, F.lit(f"missing {f}"))) for f in fields]
    return pairs.select("pos", F.explode(F.array_compact(F.array(*found))).alias("p")).select("pos", "p.context", "p.problem")


class ManifestError(ValueError):
    """A manifest that can't be worked with; the message names the place and what is wrong there."""


def require_manifest(pairs: DataFrame, side_fields: list[str] | None = None) -> DataFrame:
    """``pairs`` as they are; the first findings of ``manifest_problems``, or no pair at all, are an error."""
    found = manifest_problems(pairs, side_fields).orderBy("pos", "context", "problem").limit(5).collect()
    if found or pairs.isEmpty():
        raise ManifestError("; ".join(f"{r['context']}: {r['problem']}" for r in found) or "no topic pairs")
    return pairs


def unresolved(value: object, path: str = "") -> list[str]:
    """Paths of a configuration's values that still hold a reference (``${``) or a gap (``???``)."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in unresolved(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, (list, tuple)):
        return [p for i, v in enumerate(value) for p in unresolved(v, f"{path}[{i}]")]
    return [path] if isinstance(value, str) and ("${" in value or "???" in value) else []


def weight_violations(rows: DataFrame, keys: list[str], weighted: str = "weighted", core: str = "core", surface: str = "surface", tolerance: float = 1e-12) -> DataFrame:
    """Rows whose weighted value isn't a quarter of the core value and three quarters of the surface value
    within ``tolerance``; null and NaN break the rule."""
    away = F.abs(F.col(weighted) - (F.lit(0.25) * F.col(core) + F.lit(0.75) * F.col(surface)))
    return rows.filter(~F.coalesce((away <= tolerance) & ~F.isnan(away), F.lit(False))).select(*keys, core, surface, weighted)
