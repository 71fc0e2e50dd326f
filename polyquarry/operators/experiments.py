"""Runs and their bookkeeping: grids, fingerprints, membership splits, metric definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.operators import matrix, quality
from polyquarry.operators.records import parameter_grid

#: The ten languages by code.
LANGUAGE_NAMES = {
    "ar": "Arabic", "bn": "Bengali", "de": "German", "en": "English", "es": "Spanish", "fr": "French", "ja": "Japanese", "sw": "Swahili", "th": "Thai", "zh": "Chinese",
}
#: Members and held-out rows per language of a membership test.
COMMON_COUNT, CULTURE_HOLDOUT = 500, 300
CULTURE_COUNTS = {"ar": 33, "bn": 27}
CULTURE_DEFAULT = 30
#: Parameters of each method's sweep, as lists of values per name.
SWEEPS = {
    "npo": {"learning_rate": [1e-5, 2e-5, 5e-5], "beta": [0.1, 0.5]},
    "simnpo": {"learning_rate": [1e-5, 2e-5, 5e-5], "beta": [2.5, 4.5], "delta": [0.0, 1.0]},
    "dr_npo": {"learning_rate": [1e-5, 2e-5, 5e-5], "beta": [0.1, 0.5], "sigma": [0.5, 1.0]},
    "dr_simnpo": {"learning_rate": [1e-5, 2e-5, 5e-5], "beta": [2.5, 4.5], "delta": [0.0, 1.0], "sigma": [0.5, 1.0]},
}


def member_specification(spark: SparkSession, dataset: str, languages: list[str] | None = None) -> DataFrame:
    """Which rows are members and which are held out, per language: split, role, family, origin and count."""
    rows = []
    for x in languages or matrix.LANGUAGES:
        if dataset == "common":
            rows += [(x, "member", "target", None, None, COMMON_COUNT), (x, "holdout", "holdout", "holdout", None, COMMON_COUNT)]
        else:
            rows += [(x, "member", "target", "culture_specific", x, CULTURE_COUNTS.get(x, CULTURE_DEFAULT)), (x, "holdout", "culture_holdout", "culture_holdout", None, CULTURE_HOLDOUT)]
    return spark.createDataFrame(rows, "language string, split string, topic_role string, dataset_family string, culture_origin string, n_rows int")


def membership(rows: DataFrame, specification: DataFrame) -> DataFrame:
    """Rows with their ``split`` by the specification; a null of it lets any value pass."""
    s = specification.select(F.col("language").alias("__l"), F.col("topic_role").alias("__r"), F.col("dataset_family").alias("__f"), F.col("culture_origin").alias("__o"), "split")
    fits = (F.col("language") == F.col("__l")) & (F.col("topic_role") == F.col("__r"))
    fits = fits & (F.col("__f").isNull() | (F.col("dataset_family") == F.col("__f"))) & (F.col("__o").isNull() | (F.col("culture_origin") == F.col("__o")))
    return rows.join(F.broadcast(s), fits).drop("__l", "__r", "__f", "__o")  # at most two rows per language


def membership_counts(rows: DataFrame, specification: DataFrame) -> DataFrame:
    """Per language and split the rows wanted and there, and whether they agree."""
    have = membership(rows, specification).groupBy("language", "split").agg(F.count(F.lit(1)).alias("n_found"))
    out = specification.select("language", "split", F.col("n_rows").alias("n_wanted")).join(have, ["language", "split"], "left")
    return out.withColumn("n_found", F.coalesce("n_found", F.lit(0))).withColumn("agrees", F.col("n_found") == F.col("n_wanted"))


def fingerprint(parameters: Column) -> Column:
    """A run's identity: the SHA-256 of its parameters (a map) in order of their names."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parameters)))), 256)


def pending_runs(grid: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs of a grid (``parameters``, a map) that haven't finished under the same fingerprint."""
    g = grid.withColumn("fingerprint", fingerprint(F.col("parameters")))
    return g.join(finished.select("fingerprint").distinct(), "fingerprint", "left_anti")


def sweep(spark: SparkSession, method: str, languages: list[str]) -> DataFrame:
    """The runs of a method's sweep: every combination of its values for every source language."""
    if method not in SWEEPS:
        raise ValueError(f"no sweep for {method}")
    grid = parameter_grid(spark, **SWEEPS[method], source_language=languages)
    return grid.select("source_language", F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in sorted(SWEEPS[method])])).alias("parameters"))


def metric_definition(spark: SparkSession, name: str, formula: str, fields: list[str], **parameters: object) -> DataFrame:
    """One row that tells what a stored metric is."""
    frozen = quality.unresolved(parameters)
    if frozen:
        raise ValueError(f"unresolved parameters: {', '.join(frozen)}")
    return spark.createDataFrame([(name, formula, list(fields), {k: str(v) for k, v in sorted(parameters.items())})], "name string, formula string, fields array<string>, parameters map<string,string>")


def language_table(spark: SparkSession) -> DataFrame:
    """The language dimension: code, name and place in the published order."""
    return spark.createDataFrame([(c, LANGUAGE_NAMES[c], i) for i, c in enumerate(matrix.LANGUAGES)], "language string, name string, position int")


def resolve_languages(text: str, source: str = "en") -> list[str]:
    """Target languages of an argument: ``all`` for every one but the source, else a comma list; repeats
    count once, unknown ones and the source itself are an error."""
    named = [c for c in matrix.LANGUAGES if c != source] if text.strip().lower() == "all" else list(dict.fromkeys(x.strip().lower() for x in text.split(",") if x.strip()))
    bad = [x for x in named if x not in LANGUAGE_NAMES or x == source]
    if bad or not named:
        raise ValueError(f"no such target languages: {', '.join(bad) or text!r}")
    return named
