"""One registry of named operators over frames and of SQL functions.

All public functions of the operator modules are known by ``module.function``; further ones, and short names
of whole evaluations, are registered by the decorator.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OPERATORS: dict[str, Callable] = {}


def register(name: str) -> Callable[[Callable], Callable]:
    """Decorator: make a function known by name; a name can be given once."""

    def keep(f: Callable) -> Callable:
        if name in _OPERATORS:
            raise ValueError(f"{name} is registered already")
        _OPERATORS[name] = f
        return f

    return keep


def names() -> list[str]:
    """All known names; the operator modules are read on the first call."""
    if not any("." in n for n in _OPERATORS):
        from polyquarry import operators

        for m in pkgutil.iter_modules(operators.__path__):
            module = importlib.import_module(f"polyquarry.operators.{m.name}")
            for name, f in inspect.getmembers(module, inspect.isfunction):
                if f.__module__ == module.__name__ and not name.startswith("_"):
                    register(f"{m.name}.{name}")(f)
    return sorted(_OPERATORS)


def operator(name: str) -> Callable:
    if name not in _OPERATORS and name not in names():
        raise KeyError(f"no operator {name!r}; known: {', '.join(names())}")
    return _OPERATORS[name]


# --- whole evaluations by their short names ---------------------------------------------------------------------


@register("evaluate_em")
def evaluate_em(records: DataFrame) -> dict[str, DataFrame]:
    """Exact match over stored generations: the frames of the summary."""
    from polyquarry.operators import rescoring

    return rescoring.summary(rescoring.scored(records, "a_exact"), "a_exact")


@register("evaluate_rouge")
def evaluate_rouge(records: DataFrame) -> dict[str, DataFrame]:
    """ROUGE-L over stored generations: the frames of the summary."""
    from polyquarry.operators import rescoring

    return rescoring.summary(rescoring.scored(records, "a_rouge"), "a_rouge")


@register("evaluate_membership")
def evaluate_membership(scores: DataFrame) -> DataFrame:
    """AUC per attack over rows (attack, is_holdout, score)."""
    from polyquarry.functions import metrics

    return metrics.auc(scores, "score", "is_holdout", "attack")


@register("evaluate_choices")
def evaluate_choices(samples: DataFrame) -> DataFrame:
    """Accuracy per task over stored multiple-choice samples without problems."""
    from pyspark.sql import functions as F

    from polyquarry.operators import records

    return records.choice_records(samples).filter("problem IS NULL").groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("correct").alias("acc"))


@register("evaluate_similarity")
def evaluate_similarity(vectors: DataFrame) -> DataFrame:
    """Mean cosine per language over rows (language, candidate, reference, is_empty)."""
    from pyspark.sql import functions as F

    from polyquarry.functions import metrics

    return vectors.groupBy("language").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(metrics.cosine_checked(F.col("candidate"), F.col("reference"), F.col("is_empty"))).alias("cosine"))


def register_sql(spark: SparkSession) -> list[str]:
    """Make the vectorised functions known to SQL; returns their names."""
    from polyquarry.functions import udfs

    names = ["nfkc_ws", "casefold", "zlib_length", "canonical_sha256", "first_json", "rouge_l"]
    for n in names:
        spark.udf.register(n, getattr(udfs, n))
    return names
