"""Rows of attempt_cache that the text problems share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.operators import nested

KEYS = ["cache_id", "item_pos", "attempt_pos"]


def translations(cache: DataFrame) -> DataFrame:
    """Attempts that hold a translation struct: keys, row language, question, answer, aliases. Rows of
    repeated sources are repeated here; the operators drop the copies after their own pre-aggregation."""
    t = F.col("attempt.translation")
    return (
        nested.attempts(cache, "target_language")
        .filter(t.isNotNull())
        .select(*KEYS, "target_language", t["question"].alias("question"), t["expected_answer"].alias("expected_answer"), t["answer_aliases"].alias("answer_aliases"))
    )
