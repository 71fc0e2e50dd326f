"""Translations made, turned back, checked and repaired, with the services injected.

The loop runs per row inside partitions: nothing is called on the driver, and a lost task repeats its calls.
Which rows are accepted and which are queued is told by joins and expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.functions import parsing
from polyquarry.functions import text as tx
from polyquarry.operators.shapes import truncated_aliases
from polyquarry.sources.connectors import Client, ServiceError, message_text

#: What is told where no verdict came.
DEFAULT_FAILURE = "model_output_error"
REPAIR = "Regenerate the target-language QA so it preserves the source English QA exactly."
ATTEMPTS = 3
LOOP = "source_qa_id string, status string, n_attempts int, question string, expected_answer string, answer_aliases array<string>, failure_type string, reason string"


def failed_consistency(reason: Column, failure_type: Column | None = None) -> Column:
    """The verdict that stands where the model gave none."""
    kind = F.lit(DEFAULT_FAILURE) if failure_type is None else failure_type
    return F.struct(F.lit("failed").alias("verdict"), F.lit(False).alias("is_consistent"), kind.alias("failure_type"), reason.alias("reason"), F.lit(REPAIR).alias("repair_instruction"))


def _object(answer: dict, name: str) -> dict:
    try:
        value = json.loads(message_text(answer) or "null")
    except ValueError as e:
        raise ValueError("no JSON in the answer") from e
    value = next((x for x in value if isinstance(x, dict)), {}) if isinstance(value, list) else value
    value = value if isinstance(value, dict) else {}
    inner = value.get(name)
    inner = next((x for x in inner if isinstance(x, dict)), None) if isinstance(inner, list) else inner
    if isinstance(inner, dict) and inner:
        return inner
    if name == "consistency" and ("verdict" in value or "is_consistent" in value) or "question" in value and "expected_answer" in value:
        return value
    raise ValueError(f"no {name} in the answer")


def verified(rows: DataFrame, factory: Callable[[], Client], attempts: int = ATTEMPTS) -> DataFrame:
    """Each source (source_qa_id, language, question, expected_answer) translated, translated back and
    compared, up to ``attempts`` times. ``factory`` makes a chat client per task; its requests carry ``step``
    (translate, repair, back or check) and the texts. Accepted is the first consistent attempt; a row without
    one is ``failed`` with the last verdict's reason, for the queue of repairs. Service errors end an attempt
    like broken answers do."""

    def one(client: Client, row: dict) -> tuple:
        last: dict = {}
        verdict = {"failure_type": DEFAULT_FAILURE, "reason": "no attempt"}
        for n in range(1, attempts + 1):
            try:
                request = {"step": "translate" if n == 1 else "repair", **row} | ({} if n == 1 else {"previous": last, "consistency": verdict})
                last = _object(client(request), "translation")
                if not str(last.get("question") or "").strip() or not str(last.get("expected_answer") or "").strip():
                    raise ValueError("invalid translation")
                back = _object(client({"step": "back", "language": row["language"], "candidate": last}), "backtranslation")
                verdict = _object(client({"step": "check", **row, "candidate": last, "backtranslation": back}), "consistency")
                said = verdict.get("is_consistent")
                if said if isinstance(said, bool) else str(verdict.get("verdict")).strip().lower() == "passed":
                    return row["source_qa_id"], "accepted", n, last["question"], last["expected_answer"], [a for a in last.get("answer_aliases") or [] if isinstance(a, str)], None, None
            except (ValueError, ServiceError) as e:
                verdict = {"failure_type": DEFAULT_FAILURE, "reason": str(e)}
        return row["source_qa_id"], "failed", attempts, None, None, [], str(verdict.get("failure_type") or ""), str(verdict.get("reason") or "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for f in frames:
            yield pd.DataFrame([one(client, r) for r in f.to_dict("records")], columns=[c.split()[0] for c in LOOP.split(", ")])

    return rows.select("source_qa_id", "language", "question", "expected_answer").mapInPandas(run, LOOP)


def lookup(failed: DataFrame, sources: DataFrame, repaired: DataFrame) -> DataFrame:
    """Failed records by source_qa_id with their source and their repair: ``state`` is ``repaired``,
    ``unrepaired`` (no repair came) or ``unknown_source``. Repeated repairs: the first in text order stays."""
    s = sources.select(F.col("qa_id").alias("source_qa_id"), F.lit(True).alias("__known")).distinct()
    r = repaired.groupBy("source_qa_id").agg(F.min("expected_answer").alias("repaired_answer"))
    out = failed.join(s, "source_qa_id", "left").join(r, "source_qa_id", "left")
    state = F.when(F.col("__known").isNull(), F.lit("unknown_source")).when(F.col("repaired_answer").isNull(), F.lit("unrepaired")).otherwise(F.lit("repaired"))
    return out.withColumn("state", state).drop("__known")


def alias_requests(failed: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests to translate the aliases of failed records whose failure speaks of aliases and whose source
    is known and has aliases: source_qa_id, language, request (a prompt over JSON)."""
    f = failed.filter(F.contains(F.lower(F.col("failure_type")), F.lit("alias")))
    s = sources.select(F.col("qa_id").alias("source_qa_id"), F.col("question").alias("source_question"), F.col("expected_answer").alias("source_answer"), F.col("answer_aliases").alias("source_aliases"))
    both = f.join(s, "source_qa_id").filter(F.size("source_aliases") > 0)
    payload = F.struct("language", "source_qa_id", "source_question", "source_answer", "source_aliases", "question", "expected_answer")
    rules = ["Translate the source aliases only; question and answer stay as they are.", "An alias has to mean exactly what the expected answer means.", "No source aliases, no aliases."]
    asked = parsing.prompt("Translate the English aliases of an answer into the target language.", rules, '{"answer_aliases": ["..."], "note": "..."}', payload)
    return both.withColumn("request", asked)


def repaired_aliases(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows (expected_answer, source_aliases, topic_name, source_page and a JSON ``answer``) with
    ``answer_aliases``: those of the answer that are safe beside the expected answer, each once, at most as
    many as the source has; and ``note``."""
    got = parsing.alias_answer(F.col(answer))
    safe = tx.safe_aliases(got["answer_aliases"], tx.normalize_ws(F.col("expected_answer")), F.col("topic_name"), F.col("source_page"))
    return rows.withColumn("note", F.coalesce(F.nullif(got["note"], F.lit("")), F.lit("translated source aliases only"))).withColumn("answer_aliases", truncated_aliases(F.array_distinct(safe), F.col("source_aliases")))


def missing_translations(asked: DataFrame, answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Ids of a batch (batch, id) that no answer of the batch (batch, JSON) translates."""
    got = answers.select("batch", F.explode(parsing.translated_batch(F.col(answer))).alias("t")).select("batch", "t.id").distinct()
    return asked.join(got, ["batch", "id"], "left_anti")


def warnings_of(rows: DataFrame) -> DataFrame:
    """Sources whose attempts failed, as warning rows."""
    return rows.filter("status = 'failed'").select("source_qa_id", F.concat(F.col("source_qa_id"), F.lit(": "), F.coalesce("reason", F.lit(""))).alias("warning"))
