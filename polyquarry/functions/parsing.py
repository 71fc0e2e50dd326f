"""Tolerant readers of model answers: Column expressions over JSON text.

An answer may wrap the wanted object in a field, in a list, or be it. The root is the answer itself or the
first object of a list; null stands for an answer that holds no such object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyquarry.functions import text as tx


def first_object(value: Column) -> Column:
    """A JSON object as it is, the first object of a JSON list; null for anything else."""
    v = F.trim(value)
    items = F.filter(F.from_json(F.when(F.startswith(v, F.lit("[")), v), "array<string>"), lambda x: F.startswith(F.trim(x), F.lit("{")))
    return F.when(F.startswith(v, F.lit("{")), v).otherwise(F.try_element_at(items, F.lit(1)))


def field(obj: Column, name: str) -> Column:
    return F.get_json_object(obj, f"$.{name}")


def aliases(value: Column) -> Column:
    """The non-blank texts of a JSON list, white space collapsed; an empty list for anything else."""
    v = F.trim(value)
    items = F.from_json(F.when(F.startswith(v, F.lit("[")), v), "array<string>")
    return F.coalesce(F.filter(F.transform(items, tx.normalize_ws), lambda x: x != ""), F.array().cast("array<string>"))


def _itself(root: Column, *names: str) -> Column:
    """The root where all fields are there, also with a null value."""
    keys = F.json_object_keys(root)
    have = F.lit(True)
    for n in names:
        have = have & F.array_contains(keys, n)
    return F.when(have, root)


def translation(answer: Column, source_id: Column, language: Column) -> Column:
    """The translation in an answer: ``translation``, or that of ``translations`` for the source, or the
    first of them, or the answer itself. A struct with source_qa_id and language filled in where absent."""
    root = first_object(answer)
    many = field(root, "translations")
    listed = F.from_json(F.when(F.startswith(F.trim(many), F.lit("[")), many), "array<string>")
    mine = F.try_element_at(F.filter(listed, lambda x: F.startswith(F.trim(x), F.lit("{")) & (tx.normalize_ws(F.get_json_object(x, "$.source_qa_id")) == source_id)), F.lit(1))
    t = F.coalesce(_full(first_object(field(root, "translation"))), mine, _full(first_object(many)), _itself(root, "question", "expected_answer"))
    return F.when(t.isNotNull(), F.struct(
        F.coalesce(field(t, "source_qa_id"), source_id).alias("source_qa_id"), F.coalesce(field(t, "language"), language).alias("language"), field(t, "question").alias("question"),
        field(t, "expected_answer").alias("expected_answer"), aliases(field(t, "answer_aliases")).alias("answer_aliases"), field(t, "translation_note").alias("translation_note"),
    ))


def _full(obj: Column) -> Column:
    """An empty object counts as none."""
    return F.when(F.json_array_length(F.to_json(F.json_object_keys(obj))) > 0, obj)


def back_translation(answer: Column, source_id: Column) -> Column:
    """The back translation in an answer: ``backtranslation``, or the first of ``backtranslations``, or the
    answer itself; texts with white space collapsed, the source's id where it names none."""
    root = first_object(answer)
    t = F.coalesce(_full(first_object(field(root, "backtranslation"))), _full(first_object(field(root, "backtranslations"))), _itself(root, "question", "expected_answer"))
    own = tx.normalize_ws(field(t, "source_qa_id"))
    return F.when(t.isNotNull(), F.struct(
        F.when(own != "", own).otherwise(source_id).alias("source_qa_id"), tx.normalize_ws(field(t, "question")).alias("question"),
        tx.normalize_ws(field(t, "expected_answer")).alias("expected_answer"), aliases(field(t, "answer_aliases")).alias("answer_aliases"),
    ))


def consistency(answer: Column) -> Column:
    """The verdict in an answer: ``consistency``, or the answer itself where it has a verdict. A boolean
    ``is_consistent`` decides, else whether the verdict is ``passed``; both then say the same."""
    root = first_object(answer)
    keys = F.json_object_keys(root)
    own = F.when(F.array_contains(keys, "verdict") | F.array_contains(keys, "is_consistent"), root)
    t = F.coalesce(_full(first_object(field(root, "consistency"))), own)
    said = F.regexp_extract(t, r'"is_consistent"\s*:\s*(true|false)', 1)
    passed = F.when(said != "", said == "true").otherwise(F.lower(tx.normalize_ws(field(t, "verdict"))) == "passed")
    return F.when(t.isNotNull(), F.struct(
        F.when(passed, F.lit("passed")).otherwise(F.lit("failed")).alias("verdict"), passed.alias("is_consistent"),
        *[tx.normalize_ws(field(t, n)).alias(n) for n in ("failure_type", "reason", "repair_instruction")],
    ))


def alias_answer(answer: Column) -> Column:
    """The aliases and the note of an answer to an alias question."""
    root = first_object(answer)
    return F.struct(aliases(field(root, "answer_aliases")).alias("answer_aliases"), tx.normalize_ws(field(root, "note")).alias("note"))


def translated_batch(answer: Column) -> Column:
    """Id → text of a batch answer: ``translations`` as a list of objects with id and translation (or text)."""
    root = first_object(answer)
    many = F.from_json(field(root, "translations"), "array<struct<id:string,translation:string,text:string>>")
    fine = F.filter(many, lambda x: x["id"].isNotNull() & F.coalesce(x["translation"], x["text"]).isNotNull())
    return F.transform(fine, lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["translation"], x["text"]).alias("translated")))


def prompt(task: str, rules: list[str], schema: str, payload: Column) -> Column:
    """A request in words: the task, its numbered rules, the answer's form, and the payload as JSON."""
    head = "\n".join([task, "", "Rules:", *[f"{i}. {r}" for i, r in enumerate(rules, 1)], "", f"Answer with JSON only: {schema}", "", "Payload:", ""])
    return F.concat(F.lit(head), F.to_json(payload))
