"""Queries of the general data problems: small files (p3) and nested records (p5)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.operators import compaction, nested
from polyquarry.session import scratch, table

C = F.col


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidate(table(spark, d, "cache_file")).select(*compaction.KEY)


def p3_consolidated(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidate(table(spark, d, "cache_file"))


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    m = compaction.range_metadata(compaction.consolidate(table(spark, d, "cache_file")))
    return m.select("out_file", "n_records", "n_bytes", F.col("min_key.source_qa_id").alias("min_qa_id"), F.col("max_key.source_qa_id").alias("max_qa_id"))


def p3_written(spark: SparkSession, d: str) -> DataFrame:
    """The files as written, with every copy kept, counted from what is read back."""
    path = scratch(spark, "consolidated")
    compaction.write_consolidated(table(spark, d, "cache_file"), path, keep_copies=True)
    data = spark.read.parquet(f"{path}/data")
    return data.groupBy(*compaction.KEY).agg(F.count(F.lit(1)).alias("n_copies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the flat tables: attempts routed to a variant, and the items and files that have none."""
    flat = nested.flatten(table(spark, d, "attempt_cache"))
    none = lambda c: F.coalesce(C(c), F.lit(0)) == 0
    keys = flat["attempts"].filter(C("variant").isNotNull()).select("cache_id", "item_pos", "attempt_pos")
    items = flat["items"].filter(none("n_attempts")).select("cache_id", "item_pos", F.lit(-1).alias("attempt_pos"))
    files = flat["files"].filter(none("n_items")).select("cache_id", F.lit(-1).alias("item_pos"), F.lit(-1).alias("attempt_pos"))
    return keys.unionByName(items).unionByName(files)


def _flat(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.flatten(table(spark, d, "attempt_cache"))[name]

    return run


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    return p5_attempts(spark, d).groupBy("variant").agg(F.count(F.lit(1)).alias("n_attempts"))


p5_files, p5_items, p5_aliases = (_flat(n) for n in ("files", "items", "aliases"))


def p5_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _flat("attempts")(spark, d).drop("shape")


def p5_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The automaton's states and how many attempts end in each."""
    return _flat("attempts")(spark, d).groupBy("shape").agg(F.count(F.lit(1)).alias("n_attempts"))


p5_translated_only = _flat("attempts__translation")
p5_complete = _flat("attempts__translation+backtranslation_en+consistency")

_ROWS = """
WITH files AS (SELECT DISTINCT cache_id, attempt_history AS h FROM attempt_cache),
its AS (SELECT cache_id, unnest(range(len(h))) AS item_pos, unnest(h) AS it FROM files WHERE len(h) > 0),
ats AS (SELECT cache_id, item_pos, unnest(range(len(it.attempts))) AS attempt_pos, unnest(it.attempts) AS att FROM its WHERE len(it.attempts) > 0)
"""
_VARIANT = """coalesce(nullif(concat_ws('+', CASE WHEN att.translation IS NOT NULL THEN 'translation' END,
 CASE WHEN att.backtranslation_en IS NOT NULL THEN 'backtranslation_en' END, CASE WHEN att.consistency IS NOT NULL THEN 'consistency' END), ''), 'bare')"""

#: Bodies cut into pieces by layout (lines, indented objects, indented arrays), those that are whole JSON.
_PIECES = """
WITH b AS (SELECT ltrim(replace(body, chr(65279), ''), E' \\n\\r\\t') AS t FROM cache_file WHERE body IS NOT NULL),
p AS (SELECT unnest(CASE WHEN starts_with(t, '[') THEN list_transform(string_split(substr(t, 2), E'\\n  }'), lambda x: regexp_replace(x, '^[\\s,]+', '') || '}')
 WHEN starts_with(t, E'{\\n') THEN list_transform(string_split(t, E'\\n}'), lambda x: x || '}') ELSE string_split(t, E'\\n') END) AS p FROM b),
r AS (SELECT CASE WHEN json_valid(p) THEN p::JSON END AS j FROM p),
k AS (SELECT j->>'source_qa_id' AS source_qa_id, j->>'target_language' AS target_language, CAST(j->>'attempt' AS BIGINT) AS attempt FROM r WHERE json_type(j, '$.attempt') IS NOT NULL AND j->>'source_qa_id' IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (p3_found, p3_consolidated, p3_ranges, p3_written, p5_found, p5_variants, p5_shapes)} | {
    "p5_files": p5_files, "p5_items": p5_items, "p5_attempts": p5_attempts, "p5_aliases": p5_aliases,
    "p5_translated_only": p5_translated_only, "p5_complete": p5_complete,
}

#: An attempt's members as the table has them: ``[]`` marks a list, a dict a struct.
_ATTEMPT = {
    "attempt": "", "translation": {"question": "", "expected_answer": "", "answer_aliases": [], "translation_note": ""},
    "backtranslation_en": {"source_qa_id": "", "question": "", "expected_answer": "", "answer_aliases": []},
    "consistency": {"verdict": "", "is_consistent": "", "failure_type": "", "reason": "", "repair_instruction": ""},
}


def _shape(x: str, kind: object) -> str:
    present = "'v'"
    if isinstance(kind, dict):
        present = "'{' || " + " || ',' || ".join(f"'{k}:' || {_shape(f'{x}.{k}', v)}" for k, v in kind.items()) + " || '}'"
    elif isinstance(kind, list):
        present = f"'[' || array_to_string(list_sort(list_distinct(list_transform({x}, lambda e: CASE WHEN e IS NULL THEN 'n' ELSE 'v' END))), '|') || ']'"
    return f"CASE WHEN {x} IS NULL THEN 'n' ELSE {present} END"


ORACLE = {
    "p5_shapes": _ROWS + f"SELECT {_shape('att', _ATTEMPT)} AS shape, count(*) AS n_attempts FROM ats GROUP BY 1",
    "p3_found": _PIECES + "SELECT DISTINCT source_qa_id, target_language, attempt FROM k",
    "p3_written": _PIECES + "SELECT source_qa_id, target_language, attempt, count(*) AS n_copies FROM k GROUP BY ALL",
    "p5_found": _ROWS
    + """SELECT cache_id, CAST(item_pos AS INT) AS item_pos, CAST(attempt_pos AS INT) AS attempt_pos FROM ats
UNION SELECT cache_id, CAST(item_pos AS INT), -1 FROM its WHERE coalesce(len(it.attempts), 0) = 0
UNION SELECT cache_id, -1, -1 FROM files WHERE coalesce(len(h), 0) = 0""",
    "p5_variants": _ROWS + f"SELECT {_VARIANT} AS variant, count(*) AS n_attempts FROM ats GROUP BY 1",
    "p5_items": _ROWS + "SELECT cache_id, CAST(item_pos AS INT) AS item_pos, it.source_qa_id AS source_qa_id, CAST(len(it.attempts) AS INT) AS n_attempts FROM its",
    "p5_attempts": _ROWS
    + f"""SELECT cache_id, CAST(item_pos AS INT) AS item_pos, CAST(attempt_pos AS INT) AS attempt_pos, att.attempt AS attempt, {_VARIANT} AS variant, att.translation.question AS question, att.backtranslation_en.question AS back_question,
 att.consistency.verdict AS verdict, CAST(len(att.translation.answer_aliases) AS INT) AS n_aliases, CAST(len(att.backtranslation_en.answer_aliases) AS INT) AS n_back_aliases FROM ats""",
    "p5_aliases": _ROWS
    + """, ls AS (SELECT cache_id, item_pos, attempt_pos, 'translation' AS origin, att.translation.answer_aliases AS l FROM ats
 UNION ALL SELECT cache_id, item_pos, attempt_pos, 'backtranslation_en', att.backtranslation_en.answer_aliases FROM ats)
SELECT cache_id, CAST(item_pos AS INT) AS item_pos, CAST(attempt_pos AS INT) AS attempt_pos, origin,
 CAST(unnest(range(len(l))) AS INT) AS alias_pos, unnest(l) AS alias FROM ls WHERE len(l) > 0""",
    "p5_translated_only": _ROWS
    + f"""SELECT cache_id, CAST(item_pos AS INT) AS item_pos, CAST(attempt_pos AS INT) AS attempt_pos, att.attempt AS attempt, att.translation.question AS question,
 att.translation.expected_answer AS expected_answer, att.translation.translation_note AS translation_note, CAST(len(att.translation.answer_aliases) AS INT) AS n_aliases
 FROM ats WHERE {_VARIANT} = 'translation'""",
    "p5_complete": _ROWS
    + f"""SELECT cache_id, CAST(item_pos AS INT) AS item_pos, CAST(attempt_pos AS INT) AS attempt_pos, att.attempt AS attempt, att.translation.question AS question,
 att.translation.expected_answer AS expected_answer, att.translation.translation_note AS translation_note, CAST(len(att.translation.answer_aliases) AS INT) AS n_aliases,
 att.backtranslation_en.source_qa_id AS back_source_qa_id, att.backtranslation_en.question AS back_question, att.backtranslation_en.expected_answer AS back_expected_answer,
 CAST(len(att.backtranslation_en.answer_aliases) AS INT) AS n_back_aliases, att.consistency.verdict AS verdict, att.consistency.is_consistent AS is_consistent,
 att.consistency.failure_type AS failure_type, att.consistency.reason AS reason, att.consistency.repair_instruction AS repair_instruction
 FROM ats WHERE {_VARIANT} = 'translation+backtranslation_en+consistency'""",
    "p5_files": """SELECT cache_id, min(ingested_at) AS first_ingested_at, max(ingested_at) AS last_ingested_at, max(prompt_version) AS prompt_version,
 max(knowledge_pair_id) AS knowledge_pair_id, max(source_language) AS source_language, max(target_language) AS target_language, max(model_name) AS model_name,
 max(api_base) AS api_base, max(generated_at) AS generated_at, CAST(max(len(attempt_history)) AS INT) AS n_items FROM attempt_cache GROUP BY cache_id""",
}
