"""Queries of the text problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.llm import attempts, language, leakage, lookalikes, overlap, packing, pairs, pii
from polyquarry.session import spread, table


VALUE_KEYS = [*attempts.KEYS, "field_name", "alias_pos"]


def _values_of(cache: DataFrame) -> DataFrame:
    """One row per expected_answer (alias_pos -1) and per alias."""
    t = attempts.translations(cache)
    answers = F.array(F.struct(F.lit("expected_answer").alias("field_name"), F.lit(-1).alias("alias_pos"), F.col("expected_answer").alias("value")))
    aliases = F.transform(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda v, i: F.struct(F.lit("answer_aliases").alias("field_name"), i.alias("alias_pos"), v.alias("value")))
    return t.select(*attempts.KEYS, F.explode(F.concat(answers, aliases)).alias("v")).select(*attempts.KEYS, "v.field_name", "v.alias_pos", "v.value").filter(F.col("value").isNotNull())


def _answer_values(spark: SparkSession, d: str) -> DataFrame:
    return _values_of(table(spark, d, "attempt_cache"))


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every value with its one form; only rows of repeated ids are shuffled to be told once."""
    return lookalikes.unify(attempts.nested.once(table(spark, d, "attempt_cache"), _values_of, VALUE_KEYS))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    changed = lookalikes.unify(_answer_values(spark, d)).filter(F.col("value") != F.col("canonical"))
    return changed.select(*attempts.KEYS, "field_name", "alias_pos").distinct()


def _by_label(spark: SparkSession, d: str) -> DataFrame:
    """Labelled texts: translations by their row's language, back translations as English."""
    cache = table(spark, d, "attempt_cache")
    t = attempts.translations(cache)
    code = language.code_column(F.col("target_language"))
    own = t.select(code.alias("code"), F.explode(F.array("question", "expected_answer")).alias("text"))
    b = F.col("attempt.backtranslation_en")
    english = attempts.nested.attempts(cache).select(F.lit("en").alias("code"), F.explode(F.array(b["question"], b["expected_answer"])).alias("text"))
    return own.unionByName(english)


def _labelled(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """The bounded sample of labelled texts."""
    return language.labelled_sample(_by_label(spark, d))


def _texts(spark: SparkSession, d: str, found) -> DataFrame:
    """One row per text field of an attempt, with what ``found`` makes of the text."""
    t = attempts.translations(table(spark, d, "attempt_cache"))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("question", "expected_answer")])
    rows = t.select(*attempts.KEYS, language.code_column(F.col("target_language")).alias("named"), F.explode(fields).alias("f")).select(*attempts.KEYS, "named", "f.field_name", "f.text")
    return spread(rows.filter(F.col("text").isNotNull())).withColumn("found", found("text"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    """One row per text field of an attempt that counts: its segments and their languages."""
    rows = _texts(spark, d, language.identify_column(language.fit(iter(_labelled(spark, d)))))
    return rows.filter((F.col("field_name") == "question") | F.col("found.sentence"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, language.codes_column(language.fit(iter(_labelled(spark, d)))))
    rows = rows.filter((F.col("field_name") == "question") | F.startswith("found", F.lit("1")))
    codes = F.filter(F.split(F.substring("found", 2, 1000), ","), lambda c: c != "")
    other = F.col("named").isNull() | (codes != F.array("named"))
    return rows.filter(other).select(*attempts.KEYS, "field_name", F.explode(codes).alias("lang_code")).distinct()


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every text field with each of its languages and the best confidence of its segments."""
    rows = _languages(spark, d).select(*attempts.KEYS, "field_name", "named", F.explode("found.parts").alias("l"))
    return rows.groupBy(*attempts.KEYS, "field_name", "named", F.col("l.lang_code").alias("lang_code")).agg(F.max("l.confidence").alias("confidence"))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of a text field: where it stands (code points of the text in plain characters), its
    language and the confidence."""
    rows = _languages(spark, d).select(*attempts.KEYS, "field_name", F.explode("found.parts").alias("p"))
    return rows.select(*attempts.KEYS, "field_name", "p.start", "p.length", "p.lang_code", "p.confidence").dropDuplicates([*attempts.KEYS, "field_name", "start"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = language.labelled(_by_label(spark, d))  # all of them: no sample
    judge = pairs.defect_column(language.fitted(texts), pairs.Endings.fitted(texts))
    t = spread(attempts.translations(table(spark, d, "attempt_cache")).select(*attempts.KEYS, "question", "expected_answer"))
    rows = t.select(*attempts.KEYS, judge("question", "expected_answer").alias("defect_type"))
    return rows.filter(F.col("defect_type").isNotNull()).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs per type."""
    return p2_found(spark, d).groupBy("defect_type").agg(F.count(F.lit(1)).alias("n_pairs"))


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "holdout_card"), table(spark, d, "knowledge_card").filter(F.col("split_role") == "train")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(*_splits(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*_splits(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Linked statement classes and their sizes, copies not expanded."""
    return overlap.class_links(*_splits(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_notices(spark: SparkSession, d: str) -> DataFrame:
    """Documents per item that hold the standing notice its passage ends with: what p8_found leaves out."""
    n = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), notices=True)
    return n.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a held-out sentence's template, with its slot values or re-parameterised."""
    return leakage.templates(table(spark, d, "documents"), table(spark, d, "eval_item"))[0]


def _field(spark: SparkSession, d: str) -> pii.Model:
    return pii.trained(table(spark, d, "documents"), table(spark, d, "given_name"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents"), table(spark, d, "given_name")).select("doc_id", "pii_type", "pii_text").distinct()


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "documents"), _field(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "documents")))


QUERIES: dict = {f.__name__: f for f in (p7_containers, p7_fill, p9_found, p9_masked, p8_found, p8_report, p8_notices, p8_templates, p1_found, p1_report, p1_classes, p2_found, p2_report, p4_found, p4_languages, p4_segments, p6_found, p6_canonical)}
ORACLE: dict = {}
