"""Tables as the queries use them, and the same tables in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.functions import metrics
from polyquarry.operators import nested
from polyquarry.session import table

QA = ["qa_id", "knowledge_pair_id", "pair_id", "card_id", "topic_role", "variant_layer", "language", "question", "expected_answer", "relation_type", "dataset_family", "split_role", "culture_origin"]


def qa(spark: SparkSession, d: str) -> DataFrame:
    """qa_variant without repeated rows; aliases as they are."""
    return table(spark, d, "qa_variant").select(*QA, "answer_aliases").distinct()


def generations(spark: SparkSession, d: str) -> DataFrame:
    """Stored outputs to be scored: back translations of attempts against the expected English answer of
    their source question, once per attempt and source row, with the exact score."""
    a = nested.attempts(table(spark, d, "attempt_cache"), "target_language").select(
        "cache_id", "item_pos", "attempt_pos", F.lower(F.trim("target_language")).alias("language"),
        F.col("item.source_qa_id").alias("qa_id"), F.col("attempt.backtranslation_en.expected_answer").alias("generation"),
    ).distinct()
    q = table(spark, d, "qa_variant").select("qa_id", "knowledge_pair_id", "pair_id", "topic_role", "variant_layer", "relation_type", "dataset_family", "culture_origin", "expected_answer").distinct()
    return a.join(q, "qa_id").withColumn("a_exact", metrics.exact(F.col("generation"), F.col("expected_answer")))


#: The proxy of a scored benchmark on the sales tables: an order is a knowledge item, its priority the
#: language, its status the role; its first line by part is the core form, the next three surface forms.
def scored_orders(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_discount", F.row_number().over(order).alias("rn"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").filter(F.col("rn") <= 4)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("language"), F.col("o_orderstatus").alias("topic_role"))
    return lines.join(o, "l_orderkey").select(F.col("l_orderkey").alias("knowledge_pair_id"), "language", "topic_role", F.when(F.col("rn") == 1, F.lit("core")).otherwise(F.lit("surface")).alias("variant_layer"), F.col("l_discount").alias("metric"))


# --- the same in SQL ---------------------------------------------------------------------------------


_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g'))"


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '_', 'g'), '_')"


def mkey(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def akey(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\x{{4E00}}-\\x{{9FFF}}]+', ' ', 'g'))"


def ukey(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


QA_SQL = f"SELECT DISTINCT {', '.join(QA)}, answer_aliases FROM qa_variant"

GEN_SQL = """
WITH fl AS (SELECT DISTINCT cache_id, lower(trim(target_language)) AS language, attempt_history AS h FROM attempt_cache),
it AS (SELECT cache_id, language, unnest(range(len(h))) AS item_pos, unnest(h) AS it FROM fl WHERE len(h) > 0),
att AS (SELECT cache_id, language, item_pos, it.source_qa_id AS qa_id, unnest(range(len(it.attempts))) AS attempt_pos, unnest(it.attempts) AS a FROM it WHERE len(it.attempts) > 0),
ag AS (SELECT DISTINCT cache_id, item_pos, attempt_pos, language, qa_id, a.backtranslation_en.expected_answer AS generation FROM att),
qv AS (SELECT DISTINCT qa_id, knowledge_pair_id, pair_id, topic_role, variant_layer, relation_type, dataset_family, culture_origin, expected_answer FROM qa_variant),
gen AS (SELECT ag.*, qv.* EXCLUDE (qa_id), CASE WHEN regexp_replace(coalesce(generation, ''), '^\\s+|\\s+$', '', 'g') = regexp_replace(coalesce(expected_answer, ''), '^\\s+|\\s+$', '', 'g') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a_exact
 FROM ag JOIN qv USING (qa_id))
"""
ORD_SQL = """
WITH ln AS (SELECT l_orderkey, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem),
q AS (SELECT l_orderkey AS knowledge_pair_id, o_orderpriority AS language, o_orderstatus AS topic_role, CASE WHEN rn = 1 THEN 'core' ELSE 'surface' END AS variant_layer, l_discount AS metric
 FROM ln JOIN orders ON l_orderkey = o_orderkey WHERE rn <= 4)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded at the sink, so that sums of another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


