"""Queries that run as streams or journals; their results equal the batch result over all rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.plans.views import rounded
from polyquarry.session import scratch, table
from polyquarry.sources import connectors
from polyquarry.streaming import journal


def stream_access(spark: SparkSession, d: str) -> DataFrame:
    """Event counts and means per day and type, through a file stream of the table itself, with a
    watermark; in complete mode the open windows of the last days come out as well. State and output stand in
    a folder of the shared one."""
    base = scratch(spark, "stream")
    source = table(spark, d, "events")
    files = source.inputFiles()
    at = os.path.dirname(files[0])
    only = os.path.basename(files[0]) if len(files) == 1 else "*.parquet"
    # wall-clock times as instants of UTC, whatever the session's zone, so that days are theirs
    zone = F.current_timezone()
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", only).parquet(at).withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
    counts = journal.windowed_counts(stream, "ts", "1 day", "1 day", "event_type")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out").select(F.to_utc_timestamp(F.col("w.start"), zone).cast(source.schema["ts"].dataType).alias("day"), "event_type", "n_rows", "mean_value"))


def journal_resume(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the orders' keys, the first over part of them: the journal ends with each once."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority")
    path = scratch(spark, "journal")
    score = lambda df: df.select("id", F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0).alias("score"), F.lit(None).cast("string").alias("error"))
    journal.resume(o.filter("o_orderpriority < '3'"), path, "id", {"metric": "urgent"}, score)
    return journal.resume(o, path, "id", {"metric": "urgent"}, score).groupBy("score").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))


def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers a judge has to see (not equal in NFKC), through the connector with the offline stub."""
    from polyquarry.functions import metrics, udfs
    from polyquarry.plans.views import generations

    g = generations(spark, d).select("cache_id", "item_pos", "attempt_pos", "expected_answer", "generation").distinct()
    g = g.withColumn("match", metrics.judge_or_match(F.col("generation"), F.col("expected_answer"), udfs.nfkc_ws)).filter("match IS NULL AND generation IS NOT NULL")
    g = g.withColumn("id", F.concat_ws(":", "cache_id", "item_pos", "attempt_pos", F.md5("expected_answer")))
    asked = g.withColumn("request", F.to_json(F.struct(F.col("expected_answer").alias("expected"), F.col("generation").alias("candidate"))))
    answers = connectors.enrich(asked, "id", "request", connectors.offline_judge)
    return answers.select("id", connectors.score_column(connectors.message_text_column(F.col("answer"))).alias("score"), "n_attempts")


QUERIES = {f.__name__: f for f in (stream_access, journal_resume, judged_answers)}
ORACLE = {
    "stream_access": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
    "journal_resume": "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids FROM orders GROUP BY 1",
}
