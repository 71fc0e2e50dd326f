"""Append-only journals and resumable scoring as streams.

A journal is a folder of JSON lines that a file sink appends to; its checkpoint makes commits exactly
once. A resumed run scores only rows the journal lacks, under the same protocol hash; another hash is an
error. A journal written by a plain process may end in a cut-off line, which is taken off; a malformed
line elsewhere is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polyquarry.functions.udfs import canonical_json


def protocol_hash(protocol: dict) -> str:
    return hashlib.sha256(canonical_json(protocol).encode()).hexdigest()


def recover(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a one-file journal. Only the last line may be malformed; it is left out."""
    from polyquarry.sources.files import read_lines

    rows = read_lines(spark, path, schema)
    last = rows.groupBy("file").agg(F.max("line").alias("last"))
    marked = rows.join(last, "file")
    told = F.concat(F.lit("malformed line "), F.col("line").cast("string"), F.lit(" before the end of "), F.col("file"))
    ok = F.when(F.col("bad").isNull(), F.lit(True)).when(F.col("line") == F.col("last"), F.lit(False)).otherwise(F.raise_error(told).cast("boolean"))
    return marked.filter(ok).drop("bad", "last")


def pending(inputs: DataFrame, journal: DataFrame, key: str, protocol: str) -> DataFrame:
    """Inputs that the journal lacks. Fails where the journal was written under another protocol."""
    told = F.raise_error(F.lit("the journal was written under another protocol")).cast("boolean")
    done = journal.filter(F.when(F.col("protocol_hash") == protocol, F.lit(True)).otherwise(told)).select(key).distinct()
    return inputs.join(done, key, "left_anti")


def resume(inputs: DataFrame, journal_path: str, key: str, protocol: dict, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score what the journal lacks, append it, and return the whole journal. Calling it again scores
    nothing; a lost run leaves only committed files behind."""
    spark, h = inputs.sparkSession, protocol_hash(protocol)
    try:
        journal = spark.read.parquet(journal_path)
        todo = pending(inputs, journal, key, h)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = inputs
    score(todo).withColumn("protocol_hash", F.lit(h)).write.mode("append").parquet(journal_path)
    return spark.read.parquet(journal_path)


def progress(journal: DataFrame, total: int) -> DataFrame:
    """State of a run: complete, complete_with_failures or running, with counts."""
    n = journal.agg(F.count(F.lit(1)).alias("n_done"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    state = F.when(F.col("n_done") < total, F.lit("running")).when(F.col("n_failed") > 0, F.lit("complete_with_failures")).otherwise(F.lit("complete"))
    return n.withColumn("state", state)


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, time: str, late: str = "1 day", width: str = "1 day", *keys: str) -> DataFrame:
    """Counts and means per tumbling window and key; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean_value"))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a second call processes only what is new."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_per_key(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key of a journal of changes."""
    return changes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).filter("__n = 1").drop("__n")
