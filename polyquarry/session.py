"""Session helpers: table loading, the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size stays under this many bytes.
BROADCAST_LIMIT = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read. The cluster names it in ``spark.checkpoint.dir``; only
    where that is unset (tests on one machine) a folder of our own is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named:
            own = tempfile.mkdtemp(prefix="polyquarry-ckpt-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            named = Path(own).as_uri()
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that backs a result; it is removed when the session's
    program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  (the session is gone: its folder is removed as a whole, or stays)
            pass

    atexit.register(remove)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast when ``rows`` counted rows of about ``row_bytes`` stay under the limit;
    beyond it the frame is returned as it is and Catalyst shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for heavy narrow stages behind a scan
    of few splits. Frames of enough splits, as all large ones are, pass as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= cores else df.repartition(cores)
