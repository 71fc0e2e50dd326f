"""Sorted-run consolidation of tiny record files.

The bodies of many tiny files are decoded where they lie, batch by batch, into records sorted by their
key (the runs), which are written once to the shared folder: bodies are decoded once, and both the borders
of the key ranges and the exchange read the written runs. Every range is merged in key order by Spark's
external sorter: its in-memory sort takes sorted stretches as runs and merges them, what it spills are sorted
runs that it merges k ways. A streaming pass over each range keeps one record per key (or all copies, on
request) and rolls the output over to the next file by bytes. Range metadata (least and greatest key,
records, bytes) are kept per output file.

One shuffle moves every record once. Unless copies are kept, those inside a batch are dropped before it, so a
record repeated in a third of all files leaves one copy per batch, not one per file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.session import cut, spread

KEY = ["source_qa_id", "target_language", "attempt"]
RECORD = "source_qa_id string, target_language string, attempt long, payload string, whole int, written_at timestamp, n_bytes long"
OUTPUT = "source_qa_id string, target_language string, attempt long, payload string, n_bytes long, out_file string"
TARGET_BYTES = 64 << 20
#: Ranges of the exchange; beyond so many files' worth of data a range is rolled into several files.
MOST_RANGES = 8192

_DECODER = json.JSONDecoder()
_OPEN = re.compile(r"[{\[]")
_LINE = re.compile(r"\n\s*[{\[]")


def _walk(value: object) -> Iterator[dict]:
    """The record objects inside a decoded value, however lists and wrappers nest."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if all(k in v for k in KEY):
                yield v
            else:
                stack.extend(reversed([x for x in v.values() if isinstance(x, (dict, list))]))
        elif isinstance(v, list):
            stack.extend(reversed([x for x in v if isinstance(x, (dict, list))]))


def records_of(body: str | None) -> list[dict]:
    """The records that can be read in full from one body.

    JSON lines, arrays, pretty-printed or concatenated objects, byte-order marks and blank lines are
    taken as they come. After a piece that can't be decoded, reading goes on at the next line or where decoding failed, so a
    cut-off record costs neither those before nor those after it. None and blank bodies give nothing.
    A record needs a non-blank source_qa_id, a target_language string and a whole-number attempt.
    """
    out: list[dict] = []
    if not body:
        return out
    at = 0
    while m := _OPEN.search(body, at):
        start = m.start()
        try:
            value, at = _DECODER.raw_decode(body, start)
        except json.JSONDecodeError as e:
            # an array that breaks off still holds whole objects: step inside it; a record that breaks off
            # may have swallowed the next line, so go on there
            line = _LINE.search(body, start + 1, e.pos) if body[start] == "{" else None
            at = start + 1 if body[start] == "[" else line.end() - 1 if line else max(e.pos, start + 1)
            continue
        except RecursionError:
            at = start + 1
            continue
        out += [
            r
            for r in _walk(value)
            if isinstance(r["source_qa_id"], str)
            and r["source_qa_id"].strip()
            and isinstance(r["target_language"], str)
            and isinstance(r["attempt"], int)
            and not isinstance(r["attempt"], bool)
        ]
    return out


def _decode(keep_copies: bool):
    """Batches of bodies → sorted batches of their records; of the copies of a key the best one stays
    unless ``keep_copies``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple, tuple] = {}
            every: list[tuple[tuple, tuple]] = []
            bodies, times = batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist()
            for body, when in zip(bodies, times):
                for r in records_of(body):
                    key = tuple(r[k] for k in KEY)
                    payload = json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
                    rank = (len(r), when if when is not None else -(1 << 62), payload)
                    if keep_copies:
                        every.append((key, rank))
                    elif key not in best or rank > best[key]:
                        best[key] = rank
            yield _run(sorted(every if keep_copies else best.items()))

    return run


def _run(rows: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
    columns = [
        *([k[i] for k, _ in rows] for i in range(len(KEY))),
        [v[2] for _, v in rows],
        [v[0] for _, v in rows],
        [v[1] if v[1] > -(1 << 62) else None for _, v in rows],
        [len(v[2].encode("utf-8", "surrogatepass")) + 1 for _, v in rows],
    ]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    arrays = [pa.array([x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in c], t) for c, t in zip(columns, types)]
    arrays[5] = arrays[5].cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in RECORD.split(", ")])


def _merge(target: int, keep_copies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        last, size, seq = None, 0, 0
        for batch in batches:
            q, t, a, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*KEY, "n_bytes"))
            keep, files = [], []
            for i, key in enumerate(zip(q, t, a)):
                if key == last and not keep_copies:
                    continue
                # copies of one key stay in one file, so that the files' key ranges never overlap
                if size + n[i] > target and size and key != last:
                    seq, size = seq + 1, 0
                last = key
                size += n[i]
                keep.append(i)
                files.append(f"part-{part:05d}-{seq:04d}")
            if keep:
                kept = batch.take(pa.array(keep, pa.int64())).select([*KEY, "payload", "n_bytes"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(files, pa.string())], [*KEY, "payload", "n_bytes", "out_file"])

    return run


def decode_records(files: DataFrame, body: str = "body", written_at: str = "written_at", keep_copies: bool = False) -> DataFrame:
    """Sorted runs: one row per record and Arrow batch (one per copy with ``keep_copies``), in key order
    within the batch."""
    rows = files.select(F.col(body).alias("body"), F.col(written_at).cast("timestamp").alias("written_at")).filter(F.col("body").isNotNull())
    return spread(rows).mapInArrow(_decode(keep_copies), RECORD)


def merge_runs(runs: DataFrame, total_bytes: int, target_bytes: int = TARGET_BYTES, keep_copies: bool = False) -> DataFrame:
    """Sorted runs (written rows of ``decode_records`` or of earlier output) merged per key range and rolled
    by bytes. ``total_bytes`` sets the number of ranges, at most ``MOST_RANGES``."""
    ranges = min(MOST_RANGES, max(1, -(-int(total_bytes) // target_bytes)))
    ranged = runs.repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY, F.desc("whole"), F.desc_nulls_last("written_at"), F.desc("payload"))
    # ranges are sampled, not exact: a range may run half over the target before it is rolled
    return ranged.mapInArrow(_merge(target_bytes * 3 // 2, keep_copies), OUTPUT)


def _bytes(runs: DataFrame) -> int:
    return int(runs.agg(F.sum("n_bytes")).first()[0] or 0)


def consolidate(files: DataFrame, target_bytes: int = TARGET_BYTES, keep_copies: bool = False) -> DataFrame:
    """Records of tiny files as few sorted, evenly sized output files.

    Returns one row per record with ``out_file``; rows of one file are adjacent and in key order, the
    key ranges of files don't overlap. ``keep_copies`` keeps every copy of a repeated record, also of one
    body; otherwise of the copies of a key that with most fields stays, then the latest, then the greatest
    payload. Empty, blank, null and cut-off bodies give no record. Extra columns of the input play no part.
    """
    runs = cut(decode_records(files, keep_copies=keep_copies))
    return merge_runs(runs, _bytes(runs), target_bytes, keep_copies)


def add_files(consolidated: DataFrame, files: DataFrame, target_bytes: int = TARGET_BYTES, keep_copies: bool = False) -> DataFrame:
    """Earlier output and further tiny files as one: the old files are runs like the new ones. With
    ``keep_copies`` no copy of either side is dropped."""
    old = consolidated.select(*KEY, "payload", F.size(F.json_object_keys("payload")).alias("whole"), F.lit(None).cast("timestamp").alias("written_at"), "n_bytes")
    runs = old.unionByName(cut(decode_records(files, keep_copies=keep_copies)))
    return merge_runs(runs, _bytes(runs), target_bytes, keep_copies)


def range_metadata(consolidated: DataFrame) -> DataFrame:
    """One row per output file: records, bytes, least and greatest key."""
    return consolidated.groupBy("out_file").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum("n_bytes").alias("n_bytes"),
        F.min(F.struct(*KEY)).alias("min_key"),
        F.max(F.struct(*KEY)).alias("max_key"),
    )


def write_consolidated(files: DataFrame, path: str, target_bytes: int = TARGET_BYTES, keep_copies: bool = False) -> DataFrame:
    """Write the consolidated files under ``path``/data (one directory per output file, so one writer is
    open at a time and Spark's commit protocol holds) and their range metadata under ``path``/ranges;
    returns the metadata as read back."""
    spark = files.sparkSession
    consolidate(files, target_bytes, keep_copies).write.mode("overwrite").partitionBy("out_file").parquet(f"{path}/data")
    range_metadata(spark.read.parquet(f"{path}/data")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    return spark.read.parquet(f"{path}/ranges")
