"""Texts of varying length in containers of fixed capacity, by optimal length buckets.

Sizes are counted with a public tokenizer; a text longer than the capacity is cut into full pieces and
a rest. The histogram of all sizes (at most one entry per size up to the capacity) is exact and global.
Dynamic programming over it chooses the bucket boundaries that minimise padding; batches under the token
budget are then formed per bucket, largest bucket first, and the space a batch leaves is topped up from
the largest smaller bucket that fits. Batches are planned for whole counts of the histogram, not per
text: the plan has some segments per bucket however many texts there are. Texts take their place in the
plan by their rank within the bucket, from per-partition counts and their running sums: no text is
sorted, and a size that a third of all texts share is split over all partitions.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.session import broadcast_if_small, cut, spread

CAPACITY = 2048
BUCKETS = 128
TOKENIZER = os.environ.get("POLYQUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the published word pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def boundaries(histogram: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding. ``histogram[n]``
    counts items of size n, 0..capacity. Exact dynamic programming over the sizes that occur."""
    sizes = np.flatnonzero(histogram)
    if not len(sizes):
        return []
    counts = histogram[sizes].astype(np.float64)
    n, s = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(counts * sizes)])
    m = len(sizes)
    # cost[i, j]: padding of a bucket that holds the sizes i..j-1
    cost = np.full((m + 1, m + 1), np.inf)
    for j in range(1, m + 1):
        cost[:j, j] = sizes[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
    best, back = cost[0].copy(), []
    for _ in range(min(buckets, m) - 1):
        table = best[:, None] + cost
        choice = table.argmin(axis=0)
        new = table[choice, np.arange(m + 1)]
        keep = best <= new
        back.append(np.where(keep, -1, choice))
        best = np.where(keep, best, new)
    out, j = [], m
    for step in reversed(back):
        if step[j] >= 0:
            out.append(int(sizes[j - 1]))
            j = int(step[j])
    out.append(int(sizes[j - 1]))
    return sorted(out)


@dataclass
class Plan:
    """Segments per bucket: ranks from ``first[k]`` on go ``per[k]`` at a time into containers from
    ``container[k]`` on."""

    bounds: list[int]
    first: list[np.ndarray]
    container: list[np.ndarray]
    per: list[np.ndarray]
    containers: int

    def place(self, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(rank), dtype=np.int64)
        for b in np.unique(bucket):
            at = bucket == b
            r = rank[at]
            k = np.searchsorted(self.first[b], r, side="right") - 1
            out[at] = self.container[b][k] + (r - self.first[b][k]) // self.per[b][k]
        return out


def plan(histogram: np.ndarray, capacity: int = CAPACITY, buckets: int = BUCKETS) -> Plan:
    bounds = boundaries(histogram, buckets)
    edges = [-1, *bounds]
    left = [int(histogram[a + 1 : b + 1].sum()) for a, b in zip(edges, edges[1:])]
    used = [0] * len(bounds)
    segments: list[list[tuple[int, int, int]]] = [[] for _ in bounds]
    container, top = 0, len(bounds) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        space, pattern = capacity, {}
        for b in range(top, -1, -1):
            k = min(space // max(1, bounds[b]), left[b])
            if k:
                pattern[b] = k
                space -= k * bounds[b]
        times = min(left[b] // k for b, k in pattern.items())
        for b, k in pattern.items():
            segments[b].append((used[b], container, k))
            used[b] += times * k
            left[b] -= times * k
        container += times
    column = lambda i: [np.array([s[i] for s in seg] or [0], dtype=np.int64) for seg in segments]
    return Plan(bounds, column(0), column(1), column(2), container)


def sized(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece (0-based), n_pieces, n_tokens: every text in pieces of at most ``capacity``. Null
    texts have no piece; an empty text is one piece of 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(tokenizer)
        for b in batches:
            n = [len(e.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            rows = [(i, p, max(1, -(-k // capacity)), min(capacity, k - p * capacity)) for i, k in zip(b.column(0).to_pylist(), n) for p in range(max(1, -(-k // capacity)))]
            ids, pieces, many, sizes = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *(pa.array(c, pa.int32()) for c in (pieces, many, sizes))], ["doc_id", "piece", "n_pieces", "n_tokens"])

    texts = spread(documents.select("doc_id", "text").filter(F.col("text").isNotNull()))
    return texts.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, piece int, n_pieces int, n_tokens int")


def pack_sizes(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` (with n_tokens of 0..capacity) with container_id, each row once. Pieces of 0 tokens count
    as 1, so that no container holds more than ``capacity`` of them. An empty frame stays empty."""
    pieces = cut(pieces)  # fixes the partitions that the ranks count over
    room = F.greatest(F.col("n_tokens"), F.lit(1))
    counts = {r[0]: r[1] for r in pieces.groupBy(room.alias("n")).count().collect()}  # at most one row per size
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in counts.items():
        histogram[n] = k
    p = plan(histogram, capacity, buckets)
    edges = np.array(p.bounds, dtype=np.int64)
    names = pieces.columns
    schema = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(len(edges) + 1, dtype=np.int64)
        for b in batches:
            n = np.maximum(b.column(names.index("n_tokens")).to_numpy(zero_copy_only=False), 1)
            bucket = np.searchsorted(edges, n)
            order = np.argsort(bucket, kind="stable")
            starts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1] if len(order) else np.array([], dtype=np.int64)
            rank = np.empty(len(bucket), dtype=np.int64)
            for s, e in zip(starts, [*starts[1:], len(order)]):
                at = order[s:e]
                rank[at] = seen[bucket[at[0]]] + np.arange(e - s)
                seen[bucket[at[0]]] += e - s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part), pa.int32()), pa.array(bucket, pa.int32()), pa.array(rank)], [*names, "__part", "__bucket", "__rank"])

    rows = pieces.mapInArrow(ranked, f"{schema}, __part int, __bucket int, __rank long")
    before = Window.partitionBy("__bucket").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = rows.groupBy("__part", "__bucket").agg(F.count(F.lit(1)).alias("n")).select("__part", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(broadcast_if_small(per_part, pieces.rdd.getNumPartitions() * max(1, len(edges))), ["__part", "__bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            at = p.place(get("__bucket"), get("__rank") + get("__before"))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(at, pa.int64())], [*names, "container_id"])

    return rows.mapInArrow(place, f"{schema}, container_id long")


def pack(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, n_pieces, n_tokens, container_id of every text."""
    return pack_sizes(sized(documents, capacity, tokenizer), capacity, buckets)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, pieces, tokens, the fullest container and the share of the capacity in use."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("used"))
