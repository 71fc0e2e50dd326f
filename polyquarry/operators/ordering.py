"""Positions, smallest-k and first-wins selection without a global sort in one task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.session import cut


def positional_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """``df`` with 0-based positions in the given order. Rows are range-partitioned and sorted where
    they lie; positions are partition offsets (one row per partition) plus the place inside. Ties are
    broken by nothing: give a total order. An empty frame stays empty."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__id", "__part", "__at", "__before")


def hash_key(*columns: Column, seed: str = "") -> Column:
    """A reproducible pseudo-random order: the MD5 of the columns and a seed, as hex."""
    return F.md5(F.concat_ws("|", *columns, F.lit(seed)))


#: Rows of the border group that are small enough to be sorted at once.
BORDER_ROWS = 50_000


def smallest_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the smallest hex ``key``. Counts per prefix (at most 65,536 rows) tell the prefix
    that holds the k-th row; that prefix is made longer until few rows share it, which are sorted. Of a
    group of equal keys across the border, rows are taken in no stated order."""
    rest, width, border = k, 4, F.lit(True)
    below = df.limit(0)
    while True:
        prefix = F.substring(F.col(key), 1, width)
        inside = df.filter(border)
        counts = sorted((r[0] or "", r[1]) for r in inside.groupBy(prefix).count().collect())
        seen, at, size = 0, None, 0
        for p, n in counts:
            if seen + n > rest:
                at, size = p, n
                break
            seen += n
        if at is None:  # only where fewer rows than k are there
            return below.unionByName(inside)
        below = below.unionByName(inside.filter(F.coalesce(prefix, F.lit("")) < at))
        rest, border = rest - seen, F.coalesce(prefix, F.lit("")) == at
        if size <= BORDER_ROWS or width > 64:
            return below.unionByName(df.filter(border).orderBy(key).limit(rest)) if rest else below
        width += 4


def first_wins(df: DataFrame, keys: list[str], order: str, within: list[str] | None = None, rounds: int = 8) -> DataFrame:
    """The rows that a sequential pass in ``order`` keeps when a row is dropped as soon as any of its
    ``keys`` was seen on a row kept before (a dropped row reserves none of its keys).

    Exactly the loop's result, in rounds: a row that comes first among the undecided rows of each of its
    keys is kept, and rows that share a key with a kept row are dropped. Each round pre-aggregates the
    least order per key; rounds follow the longest chain of dependencies, not the number of rows. Where rows
    of different ``within`` never share a key, chains longer than ``rounds`` are finished by one sorted pass
    over the undecided rows of each group; else the rounds go on to the end. ``order`` must be unique; null
    keys are values like others.
    """
    open_rows, kept, done = cut(df), None, 0
    while True:
        marked = open_rows
        for i, k in enumerate(keys):
            least = open_rows.groupBy(F.col(k).alias(f"__k{i}")).agg(F.min(order).alias(f"__first{i}"))
            marked = marked.join(least, F.col(k).eqNullSafe(F.col(f"__k{i}"))).drop(f"__k{i}")
        first = reduce(lambda a, b: a & b, [F.col(order) == F.col(f"__first{i}") for i in range(len(keys))])
        winners = cut(marked.filter(first).select(*df.columns))
        kept = winners if kept is None else kept.unionByName(winners)
        rest = open_rows
        for i, k in enumerate(keys):
            taken = winners.select(F.col(k).alias(f"__t{i}")).distinct()
            rest = rest.join(taken, F.col(k).eqNullSafe(F.col(f"__t{i}")), "left_anti")
        open_rows, done = cut(rest), done + 1
        if open_rows.isEmpty():
            return kept
        if within and done >= rounds:
            return kept.unionByName(_in_order(open_rows, keys, order, within))


def _in_order(rows: DataFrame, keys: list[str], order: str, within: list[str]) -> DataFrame:
    """The loop itself over rows that hold no key of a row kept before, group by group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, seen = None, [set() for _ in keys]
        for f in frames:
            keep = []
            for g, *values in zip(zip(*(f[c] for c in within)), *(f[k] for k in keys)):
                if g != group:
                    group, seen = g, [set() for _ in keys]
                new = all(v not in s for v, s in zip(values, seen))
                keep.append(new)
                if new:
                    for v, s in zip(values, seen):
                        s.add(v)
            yield f[keep]

    return rows.repartition(*within).sortWithinPartitions(*within, order).mapInPandas(run, rows.schema)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in the given order (the group's copies are cut inside each task first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == 1).drop("__n")


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their 1-based rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
