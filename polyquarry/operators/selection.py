"""Quota selection with overflow, shortfalls, sampling and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.operators.ordering import hash_key, positional_index, smallest_k, top_per


def quota_overflow(rows: DataFrame, topic: str, order: list[Column], fill_order: list[Column], total: int, per_topic: int, topics: int, strict: bool = False) -> DataFrame:
    """At most min(per_topic, total // topics) rows per topic by ``order``, then further rows in rounds
    until ``total``: each round offers every topic's next row, sorted by ``fill_order``.

    No loop: the round of a row is its rank beyond the quota, so overflow rows are the first of (round,
    fill_order). Adds ``rank`` and ``picked_as`` (``base`` or ``overflow``). Fewer rows than ``total``
    give all of them (``shortfall`` tells), or are an error where ``strict``.
    """
    if strict:
        _enough(rows, total)
    quota = min(per_topic, total // max(1, topics))
    ranked = top_per(rows, [topic], quota + max(0, total), *order)
    base = ranked.filter(F.col("rank") <= quota).withColumn("picked_as", F.lit("base"))
    rest = total - base.count()
    if rest <= 0:
        return base
    over = ranked.filter(F.col("rank") > quota).orderBy(F.col("rank"), *fill_order).limit(rest).withColumn("picked_as", F.lit("overflow"))
    return base.unionByName(over)


def _enough(rows: DataFrame, wanted: int) -> None:
    have = rows.count()
    if have < wanted:
        raise ValueError(f"{wanted} rows wanted, {have} there")


def shortfall(rows: DataFrame, topic: str, wanted: int) -> DataFrame:
    """Topics with fewer than ``wanted`` rows, and how many lack."""
    return rows.groupBy(topic).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") < wanted).withColumn("lacking", F.lit(wanted) - F.col("n_rows"))


def selected_stats(rows: DataFrame, chosen: Column, score: str = "score") -> DataFrame:
    """Selected count, least, greatest and mean selected score, and the best score left out."""
    pick = F.when(chosen, F.col(score))
    return rows.agg(
        F.count(pick).alias("n_selected"), F.min(pick).alias("min_score"), F.max(pick).alias("max_score"),
        F.avg(pick).alias("mean_score"), F.max(F.when(~chosen, F.col(score))).alias("best_left"),
    )


def hash_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """A reproducible uniform sample of ``n`` rows without replacement (all, where there are fewer)."""
    return smallest_k(rows.withColumn("__h", hash_key(F.col(key), seed=seed)), "__h", n).drop("__h")


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, strata: int, seed: str, strict: bool = False) -> DataFrame:
    """``size // strata`` rows per stratum by hash, topped up by hash from the rest to exactly ``size``
    where there are enough rows; too few are an error where ``strict``."""
    if strict:
        _enough(rows, size)
    quota = size // max(1, strata)
    h = rows.withColumn("__h", hash_key(F.col(key), seed=seed))
    ranked = top_per(h, [stratum], quota + size, F.col("__h"), F.col(key), name="__rank")
    base = ranked.filter(F.col("__rank") <= quota)
    more = size - base.count()
    rest = ranked.filter(F.col("__rank") > quota).orderBy("__h", key).limit(max(0, more))
    return base.unionByName(rest).drop("__h", "__rank")


def half_mixture(keys: DataFrame, key: str, seed: str) -> DataFrame:
    """Each distinct key with ``language_side``: ``en`` for floor(n/2) of them by hash, else ``source``."""
    distinct = keys.select(key).distinct().withColumn("__h", hash_key(F.col(key), seed=seed))
    n = distinct.count()
    english = smallest_k(distinct, "__h", n // 2).select(key).withColumn("__en", F.lit(True))
    return distinct.join(english, key, "left").select(key, F.when(F.col("__en"), F.lit("en")).otherwise(F.lit("source")).alias("language_side"))


def random_partner(anchors: DataFrame, partners: DataFrame, anchor: str, partner: str, seed: str) -> DataFrame:
    """Each anchor with one partner drawn with replacement, reproducibly. ``partners``: ``partner`` and
    ``position`` (0-based, dense)."""
    n = partners.count()
    if not n:
        return anchors.select(anchor).withColumn(partner, F.lit(None).cast(dict(partners.dtypes)[partner]))
    draw = F.pmod(F.conv(F.substring(hash_key(F.col(anchor), seed=seed), 1, 12), 16, 10).cast("long"), F.lit(n))
    return anchors.withColumn("position", draw).join(partners.select(partner, "position"), "position", "left").select(anchor, partner)


def reissue_ids(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Six-digit running ids from 1 in the given (total) order."""
    placed = positional_index(rows, *order, name="__i")
    return placed.withColumn("sample_id", F.concat(F.lit(prefix), F.format_string("%06d", F.col("__i") + 1))).drop("__i")


def anchored(forget: DataFrame, retain: DataFrame, anchor: str, seed: str) -> DataFrame:
    """Training rows: each row of the anchor side (``forget`` or ``retain``) with one of the other side drawn
    with replacement. Both frames have ``id``; the drawn one's stands in ``partner``."""
    side, other = (forget, retain) if anchor == "forget" else (retain, forget)
    dense = positional_index(other.select(F.col("id").alias("partner")), "partner", name="position")
    return random_partner(side, dense, "id", "partner", seed).withColumn("anchor", F.lit(anchor))
