"""Deeply nested records as related flat tables, routed by structural variant.

A bottom-up tree automaton runs over each value: a leaf's state says null or value, a struct's state is
made of its children's states, an array's of the set of its elements' states. The states are built as
one Column expression, so classifying costs no Python and no shuffle. Each attempt is routed by its
state to the typed subtype table of its variant; keys that all variants share stand in the supertype
table, and every row carries its parent's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyquarry.session import broadcast_if_small, cut

#: The members whose presence makes the variant of an attempt, in natural order.
MEMBERS = ["translation", "backtranslation_en", "consistency"]


def shape(value: Column, kind: T.DataType, depth: int = 99) -> Column:
    """The automaton's state of ``value``: ``n`` null, ``v`` leaf value, ``[]`` empty array,
    ``[s|t]`` array with elements in the states s and t, ``{field:state,...}`` struct.
    Below ``depth`` levels only presence is told apart."""
    present = F.lit("v")
    if depth > 0 and isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}:"), shape(value[f.name], f.dataType, depth - 1)) for f in kind.fields]
        present = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif depth > 0 and isinstance(kind, T.ArrayType):
        states = F.array_sort(F.array_distinct(F.transform(value, lambda x: shape(x, kind.elementType, depth - 1))))
        present = F.concat(F.lit("["), F.concat_ws("|", states), F.lit("]"))
    return F.when(value.isNull(), F.lit("n")).otherwise(present)


def variant(attempt: Column) -> Column:
    """The accepting state of an attempt: the members it holds, joined by ``+``, or ``bare``."""
    held = F.concat_ws("+", *[F.when(attempt[m].isNotNull(), F.lit(m)) for m in MEMBERS])
    return F.when(held == "", F.lit("bare")).otherwise(held)


def levels(cache: DataFrame, *keep: str) -> DataFrame:
    """One row per attempt with ``cache_id, item_pos, attempt_pos, item, attempt``.

    Nothing is lost: a file with null or empty history gives item_pos -1 and attempt_pos -1, an item with
    null or empty attempts attempt_pos -1. Positions are 0-based. Repeated rows stay repeated.
    """
    items = cache.select("cache_id", *keep, F.posexplode_outer("attempt_history").alias("item_pos", "item"))
    items = items.withColumn("item_pos", F.coalesce("item_pos", F.lit(-1)))
    out = items.select("cache_id", *keep, "item_pos", "item", F.posexplode_outer(F.col("item.attempts")).alias("attempt_pos", "attempt"))
    return out.withColumn("attempt_pos", F.coalesce("attempt_pos", F.lit(-1)))


def attempts(cache: DataFrame, *keep: str) -> DataFrame:
    """The real attempts of ``levels``: placeholder rows are left out."""
    return levels(cache, *keep).filter(F.col("attempt_pos") >= 0)


def attempt_keys(cache: DataFrame) -> DataFrame:
    """The supertype keys, each once, with the placeholder rows of empty levels. Of the attempts only
    their numbers go on from the scan, as they tell the lengths (Catalyst prunes fields one array deep, not
    two, so the scan itself reads the attempts whole)."""
    items = cache.select("cache_id", F.posexplode_outer("attempt_history").alias("item_pos", "item"))
    numbers = items.select("cache_id", F.coalesce("item_pos", F.lit(-1)).alias("item_pos"), F.posexplode_outer(F.col("item.attempts.attempt")).alias("attempt_pos", "attempt"))
    return numbers.select("cache_id", "item_pos", F.coalesce("attempt_pos", F.lit(-1)).alias("attempt_pos")).distinct()


def repeated_ids(cache: DataFrame) -> DataFrame:
    """The ids of more than one row, and null; only ids are read and aggregated."""
    ids = cut(cache.groupBy("cache_id").count().filter((F.col("count") > 1) | F.col("cache_id").isNull()).select(F.col("cache_id").alias("__id")))
    return broadcast_if_small(ids, ids.count(), 16)


def once(cache: DataFrame, make: Callable[[DataFrame], DataFrame], keys: list[str], repeated: DataFrame | None = None) -> DataFrame:
    """``make(cache)`` with each key once, though rows of the cache are repeated.

    Only ids are aggregated to tell which are repeated; rows of all other ids pass without a shuffle of
    their texts, and just the rows of repeated ids are de-duplicated by ``keys``. Null ids count as
    repeated.
    """
    repeated = repeated_ids(cache) if repeated is None else repeated
    same = F.col("cache_id").eqNullSafe(F.col("__id"))
    single = make(cache.join(repeated, same, "left_anti"))
    return single.unionByName(make(cache.join(repeated, same, "left_semi")).dropDuplicates(keys))


def flatten(cache: DataFrame) -> dict[str, DataFrame]:
    """attempt_cache as flat tables, each row once also where source rows are repeated.

    files (key cache_id; first_ingested_at and last_ingested_at span the copies), items (cache_id,
    item_pos), attempts (cache_id, item_pos, attempt_pos; ``variant`` and ``shape`` by the automaton),
    aliases (attempt key, origin, alias_pos), and a typed table ``attempts__<variant>`` per structural
    variant. A null alias list gives no alias row; the attempt's ``n_aliases`` is null then, and 0 for an
    empty list, so the two stay apart.
    """
    files = cache.groupBy("cache_id").agg(
        F.min("ingested_at").alias("first_ingested_at"),
        F.max("ingested_at").alias("last_ingested_at"),
        *[F.max(c).alias(c) for c in ("prompt_version", "knowledge_pair_id", "source_language", "target_language", "model_name", "api_base", "generated_at")],
        F.max(F.when(F.col("attempt_history").isNotNull(), F.size("attempt_history"))).alias("n_items"),
    )

    def of_items(c: DataFrame) -> DataFrame:
        exploded = c.select("cache_id", F.posexplode("attempt_history").alias("item_pos", "item"))
        return exploded.select(
            "cache_id", "item_pos", F.col("item.source_qa_id").alias("source_qa_id"),
            F.when(F.col("item.attempts").isNotNull(), F.size("item.attempts")).alias("n_attempts"),
        )

    repeated = repeated_ids(cache)
    items = once(cache, of_items, ["cache_id", "item_pos"], repeated)
    kind = cache.schema["attempt_history"].dataType.elementType["attempts"].dataType.elementType
    a = F.col("attempt")
    flat = once(cache, lambda c: attempts(c).select(
        "cache_id", "item_pos", "attempt_pos", a["attempt"].alias("attempt"),
        variant(a).alias("variant"), shape(a, kind).alias("shape"),
        a["translation"]["question"].alias("question"), a["translation"]["expected_answer"].alias("expected_answer"),
        a["translation"]["translation_note"].alias("translation_note"),
        F.when(a["translation"]["answer_aliases"].isNotNull(), F.size(a["translation"]["answer_aliases"])).alias("n_aliases"),
        a["backtranslation_en"]["source_qa_id"].alias("back_source_qa_id"),
        a["backtranslation_en"]["question"].alias("back_question"), a["backtranslation_en"]["expected_answer"].alias("back_expected_answer"),
        F.when(a["backtranslation_en"]["answer_aliases"].isNotNull(), F.size(a["backtranslation_en"]["answer_aliases"])).alias("n_back_aliases"),
        *[a["consistency"][f].alias(f) for f in ("verdict", "is_consistent", "failure_type", "reason", "repair_instruction")],
    ), ["cache_id", "item_pos", "attempt_pos"], repeated)
    lists = F.array(
        F.struct(F.lit("translation").alias("origin"), a["translation"]["answer_aliases"].alias("names")),
        F.struct(F.lit("backtranslation_en").alias("origin"), a["backtranslation_en"]["answer_aliases"].alias("names")),
    )
    aliases = once(cache, lambda c: attempts(c).select("cache_id", "item_pos", "attempt_pos", F.explode(lists).alias("l")).select(
        "cache_id", "item_pos", "attempt_pos", F.col("l.origin").alias("origin"), F.posexplode("l.names").alias("alias_pos", "alias")
    ), ["cache_id", "item_pos", "attempt_pos", "origin", "alias_pos"], repeated)
    out = {"files": files, "items": items, "attempts": flat.select("cache_id", "item_pos", "attempt_pos", "attempt", "variant", "shape", "question", "back_question", "verdict", "n_aliases", "n_back_aliases"), "aliases": aliases}
    typed = {
        "translation": ["question", "expected_answer", "translation_note", "n_aliases"],
        "backtranslation_en": ["back_source_qa_id", "back_question", "back_expected_answer", "n_back_aliases"],
        "consistency": ["verdict", "is_consistent", "failure_type", "reason", "repair_instruction"],
    }
    for mask in range(1 << len(MEMBERS)):
        held = [m for i, m in enumerate(MEMBERS) if mask >> i & 1]
        name = "+".join(held) or "bare"
        out[f"attempts__{name}"] = flat.filter(F.col("variant") == name).select(
            "cache_id", "item_pos", "attempt_pos", "attempt", *[c for m in held for c in typed[m]]
        )
    return out
