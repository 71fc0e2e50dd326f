"""Card inventories: reshaping, sequential de-duplication, id minting, merging and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.functions import text as tx
from polyquarry.operators.ordering import first_per, first_wins

REQUIRED = ["relation_type", "semantic_slot", "fact_statement", "answer", "answer_type", "section_title", "source_span"]


def unnest_roles(pairs: DataFrame, list_field: str = "knowledge_cards") -> DataFrame:
    """Pairs with structs ``target`` and ``neighbor`` that hold a list, as rows pair_id, topic_role, pos
    and the card's fields. Null structs and lists give no row."""
    roles = F.array(*[F.struct(F.lit(r).alias("topic_role"), F.col(r)[list_field].alias("cards")) for r in ("target", "neighbor")])
    return pairs.select("pair_id", F.explode(roles).alias("r")).select("pair_id", "r.topic_role", F.posexplode("r.cards").alias("pos", "card")).select("pair_id", "topic_role", "pos", "card.*")


def nest_roles(cards: DataFrame, *fields: str) -> DataFrame:
    """The inverse: one row per pair_id with the cards of both roles as arrays in order of ``pos``."""
    item = F.struct("pos", *fields)
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("topic_role") == r, item))), lambda x: F.struct(*[x[f] for f in fields])).alias(f"{r}_cards") for r in ("target", "neighbor")]
    return cards.groupBy("pair_id").agg(*lists)


def normalized(cards: DataFrame) -> DataFrame:
    """Cards with normal forms: slugs of relation and answer type, collapsed white space, priority in
    high, medium, low (else medium), aliases cleaned (the topic's name where none is left), and
    ``missing``: the required fields that are blank."""
    c = cards
    for f in REQUIRED:
        c = c.withColumn(f, tx.normalize_ws(F.col(f)))
    # blank relations and types stay blank: they are missing, whatever the slug of nothing is
    for f in ("relation_type", "answer_type"):
        c = c.withColumn(f, tx.slug(F.col(f)))
    p = F.lower(tx.normalize_ws(F.col("eval_priority")))
    c = c.withColumn("eval_priority", F.when(p.isin("high", "medium", "low"), p).otherwise(F.lit("medium")))
    a = tx.clean_aliases(F.col("aliases"))
    c = c.withColumn("aliases", F.when(F.size(a) > 0, a).otherwise(F.array(tx.normalize_ws(F.col("topic_name")))))
    return c.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f) == "", F.lit(f)) for f in REQUIRED])))


def dedup_sequential(cards: DataFrame, group: list[str], order: str) -> DataFrame:
    """First wins on (relation, type, answer), then on the fact among the survivors: a card dropped by
    the first rule doesn't reserve its fact. ``order`` is unique over all rows."""
    sig = F.concat_ws("\u0001", *group, tx.slug(F.col("relation_type"), "card"), tx.slug(F.col("answer_type"), "card"), F.lower(tx.normalize_ws(F.col("answer"))))
    fact = F.concat_ws("\u0001", *group, F.lower(tx.normalize_ws(F.col("fact_statement"))))
    keyed = cards.withColumn("__sig", F.sha2(sig, 256)).withColumn("__fact", F.sha2(fact, 256))
    return first_wins(keyed, ["__sig", "__fact"], order, group).drop("__sig", "__fact")


def merge_cards(old: DataFrame, new: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """Old and new cards, first wins on (relation, lower answer) per group, old ones first."""
    both = old.withColumn("origin", F.lit(0)).unionByName(new.withColumn("origin", F.lit(1)))
    both = both.withColumn("__r", tx.slug(F.col("relation_type"), "card")).withColumn("__a", F.lower(tx.normalize_ws(F.col("answer"))))
    return first_per(both, [*group, "__r", "__a"], F.col("origin"), *order).drop("__r", "__a")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key ``new`` lacks; the columns of ``old``."""
    return new.select(*old.columns).unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns))


def in_source_order(rows: DataFrame, source: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``rows`` with their source's place; rows that the source lacks come behind it (place 10^9)."""
    return rows.join(source.select(key, pos).dropDuplicates([key]), key, "left").withColumn(pos, F.coalesce(pos, F.lit(1_000_000_000)))


def mint_ids(cards: DataFrame) -> DataFrame:
    """``minted_id``: slug of the card id under the prefix of pair and role, made unique per pair in order of
    role (target first) and pos: a card whose id is taken takes the first free one of _02, _03, ... behind it.

    Ids can only clash within one root (the id without closing numbers). Roots with a single id are numbered
    by their rank; roots with several are gone through in order, root by root.
    """
    base = tx.slug(F.coalesce(F.nullif(tx.normalize_ws(F.col("card_id")), F.lit("")), F.format_string("card_%03d", F.col("pos") + 1)), "card")
    prefix = F.concat(tx.slug(F.col("pair_id"), "card"), F.lit("_"), F.col("topic_role"), F.lit("_"))
    c = cards.withColumn("__base", F.when(F.startswith(base, prefix), base).otherwise(F.concat(prefix, base)))
    c = c.withColumn("__root", F.regexp_replace("__base", r"(_[0-9]+)+$", "")).withColumn("__role", F.when(F.col("topic_role") == "target", 0).otherwise(1))
    # of roots with several ids only those matter of which one id is another with a number behind it
    ids = c.groupBy("pair_id", "__root", "__base").agg(F.count(F.lit(1)).alias("__n"))
    pair = lambda df, p: df.select(F.col("pair_id").alias(f"{p}p"), F.col("__root").alias(f"{p}r"), F.col("__base").alias(f"{p}b"), F.col("__n").alias(f"{p}n"))
    longer = pair(ids.filter(F.col("__base").rlike("_[0-9]{2,}$")), "l").withColumn("of", F.regexp_replace("lb", "_[0-9]{2,}$", ""))
    clash = longer.join(pair(ids.filter("__n > 1"), "s"), (F.col("lp") == F.col("sp")) & (F.col("of") == F.col("sb"))).select(F.col("lp").alias("pair_id"), F.col("lr").alias("__root")).distinct()
    free = c.join(clash, ["pair_id", "__root"], "left_anti")
    n = F.row_number().over(Window.partitionBy("pair_id", "__base").orderBy("__role", "pos"))
    numbered = free.withColumn("minted_id", F.when(n == 1, F.col("__base")).otherwise(F.concat("__base", F.format_string("_%02d", n))))
    own = c.join(clash, ["pair_id", "__root"], "left_semi").select(*c.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = None, set()
        for f in frames:
            out = []
            for p, r, b in zip(f["pair_id"], f["__root"], f["__base"]):
                if (p, r) != last:
                    last, seen = (p, r), set()
                name, k = b, 2
                while name in seen:
                    name, k = f"{b}_{k:02d}", k + 1
                seen.add(name)
                out.append(name)
            yield f.assign(minted_id=out)

    kind = f"{own.schema.simpleString()[7:-1].replace(':', ' ')}, minted_id string"
    stepped = own.repartition("pair_id", "__root").sortWithinPartitions("pair_id", "__root", "__role", "pos").mapInPandas(run, kind)
    return numbered.select(*cards.columns, "minted_id").unionByName(stepped.select(*cards.columns, "minted_id"))


def accept_variants(variants: DataFrame, group: list[str], order: str, surface: int = 3) -> DataFrame:
    """Variants of a group accepted in order: English only, at most one core and ``surface`` surface
    forms, no question twice. A question that repeats one accepted before doesn't count as a form.

    Questions of one layer compete only among themselves and with accepted ones of the other layer; the
    first occurrence of each question per group is kept, then ranks per layer decide. A question whose
    first occurrence lies beyond its layer's limit can still be accepted in the other layer.
    """
    lang, layer = F.lower(tx.normalize_ws(F.coalesce(F.col("language"), F.lit("en")))), F.lower(tx.normalize_ws(F.col("variant_layer")))
    v = variants.withColumn("__layer", layer).withColumn("__q", F.lower(tx.normalize_ws(F.col("question")))).filter((lang == "en") & (F.col("__q") != "") & F.col("__layer").isin("core", "surface"))
    v = first_per(v, [*group, "__layer", "__q"], F.col(order))
    limit = F.when(F.col("__layer") == "core", 1).otherwise(surface)
    # of each layer no more than its limit plus the other's can matter
    v = v.withColumn("__n", F.row_number().over(Window.partitionBy(*group, "__layer").orderBy(order))).filter(F.col("__n") <= limit + surface + 1)

    names = list(variants.columns)

    def accept(g: pd.DataFrame) -> pd.DataFrame:
        left, seen, keep = {"core": 1, "surface": surface}, set(), []
        for at in g.sort_values(order).index:
            kind, q = g.at[at, "__layer"], g.at[at, "__q"]
            if left[kind] and q not in seen:
                left[kind] -= 1
                seen.add(q)
                keep.append(at)
        return g.loc[keep, names]

    return v.groupBy(*group).applyInPandas(accept, variants.schema)


def variant_outcomes(variants: DataFrame, group: list[str], order: str, surface: int = 3) -> DataFrame:
    """Every variant with ``outcome``: ``accepted``, or why not: ``invalid language``, ``invalid layer``,
    ``missing question``, ``duplicate question`` (one accepted before asks the same), ``extra core`` or
    ``extra surface``."""
    key = F.lower(tx.normalize_ws(F.col("question")))
    accepted = accept_variants(variants, group, order, surface)
    mine = accepted.select(F.col(order).alias("__mine"), F.lit(True).alias("__in"))
    asked = accepted.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], key.alias("__q"), F.col(order).alias("__at")).groupBy(*[f"__g{i}" for i in range(len(group))], "__q").agg(F.min("__at").alias("__at"))
    same = key == F.col("__q")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    lang, layer = F.lower(tx.normalize_ws(F.coalesce(F.col("language"), F.lit("en")))), F.lower(tx.normalize_ws(F.col("variant_layer")))
    outcome = (
        F.when(F.col("__in"), F.lit("accepted")).when(lang != "en", F.lit("invalid language")).when(~layer.isin("core", "surface"), F.lit("invalid layer")).when(key == "", F.lit("missing question"))
        .when(F.col("__at") < F.col(order), F.lit("duplicate question")).otherwise(F.concat(F.lit("extra "), layer))
    )
    v = variants.join(mine, F.col(order) == F.col("__mine"), "left").join(asked, same, "left")
    return v.select(*variants.columns, outcome.alias("outcome"))


def budget_batches(items: DataFrame, order: str, size: str, most_items: int, most_size: int, shard: str) -> DataFrame:
    """Greedy batches in order within each ``shard``: a batch closes before an item that would exceed
    ``most_items`` or ``most_size``. Adds ``batch`` (per shard, from 0). The running reset depends on the
    order, so each shard is streamed once in sorted Arrow batches; shards run in parallel. An item larger
    than ``most_size`` makes a batch of its own."""
    out = f"{items.schema.simpleString()[7:-1].replace(':', ' ')}, batch int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, batch, n, total = None, 0, 0, 0
        for f in frames:
            numbers = []
            for key, s in zip(f[shard], f[size]):
                s = 0 if s is None or s != s else int(s)
                if key != last:
                    last, batch, n, total = key, 0, 0, 0
                elif n and (n + 1 > most_items or total + s > most_size):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + s
                numbers.append(batch)
            yield f.assign(batch=pd.Series(numbers, index=f.index, dtype="int32"))

    return items.repartition(F.col(shard)).sortWithinPartitions(shard, order).mapInPandas(run, out)
