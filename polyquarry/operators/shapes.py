"""Shapes of question documents: pairs and held-out cards, roles, variants, batches and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.functions import text as tx
from polyquarry.operators.ordering import positional_index

VARIANT_KEYS = ["qa_id", "variant_layer", "language", "question", "expected_answer"]


def variants(document: DataFrame) -> DataFrame:
    """One row per variant of a document of either shape: of knowledge pairs (pair_id, knowledge_pair_id,
    relation_type, target_qa_variants, neighbor_qa_variants), or of held-out cards (holdout_card_id,
    source_card_id, source_pair_id, source_topic_role, relation_type, qa_variants). Null and empty lists give
    no row."""
    if "qa_variants" in document.columns:
        v = document.select(
            F.col("source_pair_id").alias("pair_id"), F.col("holdout_card_id").alias("knowledge_pair_id"), "holdout_card_id", "source_card_id", F.col("source_topic_role").alias("topic_role"), "relation_type",
            F.posexplode("qa_variants").alias("pos", "v"),
        )
    else:
        none = F.lit("")
        roles = F.array(*[F.struct(F.lit(r).alias("topic_role"), F.col(f"{r}_qa_variants").alias("variants")) for r in ("target", "neighbor")])
        r = document.select("pair_id", "knowledge_pair_id", "relation_type", F.explode(roles).alias("r"))
        v = r.select("pair_id", "knowledge_pair_id", none.alias("holdout_card_id"), none.alias("source_card_id"), "r.topic_role", "relation_type", F.posexplode("r.variants").alias("pos", "v"))
    return v.select("pair_id", "knowledge_pair_id", "holdout_card_id", "source_card_id", "topic_role", "relation_type", "pos", *[F.col("v")[k].alias(k) for k in VARIANT_KEYS])


def card_of_role(pair: DataFrame, role: str, only_absent: bool = False) -> Column:
    """The card of a role (a struct ``card`` beside topic_name and source_page) with the parent's fields put
    in: over the card's own, or ``only_absent`` where the card has none."""
    side = F.col(role)
    card = side["card"]
    have = [f.name for f in pair.schema[role].dataType["card"].dataType.fields]
    for name in ("topic_name", "source_page"):
        own = card[name] if name in have else F.lit(None).cast("string")
        card = card.withField(name, F.coalesce(own, side[name]) if only_absent else F.coalesce(side[name], own))
    return card


def holdout_as_pairs(cards: DataFrame) -> DataFrame:
    """Held-out cards as knowledge pairs of one side: the card is the target, there is no neighbor, and only
    English variants go along, each with its pair, card, role and relation."""
    english = F.filter(F.coalesce("qa_variants", F.array().cast(cards.schema["qa_variants"].dataType)), lambda v: F.lower(tx.normalize_ws(v["language"])) == "en")
    told = F.transform(english, lambda v: F.struct(
        *[v[k].alias(k) for k in VARIANT_KEYS], v["answer_aliases"].alias("answer_aliases"), F.col("holdout_card_id").alias("knowledge_pair_id"),
        F.col("source_card_id").alias("card_id"), F.lit("target").alias("topic_role"), F.col("relation_type").alias("relation_type"),
    ))
    card = F.struct(F.col("source_card_id").alias("card_id"), *[F.col(c) for c in ("relation_type", "semantic_slot", "fact_statement", "answer", "answer_type", "source_span")])
    target = F.struct(F.col("topic_name"), F.col("topic_type"), F.col("source_page"), F.col("source_url"), card.alias("card"))
    return cards.select(F.col("holdout_card_id").alias("knowledge_pair_id"), F.col("source_pair_id").alias("pair_id"), "topic_type", "relation_type", target.alias("target"), told.alias("target_qa_variants"), F.slice(told, 1, 0).alias("neighbor_qa_variants"))


def pairs_as_holdout(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """Translated pairs put back into their held-out cards: every field of the card but its variants, which
    are the pair's target variants with the card's ids. Cards without a pair have none."""
    p = pairs.select(F.col("knowledge_pair_id").alias("holdout_card_id"), F.col("target_qa_variants").alias("__v"))
    out = cards.drop("qa_variants").join(p, "holdout_card_id", "left")
    ids = lambda v: v.withField("holdout_card_id", F.col("holdout_card_id")).withField("source_card_id", F.col("source_card_id"))
    return out.withColumn("qa_variants", F.coalesce(F.transform("__v", ids), F.array())).drop("__v")


def english_variants(rows: DataFrame, role: str) -> DataFrame:
    """The variants of a role whose language is English in any case and with any blanks."""
    return rows.filter((F.col("topic_role") == role) & (F.lower(tx.normalize_ws(F.col("language"))) == "en"))


def variants_with_cards(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Variants with their card's fact and span; those without a card keep nulls."""
    return rows.join(cards.select("card_id", F.col("fact_statement").alias("card_fact"), F.col("source_span").alias("card_span")).dropDuplicates(["card_id"]), "card_id", "left")


def source_index(rows: DataFrame) -> DataFrame:
    """Variants by id with their 0-based place in their pair: target before neighbor, then as they come."""
    role = F.when(F.col("topic_role") == "target", 0).otherwise(1)
    w = Window.partitionBy("knowledge_pair_id").orderBy(role, "pos", "qa_id")
    return rows.withColumn("source_pos", F.row_number().over(w) - 1)


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows in batches of a fixed size in the given (total) order: ``batch`` and ``at``, both from 0."""
    placed = positional_index(rows, *order, name="__i")
    return placed.withColumn("batch", F.floor(F.col("__i") / size)).withColumn("at", (F.col("__i") % size).cast("int")).drop("__i")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in document order. Fewer rows are all kept."""
    return rows.orderBy(*order).limit(n)


def wanted(rows: DataFrame, key: str, allowed: list[str] | None = None, most: int | None = None, *order: str) -> DataFrame:
    """Rows whose key is allowed (any, where none is named), then the first ``most`` of them in order."""
    rows = rows.filter(F.col(key).isin(allowed)) if allowed else rows
    return rows if most is None else first_n(rows, most, *order)


def first_pairs(pairs: DataFrame, most: int, *order: str) -> DataFrame:
    """A global cut: the first ``most`` knowledge pairs over all groups in document order; groups that are
    left without a pair are gone with them."""
    return first_n(pairs, most, *order)


def truncated_aliases(aliases: Column, source: Column) -> Column:
    """At most as many aliases as the source has; none where it has none."""
    return F.slice(F.coalesce(aliases, F.array().cast("array<string>")), F.lit(1), F.greatest(F.lit(0), F.coalesce(F.size(source), F.lit(0))))


def with_defaults(batch: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """A batch with the model's output per key (JSON); ``{}`` where it gave none. Of repeated outputs the
    first in text order stays."""
    one = outputs.groupBy(key).agg(F.min("output").alias("output"))
    return batch.join(one, key, "left").withColumn("output", F.coalesce("output", F.lit("{}")))


def warnings(rows: DataFrame, group: str, pos: str, found: str) -> DataFrame:
    """Warnings as rows ``entity, pos, warning``: each prefixed by where it was found (``entity/pos: ...``)."""
    return rows.select(F.col(group).alias("entity"), F.col(pos).alias("pos"), F.explode(found).alias("w")).select("entity", "pos", F.concat(F.col("entity"), F.lit("/"), F.col("pos").cast("string"), F.lit(": "), F.col("w")).alias("warning"))




def cache_suffix(surface: int) -> str:
    """What a cache key of generated variants ends with: the language and the number of surface forms."""
    return f"en__surface{surface}"
