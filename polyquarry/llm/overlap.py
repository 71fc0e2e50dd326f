"""Weighted cosine join between two splits, and the overlap of their records.

Statements become vectors of term weights (inverse document frequency over all distinct statements of
the indexed side, scaled to length one). Terms are ordered from rare to frequent; each vector indexes only
its head: the terms up to where the norm of the rest drops below the threshold. The rarest common term of two
vectors of at least that cosine always stands in both heads (what lies beyond either head can't reach the
threshold), so the inverted lists of head terms find every pair. Entries that can't reach the threshold
even with the greatest weight of their list are not looked up; a pair of entries is kept where its weight
plus the product of the residual norms behind it can; the exact dot product follows. Equal statements are one
class and joined once: only classes enter, copies come back as members, and counts are made of classes.

Vectors are arrays of term hashes and weights that travel with their statement: the weighing shuffles only
terms that are rare, and candidate pairs meet each side once.

Frequent terms weigh little and rarely stand in a head, so lists stay short; a list that is long all
the same is split over several tasks. Terms in more than one of ``HOT_SHARE`` statements are at most
HOT_SHARE times the mean length in number and are broadcast; the rest is joined by a shuffle in which
no term holds more than that share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from polyquarry.functions import text as tx
from polyquarry.llm.lookalikes import mapped_udf, odd_column
from polyquarry.session import cut

THRESHOLD = 0.6
HOT_SHARE = 1000
LIST_ROWS = 4096
#: Weight of a term that the indexed side doesn't know: it can't be shared and mustn't drown the rest.
UNKNOWN = 1.0
#: A word of the indexed side in so few of its statements may be a misspelt one.
RARE = 2


def plain_column(text: Column) -> Column:
    """Look-alike characters made plain; only suspicious texts reach Python."""
    return F.when(odd_column(text), mapped_udf(F.when(odd_column(text), text))).otherwise(text)


def terms_column(plain: Column) -> Column:
    """Lower-case words and figures; digit groups are one figure."""
    joined = F.regexp_replace(F.lower(plain), r"(?<=\d)[,.'’](?=\d{3}(?!\d))", "")
    return F.filter(F.split(joined, r"[^\p{L}\p{N}\p{M}]+"), lambda t: t != "")


def keyed(rows: DataFrame, text: str, *ids: str) -> DataFrame:
    """Distinct ids with their statement: ``key`` (of the sorted terms, so word order and marks play no part)
    and ``plain``. Null, blank and wordless statements are left out."""
    t = rows.select(*ids, F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    t = t.select(*ids, plain_column(F.col("text")).alias("plain"))
    terms = terms_column(F.col("plain"))
    return t.filter(F.size(terms) > 0).withColumn("key", F.base64(F.unhex(F.md5(F.array_join(F.array_sort(terms), " "))))).distinct()


def classes(rows: DataFrame) -> DataFrame:
    """One wording per statement key (wordings of a key differ in order, case and marks alone) and its terms."""
    return rows.groupBy("key").agg(F.min("plain").alias("plain")).withColumn("terms", terms_column(F.col("plain")))


def statements(rows: DataFrame, text: str) -> DataFrame:
    """Distinct statements: ``key``, ``plain`` (one wording) and ``terms``."""
    return classes(keyed(rows, text))


def _vectors(sides: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """Each statement with its vector as parallel arrays: hashes ``t`` of its terms, rare ones first, weights
    ``w`` scaled to length one, document frequencies ``df`` (null for terms that the indexed side lacks), and
    ``n_head``, the size of its head. Only rare terms are shuffled to be weighed."""
    hot = F.broadcast(frequencies.filter(F.col("df") * HOT_SHARE >= n).select(F.col("t").alias("hot_t"), F.col("df").alias("hot_df")))
    cold = frequencies.filter(F.col("df") * HOT_SHARE < n).select("t", F.col("df").alias("cold_df"))
    counted = F.transform(F.array_distinct("terms"), lambda x: F.struct(F.xxhash64(x).alias("t"), F.size(F.filter("terms", lambda y: y == x)).alias("tf")))
    e = sides.select("key", F.explode(counted).alias("e")).select("key", "e.t", "e.tf").join(hot, F.col("t") == F.col("hot_t"), "left").drop("hot_t")
    rest = e.filter(F.col("hot_df").isNull()).drop("hot_df").join(cold, "t", "left").select("key", "t", "tf", F.col("cold_df").alias("df"))
    every = e.filter(F.col("hot_df").isNotNull()).select("key", "t", "tf", F.col("hot_df").alias("df")).unionByName(rest)
    weight = F.col("tf") * F.when(F.col("df").isNull(), F.lit(UNKNOWN)).otherwise(F.log(F.lit(1.0) + F.lit(float(n)) / F.col("df")))
    # both parts of a statement are gathered before they move
    v = every.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "t", weight.alias("w")))).alias("v"))
    v = v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])))
    v = v.select("key", F.transform("v", lambda x: x["t"]).alias("t"), F.transform("v", lambda x: x["w"] / F.col("norm")).alias("w"), F.transform("v", lambda x: x["df"].cast("int")).alias("df"))
    # squares of what is left after each term; the head ends where that falls below the threshold
    head = F.expr(f"greatest(1, size(filter(transform(w, (x, i) -> 1D - aggregate(slice(w, 1, i + 1), 0D, (s, y) -> s + y * y)), r -> r >= {THRESHOLD * THRESHOLD - 1e-9}D)) + 1)")
    return sides.select("key", "plain").join(v.withColumn("n_head", F.least(head, F.size("w"))), "key")


def cosine_join(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of ``left`` and ``right`` (frames of ``statements``, keys once each) with a cosine of at least
    ``threshold``: left_key, right_key, cosine, both wordings, and the hashes of the left terms that the right
    side doesn't know and of the right ones that it hardly knows. Document frequencies count all distinct
    statements of ``right``. Empty sides give no pair."""
    if threshold < THRESHOLD:
        raise ValueError("heads are built for a cosine of at least THRESHOLD")
    n = max(1, right.count())
    frequencies = cut(right.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy(F.xxhash64("term").alias("t")).agg(F.count(F.lit(1)).alias("df")))
    lv, rv = cut(_vectors(left, frequencies, n)), cut(_vectors(right, frequencies, n))
    # norms of what stands behind each term of the head
    rest = F.expr("transform(slice(w, 1, n_head), (x, i) -> sqrt(greatest(0D, 1D - aggregate(slice(w, 1, i + 1), 0D, (s, y) -> s + y * y))))")
    heads = lambda v, p: v.select(F.col("key").alias(f"{p}_key"), F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.col("n_head")).alias("t"), F.slice("w", F.lit(1), F.col("n_head")).alias("w"), F.slice("df", F.lit(1), F.col("n_head")).alias("df"), rest.alias("rest"))).alias("h")).select(
        f"{p}_key", "h.t", F.col("h.w").alias(f"{p}_w"), F.col("h.rest").alias(f"{p}_rest"), "h.df"
    )
    lh, rh = heads(lv, "l").filter(F.col("df").isNotNull()), heads(rv, "r")
    # what a list can add at most: entries that stay below the threshold even so are not looked up
    most = rh.groupBy("t").agg(F.max("r_w").alias("top_w"), F.max("r_rest").alias("top_rest"))
    lh = lh.join(most, "t").filter(F.col("l_w") * F.col("top_w") + F.col("l_rest") * F.col("top_rest") >= threshold - 1e-9).drop("top_w", "top_rest")
    # a long list is cut into salts; each left entry meets all of them
    salts = lambda df: F.greatest(F.lit(1), F.ceil(df / F.lit(float(LIST_ROWS)))).cast("int")
    lh = lh.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.col("df")) - 1))).drop("df")
    rh = rh.withColumn("salt", F.pmod(F.xxhash64("r_key"), salts(F.col("df"))).cast("int")).drop("df")
    # taken as the rarest common term, an entry pair bounds the whole product by the norms behind it; the
    # rarest common term of a true pair stands in both heads and passes
    bound = F.col("l_w") * F.col("r_w") + F.col("l_rest") * F.col("r_rest")
    pairs = lh.join(rh, ["t", "salt"]).filter(bound >= threshold - 1e-9).select("l_key", "r_key").distinct()
    of = lambda v, p, *more: v.select(F.col("key").alias(f"{p}_key"), F.col("plain").alias(f"{p}_plain"), F.col("t").alias(f"{p}_t"), F.col("w").alias(f"{p}_w"), *more)
    unknown = F.transform(F.filter(F.arrays_zip("t", "df"), lambda x: x["df"].isNull()), lambda x: x["t"]).alias("left_unknown")
    rare = F.transform(F.filter(F.arrays_zip("t", "df"), lambda x: x["df"] <= RARE), lambda x: x["t"]).alias("right_rare")
    exact = pairs.join(of(lv, "l", unknown), "l_key").join(of(rv, "r", rare), "r_key")
    weights = F.map_from_arrays("r_t", "r_w")
    dot = F.aggregate(F.arrays_zip("l_t", "l_w"), F.lit(0.0), lambda s, x: s + x["l_w"] * F.coalesce(F.try_element_at(weights, x["l_t"]), F.lit(0.0)))
    exact = exact.withColumn("cosine", dot).filter(F.col("cosine") >= threshold)
    named = lambda plain, hashes: F.filter(F.array_distinct(terms_column(F.col(plain))), lambda x: F.array_contains(hashes, F.xxhash64(x)))
    return exact.select(
        F.col("l_key").alias("left_key"), F.col("r_key").alias("right_key"), "cosine", F.col("l_plain").alias("left_plain"), F.col("r_plain").alias("right_plain"),
        named("l_plain", F.col("left_unknown")).alias("left_unknown"), named("r_plain", F.col("right_rare")).alias("right_rare"),
    )


#: Small words that may be missing or added, and words that turn a statement round.
SMALL = set("a an the some about of to in at on by for from and also its it is was were has had been that which who there then so very just some once only".split())
NEGATIONS = set("not no never none nor neither without cannot nobody nothing hardly scarcely barely isn wasn aren weren hasn hadn haven didn doesn don won't couldn wouldn failed false falsely denied refused unlike except".split())
MOST_ADDED = 5
_WORD = re.compile(r"[^\W_]+", re.UNICODE)


def _near(a: str, b: str, most: int = 2) -> bool:
    """Damerau-Levenshtein distance of at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        before, last = last, now
    return last[-1] <= most


def _tokens(text: str) -> list[str]:
    return _WORD.findall(re.sub(r"(?<=\d)[,.'’](?=\d{3}(?!\d))", "", text))


def same_fact(left: str, right: str, left_unknown: list[str], right_rare: list[str] | None = None) -> bool:
    """Whether two statements tell the same fact in nearly the same words. ``left_unknown``: lower-case
    words of ``left`` that no statement of the other split has; ``right_rare``: words of ``right`` that
    hardly any has.

    What differs may only be small or added words without name, figure or negation, a misspelt word
    (an unknown or rare word within two edits of the other side's), or spaces inside words.
    """
    lt, rt = _tokens(left), _tokens(right)
    a, b = Counter(t.casefold() for t in lt), Counter(t.casefold() for t in rt)
    extra, lacking = list((a - b).elements()), list((b - a).elements())
    if not extra and not lacking:
        return True
    if any(t.isdigit() or any(c.isdigit() for c in t) for t in extra + lacking):
        return sorted("".join(extra)) == sorted("".join(lacking)) and "".join(_order(lt, extra)) == "".join(_order(rt, lacking))
    if any(t in NEGATIONS for t in extra + lacking):
        return False
    if "".join(_order(lt, extra)) == "".join(_order(rt, lacking)):
        return True
    # names: capitalised inside their statement, where not all words are; the first word before another
    # capitalised one may be one too, so it is no misspelt word, but it may be an added one
    mixed = lambda ts: any(t[:1].islower() for t in ts)
    inside = {t.casefold() for ts in (lt, rt) if mixed(ts) and not _title(ts) for t in ts[1:] if t[:1].isupper()}
    names = inside | {ts[0].casefold() for ts in (lt, rt) if len(ts) > 1 and ts[0][:1].isupper() and ts[1][:1].isupper()}
    unknown, rare = set(left_unknown), set(right_rare or ())
    for t in [t for t in extra if len(t) >= 3]:
        match = next((r for r in lacking if (t in unknown or r in rare) and r not in names and t not in names and len(r) >= 3 and _near(t, r, 1 if len(r) < 5 else 2)), None)
        if match:
            extra.remove(t)
            lacking.remove(match)
    if any(t not in SMALL for t in lacking):
        return False
    added = [t for t in extra if t not in SMALL]
    return len(added) <= MOST_ADDED and not any(t in inside for t in added) and len(added) * 2 <= len(rt)


def _title(tokens: list[str]) -> bool:
    words = [t for t in tokens if t[:1].isalpha()]
    return sum(t[:1].isupper() for t in words) > 0.8 * len(words)


def _order(tokens: list[str], kept: list[str]) -> list[str]:
    left = Counter(kept)
    out = []
    for t in map(str.casefold, tokens):
        if left[t] > 0:
            left[t] -= 1
            out.append(t)
    return out


@F.pandas_udf(BooleanType())
def same_fact_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, u, r in batches:
        yield pd.Series([same_fact(w, x, list(y), list(z)) for w, x, y, z in zip(a, b, u, r)], dtype=bool)


def same_statements(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs left_key, right_key of distinct statements that tell the same fact: the cosine join, then
    the exact check on one wording of each."""
    pairs = cosine_join(left, right)
    return pairs.filter(same_fact_udf("left_plain", "right_plain", "left_unknown", "right_rare")).select("left_key", "right_key", "cosine")


def links(held: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The overlap as classes: pairs of statement classes (left_key, right_key, cosine), members of either
    side (holdout_card_id, left_key; card_id, right_key), and the pairs told by source_card_id
    (holdout_card_id, card_id). Expanding them gives ``overlaps``; counting doesn't need to."""
    named = (
        held.select("holdout_card_id", F.lower(tx.strip(F.col("source_card_id"))).alias("at")).filter("at <> '' AND holdout_card_id IS NOT NULL").distinct()
        .join(train.select("card_id", F.lower(tx.strip(F.col("card_id"))).alias("at")).filter("card_id IS NOT NULL").distinct(), "at")
        .select("holdout_card_id", "card_id").distinct()
    )
    lk, rk = cut(keyed(held, "fact_statement", "holdout_card_id")), cut(keyed(train, "fact_statement", "card_id"))
    pairs = same_statements(classes(lk), classes(rk))
    left = lk.filter("holdout_card_id IS NOT NULL").select("holdout_card_id", F.col("key").alias("left_key")).distinct()
    right = rk.filter("card_id IS NOT NULL").select("card_id", F.col("key").alias("right_key")).distinct()
    return pairs, left, right, named


def overlaps(held: DataFrame, train: DataFrame) -> DataFrame:
    """Pairs (holdout_card_id, card_id) of held-out and training cards that overlap, each once.

    ``held``: holdout_card_id, source_card_id, fact_statement; ``train``: card_id, fact_statement (only
    training cards). A pair overlaps by naming the card (case and outer blanks aside) or by telling the
    same fact. Null ids and null or blank facts overlap with nothing; extra columns play no part.
    """
    pairs, left, right, named = links(held, train)
    told = left.join(pairs.select("left_key", "right_key"), "left_key").join(right, "right_key").select("holdout_card_id", "card_id")
    return named.unionByName(told).distinct()


def class_links(held: DataFrame, train: DataFrame) -> DataFrame:
    """Linked statement classes with their cosine and how many cards of either side tell each: the compact
    form of the overlap told by facts."""
    pairs, left, right, _ = links(held, train)
    size = lambda m, key, name: m.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    out = pairs.join(size(left, "left_key", "n_held"), "left_key").join(size(right, "right_key", "n_train"), "right_key")
    return out.select("left_key", "right_key", F.round("cosine", 6).alias("cosine"), "n_held", "n_train")


def partner_counts(held: DataFrame, train: DataFrame) -> DataFrame:
    """holdout_card_id and ``n_partners``, its distinct training cards, counted by classes: a fact that a
    third of both sides tells is one row per held-out card, not the product."""
    pairs, left, right, named = links(held, train)
    matched = cut(left.join(pairs.select("left_key", "right_key"), "left_key").select("holdout_card_id", "right_key").distinct())
    # cards of one class count with it; cards of several classes, which are few, are told apart
    of = right.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"), F.min("right_key").alias("right_key"))
    single = of.filter("n = 1").groupBy("right_key").agg(F.count(F.lit(1)).alias("n_single"))
    several = right.join(of.filter("n > 1").select("card_id"), "card_id", "left_semi")
    by_class = matched.join(single, "right_key").groupBy("holdout_card_id").agg(F.sum("n_single").alias("n"))
    apart = matched.join(several, "right_key").select("holdout_card_id", "card_id").distinct()
    # a named card counts unless its statement is linked as well
    told = named.join(right, "card_id").join(matched, ["holdout_card_id", "right_key"], "left_semi").select("holdout_card_id", "card_id").distinct()
    alone = named.join(told, ["holdout_card_id", "card_id"], "left_anti")
    count = lambda df: df.groupBy("holdout_card_id").agg(F.count(F.lit(1)).alias("n"))
    return by_class.unionByName(count(apart)).unionByName(count(alone)).groupBy("holdout_card_id").agg(F.sum("n").alias("n_partners"))


def overlap_report(held: DataFrame, train: DataFrame) -> DataFrame:
    """Cards, overlapping cards and their training partners per split_role and source_page, counted by
    classes."""
    cards = held.select("holdout_card_id", "split_role", "source_page").distinct()
    return cards.join(partner_counts(held, train), "holdout_card_id", "left").groupBy("split_role", "source_page").agg(
        F.count(F.lit(1)).alias("n_cards"), F.count("n_partners").alias("n_leaking"), F.coalesce(F.sum("n_partners"), F.lit(0)).alias("n_pairs")
    )
