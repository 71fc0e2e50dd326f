"""Scores of records and vectors: exact match, cosine, membership scores, choices, losses, and AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.functions import text as tx
from polyquarry.session import cut


def exact(generation: Column, expected: Column) -> Column:
    """1 where both texts are equal once outer white space is gone, else 0; case and marks count."""
    return F.when(tx.strip(generation) == tx.strip(expected), F.lit(1.0)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to -1..1; null for vectors without length, with NaN or infinite parts."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (n > 0) & (n < F.lit(float("inf"))) & ~F.isnan(n)
    return F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def cosine_checked(candidate: Column, reference: Column, empty: Column) -> Column:
    """Cosine clamped to -1..1; 0 where the candidate text is empty; a vector without length or with NaN or
    infinite parts is an error."""
    return F.when(empty, F.lit(0.0)).otherwise(F.coalesce(cosine(candidate, reference), F.raise_error(F.lit("vector without a finite length")).cast("double")))


def min_k(log_probs: Column, k: float = 0.4) -> Column:
    """Negated mean of the lowest max(1, floor(n*k)) log probabilities; 0 for none."""
    n = F.greatest(F.lit(1), F.floor(F.size(log_probs) * F.lit(k))).cast("int")
    low = F.slice(F.array_sort(log_probs), F.lit(1), n)
    total = F.aggregate(low, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(log_probs) > 0, -total / F.size(low)).otherwise(F.lit(0.0))


def min_k_plus(log_probs: Column, means: Column, variances: Column, k: float = 0.4) -> Column:
    """Min-K over log probabilities standardised by the vocabulary's mean and variance at each place."""
    z = F.zip_with(F.zip_with(log_probs, means, lambda x, m: x.cast("double") - m.cast("double")), variances, lambda d, v: d / F.sqrt(F.greatest(v.cast("double"), F.lit(1e-6))))
    return min_k(z, k)


def mean_loss(log_probs: Column) -> Column:
    """Negated mean of log probabilities; 0 for none."""
    return F.when(F.size(log_probs) > 0, -F.aggregate(log_probs, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(log_probs)).otherwise(F.lit(0.0))


def zlib_loss(loss: Column, text: Column) -> Column:
    """A loss by the bytes that its text takes in a zlib stream."""
    from polyquarry.functions.udfs import zlib_length

    return loss / F.greatest(zlib_length(text), F.lit(1))


def log_mean_exp(rows: DataFrame, value: str, beta: float, *group: str) -> DataFrame:
    """-beta·log(mean(exp(-value/beta))) per group, shifted by the group's least value so that no term
    overflows. Nulls don't count; two partial aggregations, no list of values."""
    g = list(group) or ["__all"]
    rows = rows if group else rows.withColumn("__all", F.lit(0))
    least = rows.groupBy(*g).agg(F.min(value).alias("__least"))
    joined = rows.join(least if group else F.broadcast(least), g)  # without groups it is one row
    sums = joined.groupBy(*g, "__least").agg(F.avg(F.exp(-(F.col(value) - F.col("__least")) / F.lit(beta))).alias("__m"))
    return sums.select(*group, (F.col("__least") - F.lit(beta) * F.log("__m")).alias("value"))


def choice(scores: Column) -> Column:
    """0-based place of the greatest score, the first on ties; null for none."""
    return F.array_position(scores, F.array_max(scores)) - F.lit(1)


def choice_by_length(scores: Column, labels: list[str]) -> Column:
    """0-based place of the greatest score after each is divided by the length of its label."""
    return choice(F.zip_with(scores, F.array(*map(F.lit, labels)), lambda s, x: s / F.greatest(F.length(x), F.lit(1))))


def judge_or_match(generation: Column, expected: Column, nfkc) -> Column:
    """1.0 where both are equal in NFKC, so no judge is needed; else null."""
    return F.when(nfkc(generation) == nfkc(expected), F.lit(1.0))


def auc(rows: DataFrame, score: str, positive: str, *group: str) -> DataFrame:
    """ROC-AUC per group by rank sums with mid-ranks for ties; null where a class is empty.

    Scores are first counted per distinct value. The running counts are taken per range of scores (the
    ranges' totals are one row per partition), so no group is sorted in one task.
    """
    g = list(group)
    pos = F.col(positive).cast("int")
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*g, F.col(score).alias("__s")).agg(F.count_if(pos == 0).alias("n0"), F.count_if(pos == 1).alias("n1"))
    ranged = cut(counts.repartitionByRange(*g, "__s").withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part", *g).agg(F.sum("n0").alias("t"))
    before = totals.select("__part", *g, F.coalesce(F.sum("t").over(Window.partitionBy(*g).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("__part", *g).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.withColumn("below", F.coalesce(F.sum("n0").over(inside), F.lit(0))).join(before, ["__part", *g])
    # each positive beats all negatives below it and half of those at its score
    wins = F.sum(F.col("n1") * (F.col("before") + F.col("below") + F.col("n0") / 2))
    out = below.groupBy(*g).agg(wins.alias("wins"), F.sum("n0").alias("n_negative"), F.sum("n1").alias("n_positive"))
    return out.select(*g, "n_negative", "n_positive", F.when((F.col("n_negative") > 0) & (F.col("n_positive") > 0), F.col("wins") / (F.col("n_negative") * F.col("n_positive"))).alias("auc"))


# --- losses of preference-style objectives over per-record likelihoods ----------------------------------


def log_sigmoid(x: Column) -> Column:
    """log(1/(1+exp(-x))) without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def npo(nll: Column, reference: Column, beta: float) -> Column:
    """-2/beta · log sigmoid(beta·(nll - reference)) per record."""
    return F.lit(-2.0 / beta) * log_sigmoid(F.lit(beta) * (nll - reference))


def simnpo(nll: Column, length: Column, beta: float, delta: float = 0.0) -> Column:
    """-2/beta · log sigmoid(beta·(nll/length - delta)) per record."""
    return F.lit(-2.0 / beta) * log_sigmoid(F.lit(beta) * (nll / F.greatest(length, F.lit(1)) - F.lit(delta)))


def dpo(win: Column, win_reference: Column, lose: Column, lose_reference: Column, beta: float) -> Column:
    """-2/beta · log sigmoid(beta·(((lose - reference) - (win - reference)))) over negative log likelihoods."""
    return F.lit(-2.0 / beta) * log_sigmoid(F.lit(beta) * ((lose - lose_reference) - (win - win_reference)))


def kl(current: Column, reference: Column) -> Column:
    """Sum over the vocabulary of p_ref·(log p_ref - log p) for two arrays of log probabilities."""
    return F.aggregate(F.zip_with(reference, current, lambda r, c: F.exp(r) * (r - c)), F.lit(0.0), lambda s, x: s + x)


#: Objectives by name, each with the forget loss it takes per record.
OBJECTIVES = ["grad_ascent", "grad_diff", "npo", "dr_npo", "simnpo", "dr_simnpo", "combined"]


def objective(rows: DataFrame, name: str, *group: str, beta: float = 1.0, delta: float = 0.0, gamma: float = 1.0, alpha: float = 1.0, sigma: float = 1.0, retain: str = "nll", robust_retain: bool = False) -> DataFrame:
    """The value of an unlearning objective per group, as ``loss``. ``rows``: side (forget or retain), nll,
    reference_nll, length, and kl where ``retain`` is ``kl``. The value is gamma·forget + alpha·retain; forget
    is -mean(nll per token) for gradient ascent, gradient difference and the combined objective (alpha and
    gamma 1), else the preference loss averaged, or joined by log-mean-exp with ``sigma`` where its name is
    dr_. Gradient ascent has no retain part. ``robust_retain`` joins the retain part's losses so as well."""
    if name not in OBJECTIVES or retain not in ("nll", "kl") or robust_retain and retain != "nll":
        raise ValueError(f"no such objective: {name} with {retain}")
    if name == "combined" and (alpha != 1.0 or gamma != 1.0 or retain != "nll"):
        raise ValueError("the combined objective has alpha = gamma = 1 and the likelihood as its retain part")
    mean_nll = F.col("nll") / F.greatest(F.col("length"), F.lit(1))
    forget = {"npo": npo(F.col("nll"), F.col("reference_nll"), beta), "simnpo": simnpo(F.col("nll"), F.col("length"), beta, delta)}.get(name.removeprefix("dr_"), -mean_nll)
    kept = F.col("kl") if retain == "kl" else F.col("nll") if robust_retain else mean_nll
    g = list(group) or ["__all"]
    r = rows if group else rows.withColumn("__all", F.lit(0))

    def joined(side: str, value: Column, robust: bool) -> DataFrame:
        part = r.filter(F.col("side") == side).select(*g, value.alias("v"))
        return log_mean_exp(part, "v", sigma, *g).select(*g, F.col("value").alias(side)) if robust else part.groupBy(*g).agg(F.avg("v").alias(side))

    out = joined("forget", forget, name.startswith("dr_"))
    if name == "grad_ascent":
        return out.select(*group, F.col("forget").alias("loss"))
    return out.join(joined("retain", kept, robust_retain), g).select(*group, (F.lit(gamma) * F.col("forget") + F.lit(alpha) * F.col("retain")).alias("loss"))
