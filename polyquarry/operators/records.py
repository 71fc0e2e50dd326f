"""Records and documents: leaf texts and write-back, metric maps, variants, choices, training inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.functions import text as tx
from polyquarry.session import broadcast_if_small

IGNORED = -100


# --- leaf texts for translation, and their write-back --------------------------------------------------


def leaf_texts(rows: DataFrame, key: str, scalars: list[str] = (), lists: list[str] = (), map_keys: list[str] = (), map_values: list[str] = ()) -> DataFrame:
    """One row per text leaf: key, path, job_type, pos (or map key) and text. Null and blank leaves are
    left out. Paths may lead through structs (``a.b``)."""
    job = lambda path, kind, pos, text: F.struct(F.lit(path).alias("path"), F.lit(kind).alias("job_type"), pos.cast("string").alias("pos"), text.cast("string").alias("text"))
    none = F.array().cast("array<struct<path:string,job_type:string,pos:string,text:string>>")

    def of_list(p: str) -> Column:
        return F.transform(F.col(p), lambda x, i: job(p, "list", i, x))

    def of_keys(p: str) -> Column:
        return F.transform(F.map_keys(p), lambda k: job(p, "map_keys", k, k))

    def of_values(p: str) -> Column:
        return F.transform(F.map_entries(p), lambda e: job(p, "map_values", e["key"], e["value"]))

    parts = [F.array(job(p, "scalar", F.lit(None), F.col(p))) for p in scalars]
    parts += [of_list(p) for p in lists] + [of_keys(p) for p in map_keys] + [of_values(p) for p in map_values]
    leaves = F.concat(*[F.coalesce(p.cast("array<struct<path:string,job_type:string,pos:string,text:string>>"), none) for p in parts])
    return rows.select(key, F.explode(leaves).alias("l")).select(key, "l.*").filter(tx.normalize_ws(F.col("text")) != "")


def distinct_texts(leaves: DataFrame, *order: str) -> DataFrame:
    """Each text once with its first place in the given order."""
    return leaves.groupBy("text").agg(F.min(F.struct(*order)).alias("first"))


def content_key(text: Column) -> Column:
    """The key under which a text's translation is cached: the SHA-256 of its UTF-8 bytes."""
    return F.sha2(text, 256)


def cached_translations(leaves: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of ``leaves`` that ``cache`` (sha256, translated) knows, as text and translated, and
    the texts it lacks, each with its key. Texts meet the cache by their keys, however long they are."""
    keyed = leaves.select("text").distinct().withColumn("sha256", content_key(F.col("text")))
    one = cache.groupBy("sha256").agg(F.min("translated").alias("translated"))
    return keyed.join(one, "sha256").select("text", "translated"), keyed.join(one, "sha256", "left_anti").select("text", "sha256")


def write_back(rows: DataFrame, key: str, leaves: DataFrame, translations: DataFrame, suffix: str = "_zh") -> DataFrame:
    """``rows`` with ``translated``: path plus suffix → JSON of the translated leaf (a text, a list in
    order, or a map). ``translations``: text, translated. Leaves without translation make the value null."""
    t = leaves.join(translations.select("text", "translated"), "text", "left")
    whole = F.count(F.lit(1)) == F.count("translated")
    items = F.sort_array(F.collect_list(F.struct(F.col("pos").try_cast("int").alias("i"), "pos", "text", "translated")))
    g = t.groupBy(key, "path", "job_type").agg(whole.alias("whole"), items.alias("items"))
    texts = F.transform("items", lambda x: x["translated"])
    value = (
        F.when(F.col("job_type") == "scalar", F.to_json(F.struct(F.element_at(texts, 1).alias("v"))))
        .when(F.col("job_type") == "list", F.to_json(F.struct(texts.alias("v"))))
        .when(F.col("job_type") == "map_keys", F.to_json(F.struct(F.map_from_arrays(texts, F.transform("items", lambda x: x["text"])).alias("v"))))
        .otherwise(F.to_json(F.struct(F.map_from_arrays(F.transform("items", lambda x: x["pos"]), texts).alias("v"))))
    )
    entry = F.struct(F.concat("path", F.lit(suffix)).alias("key"), F.when(F.col("whole"), value).alias("value"))
    maps = g.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("translated"))
    return rows.join(maps, key, "left")


# --- metric maps -----------------------------------------------------------------------------------------


def set_metric(metrics: Column, name: str, value: Column) -> Column:
    """A metrics map with one entry replaced or added; all others stay."""
    old = F.coalesce(metrics, F.create_map().cast("map<string,double>"))
    return F.map_concat(F.map_filter(old, lambda k, _: k != name), F.create_map(F.lit(name), value.cast("double")))


def merge_metrics(left: Column, right: Column) -> Column:
    """Two metrics maps; the right one wins."""
    empty = F.create_map().cast("map<string,double>")
    r = F.coalesce(right, empty)
    return F.map_concat(F.map_filter(F.coalesce(left, empty), lambda k, _: ~F.map_contains_key(r, k)), r)


def pending_metrics(wanted: DataFrame, logged: DataFrame, overwrite: bool = False) -> DataFrame:
    """(run, metric) pairs still to be computed: all, when overwriting."""
    return wanted if overwrite else wanted.join(logged.select("run", "metric").distinct(), ["run", "metric"], "left_anti")


# --- question variants -------------------------------------------------------------------------------------


def normalized_variants(variants: DataFrame) -> DataFrame:
    """Generated variants of a held-out card brought into form, with ``reject_reason`` and ``warnings``.

    Input: holdout_card_id, sequence, language, variant_layer, question, expected_answer, answer_aliases,
    card_answer, card_aliases, topic_name, source_page. The card's answer wins over a generated one; a
    generated answer equivalent to it becomes the first alias, another one gives a warning; aliases are
    kept where safe; answer terms in the question are warned of. Rejected: another language, an unknown
    layer, no question, no answer (the first reason in this order).
    """
    c = lambda n: tx.normalize_ws(F.col(n))
    lang, layer = F.lower(tx.normalize_ws(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("en")))), F.lower(c("variant_layer"))
    v = variants.withColumn("language", lang).withColumn("variant_layer", layer).withColumn("question", c("question")).withColumn("generated", c("expected_answer")).withColumn("card_answer", c("card_answer"))
    v = v.withColumn("expected_answer", F.when(F.col("card_answer") != "", F.col("card_answer")).otherwise(F.col("generated")))
    reason = (
        F.when(F.col("language") != "en", F.lit("invalid language")).when(~F.col("variant_layer").isin("core", "surface"), F.lit("invalid variant_layer"))
        .when(F.col("question") == "", F.lit("missing question")).when(F.col("generated") == "", F.lit("missing expected_answer"))
    )
    alike = tx.alias_equivalent_v1(F.col("generated"), F.col("expected_answer"))
    both = F.concat(tx.clean_aliases(F.col("answer_aliases")), tx.clean_aliases(F.col("card_aliases")))
    safe = tx.safe_aliases(both, F.col("expected_answer"), F.col("topic_name"), F.col("source_page"))
    v = v.withColumn("answer_aliases", F.when((F.col("generated") != F.col("expected_answer")) & alike, F.array_distinct(F.concat(F.array("generated"), safe))).otherwise(safe))
    leaked = tx.leaks(F.col("question"), F.col("expected_answer"), F.col("answer_aliases"), F.col("topic_name"), F.col("source_page"))
    warnings = F.concat(
        F.array_compact(F.array(F.when((F.col("card_answer") != "") & ~tx.alias_equivalent_v1(F.col("generated"), F.col("card_answer")), F.lit("question_answer_focus_mismatch")))),
        F.array_compact(F.array(F.when((F.col("generated") != "") & (F.col("generated") != F.col("expected_answer")) & ~alike, F.lit("unsafe_answer_alias")))),
        F.transform(leaked, lambda t: F.concat(F.lit("answer_leakage_in_question: "), t)),
    )
    suffix = F.when(F.col("variant_layer") == "core", F.lit("core")).otherwise(F.concat(F.lit("surface_"), F.format_string("%03d", F.col("sequence"))))
    v = v.withColumn("qa_id", F.concat_ws("__", "holdout_card_id", F.lit("en"), suffix)).withColumn("reject_reason", reason).withColumn("warnings", warnings)
    return v.select("qa_id", "holdout_card_id", "variant_layer", "language", "question", "expected_answer", "answer_aliases", "reject_reason", "warnings")


def relation_profile(topics: DataFrame, hints: DataFrame) -> DataFrame:
    """Topics (topic_type) with their relation hints as text. ``hints``: topic_type, kind, relations. A
    kind without hints gets a default wording; examples of short answers have a line only where there are any."""
    #: Kinds with their headings and defaults, in order.
    kinds = [
        ("shared_core_relations", "Shared core relations", "use the most pairable relations supported by the page"),
        ("multi_instance_priority", "Multi-instance priority relations", "favor relations with multiple distinct answers"),
        ("singleton_support", "Singleton support relations", "use singleton relations only as supplemental support"),
    ]
    named = lambda kind, mark: F.first(F.when(F.col("kind") == kind, F.array_join("relations", mark)), ignorenulls=True)
    per = hints.groupBy("topic_type").agg(*[named(k, ", ").alias(k) for k, _, _ in kinds], named("short_answer_examples", "; ").alias("__short"))
    lines = [F.concat(F.lit(f"{title}: "), F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(default))) for k, title, default in kinds]
    short = F.when(F.col("__short") != "", F.concat(F.lit("Short-answer examples to prefer: "), "__short"))
    few = broadcast_if_small(per, hints.count(), 1024)
    return topics.join(few, "topic_type", "left").withColumn("profile", F.concat_ws("\n", *lines, short)).drop(*[k for k, _, _ in kinds], "__short")


def review_payloads(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a review sample with ids ``language:001:qa_id`` by order within the language."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("language").orderBy(*order))
    return rows.withColumn("review_id", F.concat_ws(":", "language", F.format_string("%03d", n), "qa_id"))


# --- multiple choice ------------------------------------------------------------------------------------------


def unwrapped(response: Column) -> Column:
    """The log likelihood in a JSON of nested one-element lists, or the first of a list."""
    bare = F.regexp_replace(response, r"^[\[\s]+", "")
    return F.regexp_extract(bare, r"^(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def choice_records(samples: DataFrame) -> DataFrame:
    """Stored multiple-choice samples (task, doc_id, link, question_number, correct_answer_num, responses
    array of JSON, acc, acc_norm) as records with prediction, gold option, correctness and ``problem``:
    what is wrong with the sample, null for none. Ties go to the first option."""
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    s = samples.withColumn("scores", F.transform("responses", unwrapped)).withColumn("gold", F.col("correct_answer_num").try_cast("int"))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    s = s.withColumn("best", best).withColumn("correct", (F.col("best") == F.col("gold")).cast("int"))
    broken = F.coalesce(F.size("scores") != 4, F.lit(True)) | F.exists(F.coalesce("scores", F.array().cast("array<double>")), lambda x: x.isNull())
    problem = (
        F.when(broken, F.lit("expected 4 choices")).when(F.coalesce(~F.col("gold").between(1, 4), F.lit(True)), F.lit("invalid correct_answer_num"))
        .when(F.col("acc").isNotNull() & (F.col("acc") != F.col("correct")), F.lit("disagrees with acc")).when(F.col("acc_norm").isNotNull() & (F.col("acc_norm") != F.col("correct")), F.lit("disagrees with acc_norm"))
    )
    item = F.concat(F.col("link"), F.lit("::question_"), F.col("question_number").cast("string"))
    return s.select("task", "doc_id", item.alias("item_id"), F.try_element_at(labels, F.col("gold")).alias("gold_option"), F.try_element_at(labels, F.col("best")).alias("predicted_option"), "correct", problem.alias("problem"))


def macro_over_tasks(accuracies: DataFrame, tasks: list[str]) -> DataFrame:
    """The mean accuracy over all tasks; no row unless every one of them is there."""
    a = accuracies.filter(F.col("task").isin(tasks)).groupBy("task").agg(F.avg("acc").alias("acc"))
    return a.agg(F.count(F.lit(1)).alias("n_tasks"), F.avg("acc").alias("macro_acc")).filter(F.col("n_tasks") == len(set(tasks)))


# --- training inputs over token ids -----------------------------------------------------------------------------


def supervised(prompt_ids: Column, chat_ids: Column, eos: int, max_length: int) -> tuple[Column, Column]:
    """(input ids, labels) of a chat: an end token is put behind it if it lacks one (in place of the last
    id where the length is used up); prompt positions are masked in the labels."""
    chat = F.slice(chat_ids, 1, max_length)
    ended = F.coalesce(F.try_element_at(chat, F.lit(-1)) == eos, F.lit(False))
    cut = F.when(F.size(chat) >= max_length, F.slice(chat, 1, max_length - 1)).otherwise(chat)
    ids = F.when(ended, chat).otherwise(F.concat(cut, F.array(F.lit(eos))))
    masked = F.transform(ids, lambda x, i: F.when(i < F.size(F.slice(prompt_ids, 1, max_length)), F.lit(IGNORED)).otherwise(x))
    return ids, masked


def padded(ids: Column, length: Column, value: int, side: str = "right") -> Column:
    """Ids filled up to a length with a value on either side; longer ones stay."""
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def attention(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def warmup_steps(epochs: float, rows: int, batch: int, accumulation: int, devices: int) -> int:
    """Optimizer steps of so many epochs of warm-up."""
    return int(epochs * rows // (batch * accumulation * devices))


def parameter_grid(spark, **values: list) -> DataFrame:
    """All combinations of parameter values, one row each: a grid made from lists of code, not tables."""
    import itertools

    names = sorted(values)
    rows = [tuple(str(v) for v in c) for c in itertools.product(*[values[n] for n in names])]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
