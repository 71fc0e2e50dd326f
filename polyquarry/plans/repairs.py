"""Queries over shapes, answers of models, repairs, exports, rescoring and runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.functions import metrics, parsing
from polyquarry.operators import cards as cd
from polyquarry.operators import experiments, exports, matrix, nested, quality, records, repairs, rescoring, selection, shapes
from polyquarry.plans.views import GEN_SQL, QA_SQL, generations, qa, rounded, slug, ws
from polyquarry.session import scratch, table
from polyquarry.sources import files

C = F.col


def _holdout(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "holdout_card").drop("normalized_at").distinct()


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """Real attempts, each once."""
    a = nested.attempts(table(spark, d, "attempt_cache"), "target_language")
    return a.select("cache_id", "item_pos", "attempt_pos", "target_language", C("item.source_qa_id").alias("source_qa_id"), C("attempt.translation").alias("t"), C("attempt.backtranslation_en").alias("b"), C("attempt.consistency").alias("c")).dropDuplicates(["cache_id", "item_pos", "attempt_pos"])


# --- shapes -----------------------------------------------------------------------------------------------------


def holdout_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Held-out cards as one-sided pairs, their variants unnested again by the shape of pairs."""
    p = shapes.holdout_as_pairs(_holdout(spark, d))
    return shapes.variants(p).select("pair_id", "knowledge_pair_id", "topic_role", "relation_type", "pos", "qa_id", "question").distinct()


def holdout_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose variants went through the pair shape and back."""
    h = _holdout(spark, d).filter("holdout_card_id IS NOT NULL").dropDuplicates(["holdout_card_id"])
    back = shapes.pairs_as_holdout(h, shapes.holdout_as_pairs(h))
    return back.select("holdout_card_id", F.size("qa_variants").alias("n_variants"), F.array_join(F.transform("qa_variants", lambda v: v["qa_id"]), ",").alias("qa_ids"))


def shape_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Variants of both document shapes in one table, counted by role and layer."""
    h = _holdout(spark, d)
    both = shapes.variants(h).unionByName(shapes.variants(shapes.holdout_as_pairs(h)))
    return both.groupBy(F.when(C("holdout_card_id") == "", "pairs").otherwise("cards").alias("shape"), "topic_role", "variant_layer").agg(F.count(F.lit(1)).alias("n_variants"), F.count_distinct("qa_id").alias("n_ids"))


def role_cards(spark: SparkSession, d: str) -> DataFrame:
    """The card of the target role with its parent's page put in."""
    p = shapes.holdout_as_pairs(_holdout(spark, d))
    card = shapes.card_of_role(p, "target")
    return p.select("knowledge_pair_id", card.alias("c")).select("knowledge_pair_id", "c.card_id", "c.answer", "c.topic_name", "c.source_page").distinct()


def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    b = shapes.batches(qa(spark, d).select("qa_id").distinct(), 20, "qa_id")
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n_items"), F.min("qa_id").alias("first_id"), F.max("at").alias("last_at"))


def first_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = qa(spark, d).filter("knowledge_pair_id IS NOT NULL").select("pair_id", "knowledge_pair_id").distinct()
    return shapes.first_pairs(p, 100, "pair_id", "knowledge_pair_id")


def wanted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first cards of two relations in document order."""
    c = table(spark, d, "knowledge_card").select("card_id", "pair_id", "topic_role", "pos", "relation_type").distinct()
    return shapes.wanted(c, "relation_type", ["fire", "medal"], 50, "pair_id", "topic_role", "pos", "card_id").select("card_id", "relation_type")


def source_index(spark: SparkSession, d: str) -> DataFrame:
    q = qa(spark, d).select("knowledge_pair_id", "topic_role", "qa_id", F.lit(0).alias("pos")).distinct()
    return shapes.source_index(q).select("knowledge_pair_id", "qa_id", "source_pos")


def english_with_cards(spark: SparkSession, d: str) -> DataFrame:
    v = shapes.english_variants(qa(spark, d).select("qa_id", "card_id", "topic_role", "language").distinct(), "target")
    c = table(spark, d, "knowledge_card").groupBy("card_id").agg(F.max("fact_statement").alias("fact_statement"), F.max("source_span").alias("source_span"))
    return shapes.variants_with_cards(v, c).select("qa_id", "card_id", "card_fact").distinct()


def truncated_aliases(spark: SparkSession, d: str) -> DataFrame:
    """A translation's aliases cut to the number of its source's."""
    q = qa(spark, d).groupBy("qa_id").agg(F.max(F.size("answer_aliases")).alias("n"))
    a = _attempts(spark, d).select("cache_id", "item_pos", "attempt_pos", "source_qa_id", C("t.answer_aliases").alias("aliases"))
    j = a.join(q.withColumnRenamed("qa_id", "source_qa_id"), "source_qa_id")
    return j.select("cache_id", "item_pos", "attempt_pos", F.size(shapes.truncated_aliases(C("aliases"), F.array_repeat(F.lit(""), F.greatest(C("n"), F.lit(0))))).alias("n_aliases"))


def batch_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Held-out cards with the model's output, where it gave one (here: for cards with a source card)."""
    h = _holdout(spark, d).filter("holdout_card_id IS NOT NULL").select("holdout_card_id", "source_card_id").distinct()
    outputs = h.filter("source_card_id IS NOT NULL").select("holdout_card_id", F.to_json(F.struct("source_card_id")).alias("output"))
    return shapes.with_defaults(h.select("holdout_card_id").distinct(), outputs, "holdout_card_id")


def upsert_in_order(spark: SparkSession, d: str) -> DataFrame:
    """New rows put in and all rows in their source's order; rows the source lacks come last."""
    q = qa(spark, d).groupBy("qa_id").agg(F.max("expected_answer").alias("expected_answer"))
    new = q.filter(C("qa_id").like("%surface1")).select("qa_id", F.upper("expected_answer").alias("expected_answer")).unionByName(q.filter(C("qa_id").like("%surface2")).select(F.concat("qa_id", F.lit("x")).alias("qa_id"), "expected_answer"))
    source = table(spark, d, "attempt_cache").select(F.explode("attempt_history").alias("i"), "cache_id").groupBy(C("i.source_qa_id").alias("qa_id")).agg(F.min("cache_id").alias("pos"))
    return cd.in_source_order(cd.upsert(q, new, "qa_id"), source, "qa_id").select("qa_id", "expected_answer", C("pos").cast("long").alias("pos"))


def variant_outcomes(spark: SparkSession, d: str) -> DataFrame:
    v = qa(spark, d).select("qa_id", "knowledge_pair_id", "topic_role", "variant_layer", "language", "question").distinct()
    v = v.withColumn("at", F.concat_ws("|", "qa_id", F.md5("question")))
    return cd.variant_outcomes(v, ["knowledge_pair_id", "topic_role"], "at").groupBy("outcome").agg(F.count(F.lit(1)).alias("n_variants"))


def warning_rows(spark: SparkSession, d: str) -> DataFrame:
    c = cd.normalized(table(spark, d, "knowledge_card")).select(F.concat_ws("/", "pair_id", "topic_role").alias("entity"), "pos", "missing").distinct()
    return shapes.warnings(c, "entity", "pos", "missing")


# --- expectations -----------------------------------------------------------------------------------------------


def enum_checks(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_variant").select("qa_id", "topic_role", "language", "dataset_family").distinct()
    return quality.enum_violations(q, "qa_id", {"topic_role": ["target", "neighbor"], "language": ["en"], "dataset_family": ["common", "culture_specific"]}).distinct()


def manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    """A manifest made of the cards' pairs: sides without a relation lack a title, pairs with a low-priority
    first card name the wrong role, single-sided pairs have no other side."""
    c = table(spark, d, "knowledge_card").groupBy("pair_id", "topic_role").agg(F.max("topic_name").alias("name"), F.min("relation_type").alias("relation"), F.min(F.struct("pos", F.lower("eval_priority").alias("p"))).alias("f"))
    side = lambda r: F.max(F.when(C("topic_role") == r, F.struct(F.when(C("f")["p"] == "low", F.lit("other")).otherwise(C("topic_role")).alias("role"), C("name").alias("topic_zh"), C("name").alias("topic_en"), C("relation").alias("wiki_title"), F.lit("u").alias("wiki_url")))).alias(r)
    p = c.groupBy("pair_id").agg(side("target"), side("neighbor"))
    p = shapes.positional_index(p.withColumn("topic_type", F.element_at(F.split("pair_id", "_"), 2)), "pair_id", name="pos")
    return quality.manifest_problems(p).groupBy("context", "problem").agg(F.count(F.lit(1)).alias("n"))


def weight_checks(spark: SparkSession, d: str) -> DataFrame:
    """Stored weighted values that aren't the weighted sum: here one in a hundred is off by 10^-9."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C("l_discount").alias("core"), C("l_tax").alias("surface"))
    off = F.when(C("l_orderkey") % 100 == 3, F.lit(1e-9)).otherwise(F.lit(0.0))
    w = li.withColumn("weighted", 0.25 * C("core") + 0.75 * C("surface") + off)
    return quality.weight_violations(w, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


# --- exports ----------------------------------------------------------------------------------------------------


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d)
    return exports.summarised(g.filter("relation_type IS NOT NULL"), "a_exact", "relation_type", "dataset_family")


def export_problems(spark: SparkSession, d: str) -> DataFrame:
    return exports.problems(_summaries(spark, d), "common", "target").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def export_long(spark: SparkSession, d: str) -> DataFrame:
    """The long table written as CSV and read again."""
    path = scratch(spark, "export")
    long = exports.long_rows(_summaries(spark, d), "a_exact", "target", "core", experiment="e", dataset="common", method="m")
    files.write_table(long, path)
    back = spark.read.option("header", True).csv(path)
    return rounded(back.select("checkpoint_id", "source_language", "evaluation_language", "topic_role", "metric", "variant", C("score").cast("double").alias("score")))


def export_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix written as CSV and read again; a missing cell is blank."""
    path = scratch(spark, "matrix")
    files.write_table(exports.matrix_rows(exports.long_rows(_summaries(spark, d), "a_exact", "target", "surface")), path)
    back = spark.read.option("header", True).csv(path)
    return rounded(back.select("checkpoint_id", "source_language", *[C(x).cast("double").alias(x) for x in matrix.LANGUAGES]))


def review_table(spark: SparkSession, d: str) -> DataFrame:
    """The review table written with its fixed columns and read again."""
    path = scratch(spark, "review")
    q = qa(spark, d).select("language", "qa_id", "pair_id", "topic_role", C("question").alias("source_question"), F.lit("ignored").alias("extra")).dropDuplicates(["qa_id"]).filter("language = 'en'")
    files.write_review_table(q, path)
    back = spark.read.option("sep", "\t").option("header", True).csv(path)
    places = [F.lit(back.columns.index(c)).alias(f"at_{c}") for c in ("comment", "source_question")]
    return back.groupBy("language", "topic_role").agg(F.count(F.lit(1)).alias("n_rows"), F.count("comment").alias("n_comments"), F.count_distinct("qa_id").alias("n_ids")).select("*", *places)


def qa_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON lines and loaded again with filter, required fields and uniqueness."""
    path = scratch(spark, "qa")
    q = qa(spark, d).groupBy("qa_id").agg(F.max("variant_layer").alias("variant_layer"), F.max("topic_role").alias("topic_role"), F.max("expected_answer").alias("expected_answer"))
    for layer in ("core", "surface"):
        files.write_lines(q.filter(C("variant_layer") == layer), f"{path}/{layer}")
    schema = "qa_id string, variant_layer string, topic_role string, expected_answer string"
    rows = files.read_qa(spark, [f"{path}/core", f"{path}/surface"], schema, ["qa_id"], {"topic_role": "target"})
    return rows.groupBy("variant_layer").agg(F.count(F.lit(1)).alias("n_rows"))


def cache_digests(spark: SparkSession, d: str) -> DataFrame:
    q = qa(spark, d).select("knowledge_pair_id", "qa_id").distinct()
    return files.digests(q, ["knowledge_pair_id"], "qa_id", "qa_id")


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    h = _holdout(spark, d).select("topic_name").filter("topic_name IS NOT NULL").distinct()
    return h.select("topic_name", files.page_url(F.lit(" https://pages.example// "), C("topic_name")).alias("url"))


# --- answers of models ------------------------------------------------------------------------------------------


def parsed_translations(spark: SparkSession, d: str) -> DataFrame:
    """Translations read from answers of four forms: wrapped, in a list, by id in a list of several, bare."""
    a = _attempts(spark, d).filter("t IS NOT NULL AND t.question IS NOT NULL AND t.expected_answer IS NOT NULL")
    bare = F.to_json(F.struct("t.question", "t.expected_answer", "t.answer_aliases"))
    named = F.to_json(F.struct("source_qa_id", "t.question", "t.expected_answer"))
    form = C("cache_id") % 4
    answer = (
        F.when(form == 0, F.concat(F.lit('{"translation": '), bare, F.lit("}"))).when(form == 1, F.concat(F.lit('[1, {"translation": ['), bare, F.lit("]}]")))
        .when(form == 2, F.concat(F.lit('{"translations": [{"source_qa_id": "none", "question": "x", "expected_answer": "y"}, '), named, F.lit("]}"))).otherwise(bare)
    )
    p = a.select("cache_id", "item_pos", "attempt_pos", parsing.translation(answer, C("source_qa_id"), F.lit("xx")).alias("p"))
    return p.select("cache_id", "item_pos", "attempt_pos", "p.source_qa_id", "p.language", "p.question", "p.expected_answer")


def parsed_backs(spark: SparkSession, d: str) -> DataFrame:
    a = _attempts(spark, d).filter("b IS NOT NULL AND b.question IS NOT NULL AND b.expected_answer IS NOT NULL")
    body = F.to_json(C("b"))
    answer = F.when(C("cache_id") % 2 == 0, F.concat(F.lit('{"backtranslations": ['), body, F.lit("]}"))).otherwise(body)
    p = a.select("cache_id", "item_pos", "attempt_pos", parsing.back_translation(answer, C("source_qa_id")).alias("p"))
    return p.select("cache_id", "item_pos", "attempt_pos", "p.source_qa_id", "p.question", "p.expected_answer", F.size("p.answer_aliases").alias("n_aliases"))


def parsed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    a = _attempts(spark, d).filter("c IS NOT NULL AND (c.verdict IS NOT NULL OR c.is_consistent IS NOT NULL)")
    body = F.to_json(C("c"))
    answer = F.when(C("cache_id") % 3 == 0, F.concat(F.lit('{"consistency": ['), body, F.lit("]}"))).when(C("cache_id") % 3 == 1, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    p = a.select("cache_id", "item_pos", "attempt_pos", parsing.consistency(answer).alias("p"))
    return p.select("cache_id", "item_pos", "attempt_pos", "p.verdict", "p.is_consistent", "p.failure_type")


def failed_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Attempts without a verdict with the default one."""
    a = _attempts(spark, d).filter("c IS NULL")
    return a.select("cache_id", "item_pos", "attempt_pos", repairs.failed_consistency(F.lit("no verdict")).alias("v")).select("cache_id", "item_pos", "attempt_pos", "v.verdict", "v.is_consistent", "v.failure_type", "v.reason")


def _translator():
    """A stub: translations upper-case the question; the check passes at the attempt that the id's last digit
    names (1 to 3), and never where that is 0 or above 3; ids ending in 9 get answers that are no JSON."""
    tries: dict[str, int] = {}

    def ask(request: dict) -> dict:
        key = request.get("source_qa_id") or request.get("candidate", {}).get("source_qa_id", "")
        say = lambda v: {"choices": [{"message": {"content": v if isinstance(v, str) else json.dumps(v)}}]}
        if request["step"] in ("translate", "repair"):
            tries[key] = 1 if request["step"] == "translate" else tries[key] + 1
            return say("no answer") if key.endswith("9") else say({"translation": {"source_qa_id": key, "question": request["question"].upper(), "expected_answer": request["expected_answer"]}})
        if request["step"] == "back":
            return say({"backtranslation": {"question": "q", "expected_answer": "a"}})
        return say({"consistency": {"verdict": "passed" if key[-1:] == str(tries[key]) else "failed", "failure_type": "drift", "reason": "differs"}})

    return ask


def verification_loop(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sources of the translate, back-translate, check loop with a stub client."""
    o = table(spark, d, "orders").select(C("o_orderkey").cast("string").alias("source_qa_id"), F.lit("de").alias("language"), C("o_clerk").alias("question") if "o_clerk" in table(spark, d, "orders").columns else C("o_orderpriority").alias("question"), C("o_orderpriority").alias("expected_answer"))
    v = repairs.verified(o, _translator)
    return v.groupBy("status", "n_attempts", "failure_type", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def repair_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Last attempts that failed, with their source and a repair (here: where the answer has a digit)."""
    from polyquarry.operators import translation

    failed = translation.attempt_outcomes(table(spark, d, "attempt_cache")).filter("NOT accepted").select("source_qa_id").filter("source_qa_id IS NOT NULL").distinct()
    q = qa(spark, d).select("qa_id", "expected_answer").distinct()
    repaired = q.filter(C("expected_answer").rlike("[0-9]")).select(C("qa_id").alias("source_qa_id"), "expected_answer")
    return repairs.lookup(failed, q, repaired).select("source_qa_id", "state")


def alias_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Alias requests of failed attempts and the aliases kept of a stub's answer, which offers the answer
    itself, a blank and the answer in upper case twice."""
    a = _attempts(spark, d).filter("c IS NOT NULL AND t IS NOT NULL")
    failed = a.select("cache_id", "item_pos", "attempt_pos", "source_qa_id", F.lit("de").alias("language"), C("c.failure_type").alias("failure_type"), C("t.question").alias("question"), C("t.expected_answer").alias("expected_answer"))
    q = qa(spark, d).groupBy("qa_id").agg(F.max("question").alias("question"), F.max("expected_answer").alias("expected_answer"), F.max("answer_aliases").alias("answer_aliases"))
    r = repairs.alias_requests(failed, q).filter("expected_answer IS NOT NULL")
    offered = F.array("expected_answer", F.lit(" "), F.upper("expected_answer"), F.upper("expected_answer"))
    r = r.withColumn("answer", F.to_json(F.struct(offered.alias("answer_aliases"), F.lit("").alias("note")))).withColumn("topic_name", F.lit("")).withColumn("source_page", F.lit(""))
    out = repairs.repaired_aliases(r)
    return out.select("cache_id", "item_pos", "attempt_pos", F.size("source_aliases").alias("n_source"), F.array_join("answer_aliases", "|").alias("aliases"), "note")


def missing_translations(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a batch's answer leaves out (here every seventh)."""
    o = table(spark, d, "orders").select((C("o_orderkey") % 50).alias("batch"), C("o_orderkey").cast("string").alias("id"), (C("o_orderkey") % 7 == 0).alias("left_out"))
    said = o.filter("NOT left_out").groupBy("batch").agg(F.to_json(F.struct(F.collect_list(F.struct("id", F.lit("x").alias("translation"))).alias("translations"))).alias("answer"))
    return repairs.missing_translations(o, said).select("batch", "id")


# --- scores and runs --------------------------------------------------------------------------------------------


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Stored records: one core and three surface forms per group, as the scoring wants them."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", C("o_orderstatus").alias("generation"))
    forms = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("form")
    r = o.select("*", forms)
    return r.select(
        F.concat_ws("-", "o_orderkey", "form").alias("qa_id"), F.lower(F.substring("o_orderpriority", 3, 2)).alias("language"), C("o_orderkey").cast("string").alias("knowledge_pair_id"),
        F.when(C("o_orderkey") % 2 == 0, "target").otherwise("neighbor").alias("topic_role"), F.when(C("form") == 0, "core").otherwise("surface").alias("variant_layer"),
        F.when((C("o_orderkey") + C("form")) % 3 == 0, F.concat(F.lit(" "), "generation")).otherwise(C("generation")).alias("cleaned_generation"), F.when(C("form") == 2, F.lit("F")).otherwise(C("generation")).alias("expected_answer"),
        F.create_map(F.lit("a_rouge"), F.lit(0.5)).alias("metrics"),
    )


def rescored(spark: SparkSession, d: str) -> DataFrame:
    """Stored generations checked, scored, written with summary and protocol, and read again."""
    base = scratch(spark, "rescored")
    files.write_lines(_records(spark, d), f"{base}/in")
    schema = "qa_id string, language string, knowledge_pair_id string, topic_role string, variant_layer string, cleaned_generation string, expected_answer string, metrics map<string,double>"
    back = rescoring.rescore(spark, f"{base}/in", schema, f"{base}/out", "a_exact")
    n = spark.read.json(f"{base}/out/protocol").agg(F.max("record_count").alias("n_protocol"))
    return rounded(back.groupBy("language", "topic_role").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(C("metrics")["a_exact"]).alias("a_exact"), F.min(C("metrics")["a_rouge"]).alias("a_rouge")).join(F.broadcast(n)))


def record_problems(spark: SparkSession, d: str) -> DataFrame:
    """What forbids scoring the question table as it is."""
    q = table(spark, d, "qa_variant").select("qa_id", "language", "knowledge_pair_id", "topic_role", "variant_layer")
    return rescoring.record_problems(q).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def objective_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of all objectives over lines: returned ones are forgotten, the rest retained."""
    li = table(spark, d, "lineitem").select("l_linestatus", F.when(C("l_returnflag") == "R", "forget").otherwise("retain").alias("side"), (C("l_discount") * 10).alias("nll"), (C("l_tax") * 10).alias("reference_nll"), C("l_quantity").alias("length"), C("l_discount").alias("kl"))
    plans = {
        "grad_ascent": {}, "grad_diff": {"gamma": 0.5, "alpha": 2.0}, "grad_diff_kl": {"retain": "kl"}, "npo": {"beta": 0.5}, "dr_npo": {"beta": 0.5, "sigma": 2.0}, "simnpo": {"beta": 2.0, "delta": 0.1},
        "dr_simnpo": {"beta": 2.0, "delta": 0.1, "sigma": 2.0, "robust_retain": True}, "combined": {},
    }
    parts = [metrics.objective(li, n.removesuffix("_kl"), "l_linestatus", **o).select("l_linestatus", F.lit(n).alias("objective"), "loss") for n, o in plans.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


def zlib_losses(spark: SparkSession, d: str) -> DataFrame:
    q = qa(spark, d).select("qa_id", "question").distinct()
    return q.select("qa_id", metrics.zlib_loss(F.length("question").cast("double"), C("question")).alias("loss"))


def cosine_checked(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against itself and, where its id is divisible by ten, as an empty candidate."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(e.select("vec_id", metrics.cosine_checked(C("embedding"), C("embedding"), C("vec_id") % 10 == 0).alias("cosine")), 4)


def choice_by_length(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(-C("l_quantity"), -C("l_discount") * 100, -C("l_tax") * 300).alias("s"))
    return li.select("l_orderkey", "l_linenumber", metrics.choice_by_length(C("s"), ["A", "BB", "CCC"]).cast("int").alias("choice"))


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and found members and held-out rows per language of the translated items."""
    g = generations(spark, d).select("language", "topic_role", "dataset_family", "culture_origin", "qa_id").distinct()
    return experiments.membership_counts(g, experiments.member_specification(spark, "common"))


def pending_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a sweep without those that finished (the ones of a third of the languages)."""
    grid = experiments.sweep(spark, "dr_simnpo", matrix.LANGUAGES)
    finished = grid.filter(C("source_language").isin(matrix.LANGUAGES[:3])).select(experiments.fingerprint(F.map_concat("parameters", F.create_map(F.lit("source_language"), "source_language"))).alias("fingerprint"))
    left = experiments.pending_runs(grid.withColumn("parameters", F.map_concat("parameters", F.create_map(F.lit("source_language"), "source_language"))), finished)
    return left.groupBy("source_language").agg(F.count(F.lit(1)).alias("n_runs"))


def anchored_pairs(spark: SparkSession, d: str) -> DataFrame:
    q = qa(spark, d).groupBy("qa_id").agg(F.max("split_role").alias("s"))
    forget, retain = (q.filter(C("s") == s).select(C("qa_id").alias("id")) for s in ("forget", "retain"))
    out = selection.anchored(forget, retain, "forget", "3")
    return out.select("id", "partner", "anchor")


def reissued_ids(spark: SparkSession, d: str) -> DataFrame:
    h = _holdout(spark, d).select("holdout_card_id").filter("holdout_card_id IS NOT NULL").distinct()
    return selection.reissue_ids(h, "sample__", "holdout_card_id")


def cached_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Card answers that a cache of answers' upper case under their SHA-256 knows, and those it lacks."""
    c = table(spark, d, "knowledge_card").select(C("answer").alias("text")).filter("answer IS NOT NULL")
    cache = c.filter(C("text").rlike("^[0-9]")).select(records.content_key(C("text")).alias("sha256"), F.lower("text").alias("translated"))
    known, lacking = records.cached_translations(c, cache)
    return known.select(records.content_key(C("text")).alias("sha256"), "translated").unionByName(lacking.select("sha256", F.lit(None).cast("string").alias("translated")))


def language_table(spark: SparkSession, d: str) -> DataFrame:
    return experiments.language_table(spark)


_NAMES = [
    cached_by_content, language_table, holdout_pairs, holdout_round_trip, shape_dispatch, role_cards, fixed_batches, first_pairs, wanted_pairs, source_index, english_with_cards, truncated_aliases, batch_defaults, upsert_in_order, variant_outcomes, warning_rows,
    enum_checks, manifest_problems, weight_checks, export_problems, export_long, export_matrix, review_table, qa_loaded, cache_digests, page_urls, parsed_translations, parsed_backs, parsed_verdicts, failed_defaults,
    verification_loop, repair_lookup, alias_repairs, missing_translations, rescored, record_problems, objective_values, zlib_losses, cosine_checked, choice_by_length, membership, pending_runs, anchored_pairs, reissued_ids,
]
QUERIES = {f.__name__: f for f in _NAMES}


# --- the same in SQL ---------------------------------------------------------------------------------------------

_H = "WITH h AS (SELECT DISTINCT * EXCLUDE (normalized_at) FROM holdout_card),\n"
_EN = "v AS (SELECT h.*, unnest(list_filter(coalesce(qa_variants, []), lambda v: lower(trim(v.language)) = 'en')) AS v, unnest(range(len(list_filter(coalesce(qa_variants, []), lambda v: lower(trim(v.language)) = 'en')))) AS pos FROM h)\n"
_ATT = """WITH fl AS (SELECT DISTINCT cache_id, target_language, attempt_history AS h FROM attempt_cache),
it AS (SELECT cache_id, unnest(range(len(h))) AS item_pos, unnest(h) AS it FROM fl WHERE len(h) > 0),
att AS (SELECT DISTINCT cache_id, CAST(item_pos AS INT) AS item_pos, it.source_qa_id AS source_qa_id, CAST(unnest(range(len(it.attempts))) AS INT) AS attempt_pos, unnest(it.attempts) AS a FROM it WHERE len(it.attempts) > 0)
"""
_SUM = GEN_SQL + """, s AS (SELECT relation_type AS checkpoint_id, dataset_family AS source_language, language AS evaluation_language, topic_role, avg(a_exact) FILTER (variant_layer = 'core') AS core, avg(a_exact) FILTER (variant_layer = 'surface') AS surface,
 count(*) FILTER (variant_layer = 'core') AS n_core, count(*) FILTER (variant_layer = 'surface') AS n_surface FROM gen WHERE relation_type IS NOT NULL GROUP BY ALL)
"""
_LANGS = ", ".join(f"'{x}'" for x in matrix.LANGUAGES)
_REC = """WITH r AS (SELECT o_orderkey, unnest(range(4)) AS form, lower(o_orderpriority[3:4]) AS language, o_orderstatus AS g FROM orders),
x AS (SELECT language, CASE WHEN o_orderkey % 2 = 0 THEN 'target' ELSE 'neighbor' END AS topic_role, CASE WHEN form <> 2 OR g = 'F' THEN 1.0 ELSE 0.0 END AS e FROM r)
"""


def _logsig(x: str) -> str:
    return f"(least({x}, 0.0) - ln(1 + exp(-abs({x}))))"


_NPO, _SIM = f"(-2/0.5 * {_logsig('0.5 * (nll - r)')})", f"(-2/2.0 * {_logsig('2.0 * (nll / greatest(n, 1) - 0.1)')})"
_DV = lambda x, s: f"(-{s} * ln(avg(exp(-{x} / {s})) FILTER (side = '%s')))"

ORACLE = {
    "cached_by_content": "SELECT DISTINCT sha256(answer) AS sha256, CASE WHEN regexp_matches(answer, '^[0-9]') THEN lower(answer) END AS translated FROM knowledge_card WHERE answer IS NOT NULL",
    "language_table": f"SELECT unnest([{_LANGS}]) AS language, unnest([{', '.join(repr(experiments.LANGUAGE_NAMES[x]) for x in matrix.LANGUAGES)}]) AS name, CAST(unnest(range(10)) AS INT) AS position",
    "holdout_pairs": _H + _EN + "SELECT DISTINCT source_pair_id AS pair_id, holdout_card_id AS knowledge_pair_id, 'target' AS topic_role, relation_type, CAST(pos AS INT) AS pos, v.qa_id AS qa_id, v.question AS question FROM v",
    "shape_dispatch": _H + _EN + """, a AS (SELECT source_topic_role AS topic_role, unnest(qa_variants) AS v FROM h WHERE len(qa_variants) > 0)
SELECT 'cards' AS shape, topic_role, v.variant_layer AS variant_layer, count(*) AS n_variants, count(DISTINCT v.qa_id) AS n_ids FROM a GROUP BY ALL
UNION ALL SELECT 'pairs', 'target', v.variant_layer, count(*), count(DISTINCT v.qa_id) FROM v GROUP BY ALL""",
    "role_cards": _H + "x AS (SELECT 1) SELECT DISTINCT holdout_card_id AS knowledge_pair_id, source_card_id AS card_id, answer, topic_name, source_page FROM h",
    "fixed_batches": "WITH q AS (SELECT qa_id, row_number() OVER (ORDER BY qa_id) - 1 AS i FROM (SELECT DISTINCT qa_id FROM qa_variant)) SELECT i // 20 AS batch, count(*) AS n_items, min(qa_id) AS first_id, CAST(max(i % 20) AS INT) AS last_at FROM q GROUP BY 1",
    "first_pairs": "SELECT DISTINCT pair_id, knowledge_pair_id FROM qa_variant WHERE knowledge_pair_id IS NOT NULL ORDER BY pair_id NULLS FIRST, knowledge_pair_id LIMIT 100",
    "wanted_pairs": "SELECT card_id, relation_type FROM (SELECT DISTINCT card_id, pair_id, topic_role, pos, relation_type FROM knowledge_card WHERE relation_type IN ('fire', 'medal')) ORDER BY pair_id, topic_role, pos, card_id LIMIT 50",
    "source_index": "SELECT knowledge_pair_id, qa_id, CAST(row_number() OVER (PARTITION BY knowledge_pair_id ORDER BY CASE WHEN topic_role = 'target' THEN 0 ELSE 1 END, qa_id) - 1 AS INT) AS source_pos FROM (SELECT DISTINCT knowledge_pair_id, topic_role, qa_id FROM qa_variant)",
    "english_with_cards": f"WITH c AS (SELECT card_id, max(fact_statement) AS card_fact FROM knowledge_card GROUP BY 1) SELECT DISTINCT q.qa_id, q.card_id, card_fact FROM qa_variant q LEFT JOIN c USING (card_id) WHERE topic_role = 'target' AND lower({ws('language')}) = 'en'",
    "truncated_aliases": _ATT + f", q AS (SELECT qa_id, greatest(coalesce(max(len(answer_aliases)), 0), 0) AS n FROM ({QA_SQL}) GROUP BY 1) SELECT cache_id, item_pos, attempt_pos, CAST(least(coalesce(len(a.translation.answer_aliases), 0), n) AS INT) AS n_aliases FROM att JOIN q ON qa_id = source_qa_id",
    "batch_defaults": """SELECT holdout_card_id, coalesce(min(CASE WHEN source_card_id IS NOT NULL THEN '{"source_card_id":"' || source_card_id || '"}' END), '{}') AS output FROM holdout_card WHERE holdout_card_id IS NOT NULL GROUP BY 1""",
    "upsert_in_order": f"""WITH q AS (SELECT qa_id, max(expected_answer) AS expected_answer FROM ({QA_SQL}) GROUP BY 1), s AS (SELECT i.source_qa_id AS qa_id, min(cache_id) AS pos FROM (SELECT cache_id, unnest(attempt_history) AS i FROM attempt_cache) GROUP BY 1),
u AS (SELECT qa_id, CASE WHEN qa_id LIKE '%surface1' THEN upper(expected_answer) ELSE expected_answer END AS expected_answer FROM q UNION ALL SELECT qa_id || 'x', expected_answer FROM q WHERE qa_id LIKE '%surface2')
SELECT u.qa_id, expected_answer, coalesce(pos, 1000000000) AS pos FROM u LEFT JOIN s USING (qa_id)""",
    "warning_rows": f"""WITH c AS (SELECT DISTINCT concat_ws('/', pair_id, topic_role) AS entity, pos, relation_type, semantic_slot, fact_statement, answer, answer_type, section_title, source_span FROM knowledge_card),
m AS (SELECT DISTINCT entity, pos, list_filter([CASE WHEN {slug('relation_type')} = '' THEN 'relation_type' END, {', '.join(f"CASE WHEN {ws(c)} = '' THEN '{c}' END" for c in ('semantic_slot', 'fact_statement', 'answer'))}, CASE WHEN {slug('answer_type')} = '' THEN 'answer_type' END,
 {', '.join(f"CASE WHEN {ws(c)} = '' THEN '{c}' END" for c in ('section_title', 'source_span'))}], lambda x: x IS NOT NULL) AS l FROM c)
SELECT entity, pos, entity || '/' || pos || ': ' || w AS warning FROM (SELECT entity, pos, unnest(l) AS w FROM m)""",
    "enum_checks": """WITH q AS (SELECT DISTINCT qa_id, topic_role, language, dataset_family FROM qa_variant) SELECT DISTINCT qa_id, 'topic_role' AS "column", topic_role AS value FROM q WHERE coalesce(topic_role, '') NOT IN ('target', 'neighbor')
UNION SELECT qa_id, 'language', language FROM q WHERE coalesce(language, '') <> 'en' UNION SELECT qa_id, 'dataset_family', dataset_family FROM q WHERE coalesce(dataset_family, '') NOT IN ('common', 'culture_specific')""",
    "manifest_problems": f"""WITH c AS (SELECT pair_id, topic_role, max(topic_name) AS name, min(relation_type) AS rel, arg_min(coalesce(lower(eval_priority), ''), (pos, coalesce(lower(eval_priority), ''))) AS p FROM knowledge_card GROUP BY 1, 2),
s AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS pos FROM (SELECT DISTINCT pair_id FROM knowledge_card)),
r AS (SELECT s.pos, x.side, c.* FROM s CROSS JOIN (VALUES ('target'), ('neighbor')) x(side) LEFT JOIN c ON c.pair_id = s.pair_id AND c.topic_role = x.side),
f AS (SELECT 'topic_pairs[' || pos || '].' || side AS context, 'no object' AS problem FROM r WHERE topic_role IS NULL UNION ALL
 SELECT 'topic_pairs[' || pos || '].' || side, 'role must be ' || side || ', got other' FROM r WHERE p = 'low' UNION ALL
 SELECT 'topic_pairs[' || pos || '].' || side, 'missing ' || u FROM r, (VALUES ('topic_zh'), ('topic_en')) y(u) WHERE topic_role IS NOT NULL AND {ws('name')} = '' UNION ALL
 SELECT 'topic_pairs[' || pos || '].' || side, 'missing wiki_title' FROM r WHERE topic_role IS NOT NULL AND {ws('rel')} = '')
SELECT context, problem, count(*) AS n FROM f GROUP BY ALL""",
    "weight_checks": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 100 = 3",
    "export_long": _SUM + f"SELECT checkpoint_id, source_language, evaluation_language, topic_role, 'a_exact' AS metric, 'core' AS variant, round(core, 6) AS score FROM s WHERE topic_role = 'target' AND evaluation_language IN ({_LANGS})",
    "export_matrix": _SUM + f"SELECT checkpoint_id, source_language, {', '.join(f'''round(max(surface) FILTER (evaluation_language = '{x}'), 6) AS {x}''' for x in matrix.LANGUAGES)} FROM s WHERE topic_role = 'target' AND evaluation_language IN ({_LANGS}) GROUP BY ALL",
    "export_problems": _SUM + f""", t AS (SELECT * FROM s WHERE topic_role = 'target'), fam AS (SELECT relation_type AS checkpoint_id, dataset_family AS source_language, language AS evaluation_language, bool_or(coalesce(dataset_family, '') NOT IN ('', 'common')) AS bad FROM gen WHERE relation_type IS NOT NULL AND topic_role = 'target' GROUP BY ALL),
w AS (SELECT checkpoint_id, source_language, list(DISTINCT evaluation_language) AS have FROM t GROUP BY ALL),
f AS (SELECT 'dataset_family' AS problem FROM fam WHERE bad UNION ALL SELECT 'form_counts' FROM t WHERE n_core <= 0 OR n_surface <> 3 * n_core UNION ALL SELECT 'not_finite' FROM t WHERE core IS NULL OR surface IS NULL
 UNION ALL SELECT 'weighted_sum' FROM t WHERE core IS NULL OR surface IS NULL UNION ALL SELECT 'missing_language' FROM w, (SELECT unnest([{_LANGS}]) AS x) WHERE NOT coalesce(list_contains(have, x), false))
SELECT problem, count(*) AS n FROM f GROUP BY 1""",
    "review_table": f"SELECT language, topic_role, count(*) AS n_rows, 0::BIGINT AS n_comments, count(DISTINCT qa_id) AS n_ids, 18 AS at_comment, 19 AS at_source_question FROM (SELECT qa_id, any_value(language) AS language, any_value(topic_role) AS topic_role FROM ({QA_SQL}) GROUP BY 1) WHERE language = 'en' GROUP BY ALL",
    "qa_loaded": f"SELECT variant_layer, count(*) AS n_rows FROM (SELECT qa_id, max(variant_layer) AS variant_layer, max(topic_role) AS topic_role FROM ({QA_SQL}) GROUP BY 1) WHERE topic_role = 'target' GROUP BY 1",
    "cache_digests": "SELECT knowledge_pair_id, sha1(string_agg(qa_id, '|' ORDER BY qa_id))[1:12] AS digest FROM (SELECT DISTINCT knowledge_pair_id, qa_id FROM qa_variant) GROUP BY 1",
    "page_urls": "SELECT DISTINCT topic_name, 'https://pages.example/' || replace(url_encode(replace(trim(topic_name), ' ', '_')), '%2F', '/') AS url FROM holdout_card WHERE topic_name IS NOT NULL",
    "parsed_translations": _ATT + "SELECT cache_id, item_pos, attempt_pos, source_qa_id, 'xx' AS language, a.translation.question AS question, a.translation.expected_answer AS expected_answer FROM att WHERE a.translation.question IS NOT NULL AND a.translation.expected_answer IS NOT NULL",
    "parsed_backs": _ATT + f"""SELECT cache_id, item_pos, attempt_pos, coalesce(nullif({ws('a.backtranslation_en.source_qa_id')}, ''), source_qa_id) AS source_qa_id, {ws('a.backtranslation_en.question')} AS question, {ws('a.backtranslation_en.expected_answer')} AS expected_answer,
 CAST(len(list_filter(coalesce(a.backtranslation_en.answer_aliases, []), lambda x: {ws('x')} <> '')) AS INT) AS n_aliases FROM att WHERE a.backtranslation_en.question IS NOT NULL AND a.backtranslation_en.expected_answer IS NOT NULL""",
    "parsed_verdicts": _ATT + f"""SELECT cache_id, item_pos, attempt_pos, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS verdict, ok AS is_consistent, {ws('a.consistency.failure_type')} AS failure_type
 FROM (SELECT *, coalesce(a.consistency.is_consistent, lower({ws('a.consistency.verdict')}) = 'passed') AS ok FROM att WHERE a.consistency.verdict IS NOT NULL OR a.consistency.is_consistent IS NOT NULL)""",
    "failed_defaults": _ATT + "SELECT cache_id, item_pos, attempt_pos, 'failed' AS verdict, false AS is_consistent, 'model_output_error' AS failure_type, 'no verdict' AS reason FROM att WHERE a.consistency IS NULL",
    "verification_loop": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR)[-1:]::INT AS x FROM orders)
SELECT CASE WHEN x BETWEEN 1 AND 3 THEN 'accepted' ELSE 'failed' END AS status, CAST(CASE WHEN x BETWEEN 1 AND 3 THEN x ELSE 3 END AS INT) AS n_attempts, CASE WHEN x BETWEEN 1 AND 3 THEN NULL WHEN x = 9 THEN 'model_output_error' ELSE 'drift' END AS failure_type,
 CASE WHEN x BETWEEN 1 AND 3 THEN NULL WHEN x = 9 THEN 'no JSON in the answer' ELSE 'differs' END AS reason, count(*) AS n_rows FROM o GROUP BY ALL""",
    "repair_lookup": """WITH fl AS (SELECT DISTINCT cache_id, attempt_history AS h FROM attempt_cache), it AS (SELECT unnest(h) AS it FROM fl WHERE len(h) > 0),
f AS (SELECT DISTINCT it.source_qa_id AS source_qa_id FROM it WHERE NOT coalesce(lower(it.attempts[-1].consistency.verdict) = 'passed', false) AND it.source_qa_id IS NOT NULL),
q AS (SELECT qa_id, bool_or(regexp_matches(coalesce(expected_answer, ''), '[0-9]')) AS r FROM qa_variant GROUP BY 1)
SELECT source_qa_id, CASE WHEN qa_id IS NULL THEN 'unknown_source' WHEN r THEN 'repaired' ELSE 'unrepaired' END AS state FROM f LEFT JOIN q ON qa_id = source_qa_id""",
    "holdout_round_trip": _H + _EN + """SELECT h.holdout_card_id, CAST(count(v.pos) AS INT) AS n_variants, coalesce(string_agg(v.v.qa_id, ',' ORDER BY v.pos), '') AS qa_ids FROM (SELECT DISTINCT holdout_card_id FROM h WHERE holdout_card_id IS NOT NULL) h LEFT JOIN v USING (holdout_card_id) GROUP BY 1""",
    "alias_repairs": _ATT + f""", q AS (SELECT qa_id, max(answer_aliases) AS l FROM ({QA_SQL}) GROUP BY 1), r AS (SELECT cache_id, item_pos, attempt_pos, len(l) AS n, {ws('a.translation.expected_answer')} AS e FROM att JOIN q ON qa_id = source_qa_id
 WHERE len(l) > 0 AND contains(lower(a.consistency.failure_type), 'alias') AND a.translation.expected_answer IS NOT NULL)
SELECT cache_id, item_pos, attempt_pos, CAST(n AS INT) AS n_source, CASE WHEN upper(e) <> e THEN upper(e) ELSE '' END AS aliases, 'translated source aliases only' AS note FROM r""",
    "missing_translations": "SELECT o_orderkey % 50 AS batch, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 7 = 0",
    "rescored": _REC + "SELECT language, topic_role, count(*) AS n_rows, round(avg(e), 6)::DOUBLE AS a_exact, 0.5::DOUBLE AS a_rouge, (SELECT count(*) FROM x) AS n_protocol FROM x GROUP BY ALL",
    "record_problems": """WITH q AS (SELECT * FROM qa_variant), f AS (SELECT 'repeated qa_id' AS problem FROM q GROUP BY qa_id HAVING count(*) > 1 UNION ALL SELECT 'empty qa_id' FROM q WHERE coalesce(qa_id, '') = ''
 UNION ALL SELECT 'invalid topic_role' FROM q WHERE coalesce(topic_role, '') NOT IN ('target', 'neighbor') UNION ALL SELECT 'invalid variant_layer' FROM q WHERE coalesce(variant_layer, '') NOT IN ('core', 'surface')
 UNION ALL SELECT 'one core and three surface forms expected' FROM q GROUP BY language, knowledge_pair_id, topic_role HAVING count(*) FILTER (variant_layer = 'core') <> 1 OR count(*) FILTER (variant_layer = 'surface') <> 3)
SELECT problem, count(*) AS n FROM f GROUP BY 1""",
    "objective_values": f"""WITH x AS (SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'forget' ELSE 'retain' END AS side, l_discount * 10 AS nll, l_tax * 10 AS r, l_quantity AS n, l_discount AS kl FROM lineitem),
v AS (SELECT l_linestatus, avg(nll / greatest(n, 1)) FILTER (side = 'forget') AS f, avg(nll / greatest(n, 1)) FILTER (side = 'retain') AS t, avg(kl) FILTER (side = 'retain') AS k, avg({_NPO}) FILTER (side = 'forget') AS npo, avg({_SIM}) FILTER (side = 'forget') AS sim,
 {_DV(_NPO, '2.0') % 'forget'} AS drn, {_DV(_SIM, '2.0') % 'forget'} AS drs, {_DV('nll', '2.0') % 'retain'} AS drt FROM x GROUP BY 1)
SELECT l_linestatus, unnest(['grad_ascent', 'grad_diff', 'grad_diff_kl', 'npo', 'dr_npo', 'simnpo', 'dr_simnpo', 'combined']) AS objective, round(unnest([-f, -0.5 * f + 2 * t, -f + k, npo + t, drn + t, sim + t, drs + drt, -f + t])::DOUBLE, 6) AS loss FROM v""",
    "cosine_checked": "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS cosine FROM embeddings",
    "choice_by_length": """WITH s AS (SELECT l_orderkey, l_linenumber, -l_quantity AS a, -l_discount * 100 / 2 AS b, -l_tax * 300 / 3 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INT) AS choice FROM s""",
    "membership": GEN_SQL + f""", r AS (SELECT DISTINCT language, topic_role, dataset_family, qa_id FROM gen), w AS (SELECT unnest([{_LANGS}]) AS language, unnest(['member', 'holdout']) AS split),
s AS (SELECT x AS language, y AS split FROM (SELECT unnest([{_LANGS}]) AS x), (SELECT unnest(['member', 'holdout']) AS y)), m AS (SELECT language, 'member' AS split, count(*) AS n FROM (SELECT DISTINCT language, topic_role, dataset_family, culture_origin, qa_id FROM gen WHERE topic_role = 'target') GROUP BY 1
 UNION ALL SELECT language, 'holdout', count(*) FROM r WHERE topic_role = 'holdout' AND dataset_family = 'holdout' GROUP BY 1)
SELECT language, split, 500 AS n_wanted, coalesce(n, 0) AS n_found, coalesce(n, 0) = 500 AS agrees FROM s LEFT JOIN m USING (language, split)""",
    "pending_runs": f"SELECT unnest([{', '.join(repr(x) for x in matrix.LANGUAGES[3:])}]) AS source_language, 24::BIGINT AS n_runs",
    "anchored_pairs": f"""WITH q AS (SELECT qa_id AS id, max(split_role) AS s FROM ({QA_SQL}) GROUP BY 1), p AS (SELECT id AS partner, row_number() OVER (ORDER BY id) - 1 AS position FROM q WHERE s = 'retain')
SELECT q.id, partner, 'forget' AS anchor FROM q JOIN p ON position = ('0x' || md5(q.id || '|3')[1:12])::BIGINT % (SELECT count(*) FROM p) WHERE s = 'forget'""",
    "reissued_ids": "SELECT holdout_card_id, 'sample__' || printf('%06d', row_number() OVER (ORDER BY holdout_card_id)) AS sample_id FROM (SELECT DISTINCT holdout_card_id FROM holdout_card WHERE holdout_card_id IS NOT NULL)",
}
ORACLE["membership"] = ORACLE["membership"].replace(f" w AS (SELECT unnest([{_LANGS}]) AS language, unnest(['member', 'holdout']) AS split),\n", "\n")
