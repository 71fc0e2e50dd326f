import json

import pytest
from pyspark.sql import functions as F

from polyquarry.functions import metrics, parsing
from polyquarry.operators import cards, experiments, exports, linkage, ordering, quality, repairs, rescoring, shapes
from polyquarry.sources import connectors, files


def one(spark, *columns, value=None):
    return spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    ("answer", "question"),
    [
        ('{"translation": {"question": "q", "expected_answer": "a"}}', "q"), ('[3, {"translation": [{"question": "q", "expected_answer": "a"}]}]', "q"), ('{"question": "q", "expected_answer": null}', "q"),
        ('{"translations": [{"source_qa_id": "no", "question": "x"}, {"source_qa_id": " me ", "question": "q"}]}', "q"), ('{"translations": [{"source_qa_id": "no", "question": "x"}]}', "x"),
        ('{"translation": {}}', None), ("[]", None), ("", None), (None, None), ("no json", None), ('{"question": "q"}', None), ('"text"', None),
    ],
)
def test_translation_answers(spark, answer, question):
    r = one(spark, parsing.translation(F.col("x"), F.lit("me"), F.lit("de")), value=answer).c0
    assert (r and r.question) == question and (r is None or r.language == "de")


@pytest.mark.parametrize(("answer", "passed"), [('{"consistency": {"is_consistent": true, "verdict": "failed"}}', True), ('{"verdict": " Passed "}', True), ('{"is_consistent": "yes", "verdict": "failed"}', False), ('[{"verdict": "failed"}]', False), ("{}", None), (None, None)])
def test_verdicts(spark, answer, passed):
    r = one(spark, parsing.consistency(F.col("x")), value=answer).c0
    assert (r and r.is_consistent) == passed and (r is None or r.verdict == ("passed" if passed else "failed"))


def test_other_answers(spark):
    r = one(spark, parsing.back_translation(F.col("x"), F.lit("me")), value='{"backtranslations": [{"question": " a  b ", "expected_answer": "c", "answer_aliases": [" ", "d "]}]}').c0
    assert (r.source_qa_id, r.question, r.answer_aliases) == ("me", "a b", ["d"])
    assert one(spark, parsing.alias_answer(F.col("x")), value='{"answer_aliases": "none", "note": " n "}').c0.answer_aliases == []
    got = one(spark, parsing.translated_batch(F.col("x")), value='{"translations": [{"id": "1", "translation": "a"}, {"id": "2"}, {"text": "b"}]}').c0
    assert [(x.id, x.translated) for x in got] == [("1", "a")]
    asked = one(spark, parsing.prompt("Do it.", ["first", "second"], "{}", F.struct(F.lit(1).alias("a")))).c0
    assert "2. second" in asked and asked.endswith('{"a":1}')


def stub(verdicts):
    """A client factory: each check gives the next verdict; None breaks off with a service error."""

    def factory():
        said = iter(verdicts)

        def ask(request):
            answer = {"translation": {"question": "q", "expected_answer": "a", "answer_aliases": ["x", 1]}} if request["step"] in ("translate", "repair") else {"backtranslation": {"question": "q", "expected_answer": "a"}}
            if request["step"] == "check":
                v = next(said)
                if v is None:
                    raise connectors.ServiceError(500)
                answer = {"verdict": v, "failure_type": "f", "reason": "r"}
            return {"choices": [{"message": {"content": [{"text": json.dumps(answer)}]}}]}

        return ask

    return factory


@pytest.mark.parametrize(("verdicts", "status", "n"), [(["passed"], "accepted", 1), (["failed", "failed", "passed"], "accepted", 3), (["failed"] * 3, "failed", 3), ([None, "passed"], "accepted", 2)])
def test_verification_loop(spark, verdicts, status, n):
    rows = spark.createDataFrame([("s1", "de", "q?", "a", 1)], "source_qa_id string, language string, question string, expected_answer string, extra int")
    r = repairs.verified(rows, stub(verdicts)).first()
    assert (r.status, r.n_attempts) == (status, n) and (r.answer_aliases == (["x"] if status == "accepted" else []))
    assert repairs.verified(rows.limit(0), stub([])).count() == 0
    assert repairs.warnings_of(repairs.verified(rows, stub(verdicts))).count() == (status == "failed")


def test_lookup_and_alias_repairs(spark):
    failed = spark.createDataFrame([("a", "alias_drift", "de", "q", "Bo"), ("b", None, "de", "q", "x"), ("z", "ALIAS", "de", "q", "x"), ("c", "alias", "de", "q", "x")], "source_qa_id string, failure_type string, language string, question string, expected_answer string")
    sources = spark.createDataFrame([("a", "q", "Bo", ["B", "C"]), ("b", "q", "x", ["B"]), ("c", "q", "x", [])], "qa_id string, question string, expected_answer string, answer_aliases array<string>")
    fixed = spark.createDataFrame([("a", "2"), ("a", "1"), ("q", "0")], "source_qa_id string, expected_answer string")
    assert {(r.source_qa_id, r.state, r.repaired_answer) for r in repairs.lookup(failed, sources, fixed).collect()} == {("a", "repaired", "1"), ("b", "unrepaired", None), ("c", "unrepaired", None), ("z", "unknown_source", None)}
    asked = repairs.alias_requests(failed, sources)
    assert [r.source_qa_id for r in asked.collect()] == ["a"]
    rows = asked.withColumn("answer", F.lit('{"answer_aliases": ["Bo", "bo", "bo", "BO", "b o", "else"]}')).withColumn("topic_name", F.lit("T")).withColumn("source_page", F.lit("T"))
    (r,) = repairs.repaired_aliases(rows).collect()
    assert len(r.answer_aliases) <= 2 and "Bo" not in r.answer_aliases and "else" not in r.answer_aliases and r.note
    batch = spark.createDataFrame([(1, "a"), (1, "b")], "batch int, id string")
    said = spark.createDataFrame([(1, '{"translations": [{"id": "a", "text": "x"}]}')], "batch int, answer string")
    assert [r.id for r in repairs.missing_translations(batch, said).collect()] == ["b"]


SUMMARY = "checkpoint_id string, source_language string, evaluation_language string, topic_role string, core double, surface double, n_core long, n_surface long, families array<string>, origins array<string>, weighted double, core_weight double, surface_weight double"


def summaries(spark, **change):
    row = dict(core=0.5, surface=0.25, n_core=2, n_surface=6, families=["common"], origins=[""], weighted=0.3125, core_weight=0.25, surface_weight=0.75) | change
    return spark.createDataFrame([("k", "en", lang, "target", *row.values()) for lang in ("de", "en")], SUMMARY)


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, None), ({"weighted": 0.3125 + 1e-9}, "weighted_sum"), ({"weighted": 0.3125 + 1e-14}, None), ({"n_surface": 5}, "form_counts"), ({"core_weight": 0.3}, "weights"), ({"families": ["common", "culture_specific"]}, "dataset_family"),
        ({"core": None}, "not_finite"), ({"surface": float("nan")}, "not_finite"), ({"weighted": float("inf")}, "not_finite"), ({"families": []}, "dataset_family"), ({"n_core": 0, "n_surface": 0}, "form_counts"),
    ],
)
def test_export_refuses(spark, tmp_path, change, problem):
    s = summaries(spark, **change)
    found = {r.problem for r in exports.problems(s, "common", "target", ["de", "en"]).collect()}
    assert (problem in found) if problem else not found
    if problem:
        with pytest.raises(ValueError, match=problem):
            exports.export(s, str(tmp_path / "o"), "a_exact", "target", "common", languages=["de", "en"])


def test_export_writes_both_tables(spark, tmp_path):
    exports.export(summaries(spark), str(tmp_path / "o"), "a_exact", "target", "common", languages=["de", "en", ][:2], method="m")
    long = spark.read.option("header", True).csv(str(tmp_path / "o" / "long"))
    assert long.columns == exports.LONG and long.count() == 2
    wide = spark.read.option("header", True).csv(str(tmp_path / "o" / "matrix"))
    assert wide.columns == ["checkpoint_id", "source_language", "de", "en"] and wide.first().de == "0.3125"
    assert {(r.evaluation_language, r.problem) for r in exports.problems(summaries(spark), "common", "target", ["de", "en", "sw"]).collect()} == {("sw", "missing_language")}
    assert {r.problem for r in exports.problems(summaries(spark, families=["culture_specific"], origins=["en"]), "culture", "target", ["de", "en"]).collect()} == set()
    assert exports.long_rows(summaries(spark), "a_exact", "target", "core", source_only=True).count() == 1


def records(spark, rows):
    return spark.createDataFrame(rows, "qa_id string, language string, knowledge_pair_id string, topic_role string, variant_layer string, expected_answer string, cleaned_generation string, metrics map<string,double>")


GOOD = [(f"q{i}", "de", "k", "target", "core" if not i else "surface", "A", " A" if i else "B", {"a_rouge": 0.5}) for i in range(4)]


def test_rescoring(spark, tmp_path):
    files.write_lines(records(spark, GOOD), str(tmp_path / "in"))
    schema = "qa_id string, language string, knowledge_pair_id string, topic_role string, variant_layer string, expected_answer string, cleaned_generation string, metrics map<string,double>"
    back = rescoring.rescore(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), "a_exact")
    assert sorted((r.qa_id, r.metrics["a_exact"], r.metrics["a_rouge"]) for r in back.collect()) == [("q0", 0.0, 0.5), ("q1", 1.0, 0.5), ("q2", 1.0, 0.5), ("q3", 1.0, 0.5)]
    p = spark.read.json(str(tmp_path / "out" / "protocol")).filter("record_count = 4").first()
    assert len(p.input_sha256) == 64 and p.metric == "a_exact" and p.runs_model_generation is False
    document = json.loads(spark.read.json(str(tmp_path / "out" / "summary")).first().document)
    assert abs(document["by_role_language"]["de|target"] if isinstance(document["by_role_language"]["de|target"], float) else json.loads(document["by_role_language"]["de|target"])["access"]) - 0.75 < 1e-9
    for bad, told in (([(*GOOD[0][:3], "other", *GOOD[0][4:])] + GOOD[1:], "topic_role"), (GOOD[:3], "surface"), ([*GOOD, GOOD[0]], "repeated"), ([("", *GOOD[0][1:]), *GOOD[1:]], "empty")):
        files.write_lines(records(spark, bad), str(tmp_path / "bad"))
        with pytest.raises(ValueError, match=told):
            rescoring.rescore(spark, str(tmp_path / "bad"), schema, str(tmp_path / "o2"), "a_exact")
    with pytest.raises(ValueError):
        rescoring.scored(records(spark, GOOD), "other")


def test_loader(spark, tmp_path):
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    line = lambda i, **k: json.dumps({"qa_id": i, "role": "t", "answer_aliases": None} | k)
    (tmp_path / "a.jsonl").write_text(line("1") + "\n\n" + line("2", role="n") + "\n")
    (tmp_path / "b.jsonl").write_text(line("3") + "\n")
    schema = "qa_id string, role string, answer_aliases array<string>"
    rows = files.read_qa(spark, [a, b], schema, ["qa_id", "role"], {"role": ["t"]}, expected=2)
    assert sorted((r.qa_id, tuple(r.answer_aliases)) for r in rows.collect()) == [("1", ()), ("3", ())]
    with pytest.raises(Exception, match="expected 5 rows"):
        files.read_qa(spark, [a, b], schema, ["qa_id"], expected=5).collect()
    with pytest.raises(ValueError, match="repeated"):
        files.read_qa(spark, [a, a], schema, ["qa_id"])
    (tmp_path / "b.jsonl").write_text(line("4", role=" ") + "\n")
    with pytest.raises(ValueError, match="lacks role"):
        files.read_qa(spark, [b], schema, ["qa_id", "role"])


def test_lines_of_many_splits_are_numbered(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"id": str(i)}) + "\n" if i % 50 else "bad\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        rows = files.read_lines(spark, str(tmp_path / "x.jsonl"), "id string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r.id == str(r.line) if r.id else r.line % 50 == 0 and r.bad == "bad" for r in rows) and len(rows) == 2000


def test_small_helpers(spark):
    assert files.parse_keys(" a,b  a\nc ") == ["a", "b", "c"] and files.parse_keys(" ") == []
    assert files.settings(None, {"A": "1", "B": None}, {"B": "x"}) == {"A": "1", "B": "x"}
    with pytest.raises(ValueError, match="B"):
        files.settings(None, {"B": None}, {})
    r = one(spark, files.page_url(F.lit("http://a//"), F.lit("Bo b/é")), files.normalized_url(F.lit(" http://a/v1/ "), "/chat"), files.utc_now())
    assert r.c0 == "http://a/Bo_b/%C3%A9" and r.c1 == "http://a/v1/chat" and r.c2.endswith("+00:00")
    assert linkage.excluded_flags([" x ", "", "x"]) == [*linkage.EXCLUDED_FLAGS, "x"] and linkage.excluded_flags(["a"], False) == ["a"]
    assert quality.unresolved({"a": [1, {"b": "${x}"}], "c": "???", "d": "fine"}) == ["a[1].b", "c"]
    with pytest.raises(ValueError):
        experiments.metric_definition(spark, "m", "f", [], k="${x}")
    assert experiments.sweep(spark, "npo", ["de"]).count() == 6


def test_chat_client():
    tried, slept = [], []

    def post(key, request):
        tried.append((key, "response_format" in request))
        if len(tried) == 1:
            raise connectors.ServiceError(400)
        if len(tried) < 5:
            raise connectors.ServiceError(503, 9.0)
        return {"choices": [{"message": {"content": "yes"}}]}

    ask = connectors.chat(post, ["k1", "k2"], 3, slept.append)
    assert connectors.message_text(ask({"response_format": {}})) == "yes"
    assert tried[:3] == [("k1", True), ("k1", False), ("k2", True)] and slept == [9.0]
    judge = connectors.judge(lambda r: {"choices": [{"message": {"content": '{"score": 0.5}'}}]}, "x")
    assert judge({"a": 1}) == {"score": 0.5}
    with pytest.raises(ValueError):
        connectors.judge(lambda r: {"choices": [{"message": {"content": '{"score": 2}'}}]}, "x")({})


def test_message_and_score_columns(spark):
    for content in ("plain", [{"text": "a"}, {"text": "b"}], ""):
        answer = {"choices": [{"message": {"content": content}}]}
        assert one(spark, connectors.message_text_column(F.col("x")), value=json.dumps(answer)).c0 == connectors.message_text(answer)
    for text in ('{"score": 0.25}', '{"score": 1}', '{"score": 0.3}', '{"score": true}', '{"score": "1"}', '{"score": 1, "x": 2}', "no", "[1]"):
        assert one(spark, connectors.score_column(F.col("x")), value=text).c0 == connectors.score_of(text), text


def test_minted_ids_take_the_next_free_number(spark):
    rows = [("a", "p", "target", 0), ("a_02", "p", "target", 1), ("a", "p", "target", 2), ("a", "p", "target", 3), ("b", "p", "target", 4), ("b", "p", "neighbor", 5), (None, "p", "target", 6)]
    got = {(r.pos, r.minted_id) for r in cards.mint_ids(spark.createDataFrame(rows, "card_id string, pair_id string, topic_role string, pos int")).collect()}
    assert got == {(0, "p_target_a"), (1, "p_target_a_02"), (2, "p_target_a_03"), (3, "p_target_a_04"), (4, "p_target_b"), (5, "p_neighbor_b"), (6, "p_target_card_007")}


def test_long_chain_of_first_wins(spark):
    """A chain of 300 rows that alternately share keys: every second one is kept, by rounds and by groups."""
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}", "g") for i in range(300)]
    df = spark.createDataFrame(rows, "o int, a string, b string, g string")
    kept, seen = [], (set(), set())
    for o, a, b, _ in rows:
        if a not in seen[0] and b not in seen[1]:
            kept.append(o)
            seen[0].add(a)
            seen[1].add(b)
    assert sorted(r.o for r in ordering.first_wins(df, ["a", "b"], "o", ["g"], rounds=2).collect()) == kept
    assert sorted(r.o for r in ordering.first_wins(df.filter("o < 12"), ["a", "b"], "o").collect()) == [o for o in kept if o < 12]


def test_smallest_k_of_equal_prefixes(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BORDER_ROWS", 3)
    df = spark.createDataFrame([(f"aaaa{i:04x}",) for i in range(200)] + [("bbbb",), ("0000",)], "h string")
    assert sorted(r.h for r in ordering.smallest_k(df, "h", 21).collect()) == ["0000"] + [f"aaaa{i:04x}" for i in range(20)]
    assert ordering.smallest_k(df, "h", 999).count() == 202 and ordering.smallest_k(df.limit(0), "h", 5).count() == 0


def test_objectives(spark):
    rows = [("forget", 2.0, 1.0, 2, 0.5), ("forget", 4.0, 1.0, 2, 0.5), ("retain", 3.0, 1.0, 3, 0.25)]
    df = spark.createDataFrame(rows, "side string, nll double, reference_nll double, length int, kl double")
    loss = lambda n, **k: metrics.objective(df, n, **k).first().loss
    assert loss("grad_ascent") == -1.5 and loss("grad_diff", gamma=2.0, alpha=3.0) == 0.0 and loss("combined") == -0.5 and loss("grad_diff", retain="kl") == -1.25
    assert loss("dr_npo", sigma=1e6) == pytest.approx(loss("npo"), abs=1e-5)
    for bad in (("other", {}), ("combined", {"alpha": 2.0}), ("npo", {"retain": "kl", "robust_retain": True})):
        with pytest.raises(ValueError):
            metrics.objective(df, bad[0], **bad[1])
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, z array<double>")
    assert v.select(metrics.cosine_checked(F.col("z"), F.col("a"), F.lit(True)).alias("c")).first().c == 0.0
    with pytest.raises(Exception, match="finite length"):
        v.select(metrics.cosine_checked(F.col("z"), F.col("a"), F.lit(False)).alias("c")).collect()


def test_shapes_with_nulls(spark):
    kind = "holdout_card_id string, source_card_id string, source_pair_id string, source_topic_role string, relation_type string, topic_name string, topic_type string, source_page string, source_url string, semantic_slot string, fact_statement string, answer string, answer_type string, source_span string, qa_variants array<struct<qa_id:string,variant_layer:string,language:string,question:string,expected_answer:string,answer_aliases:array<string>>>"
    v = ("q1", "core", " EN ", "q", "a", None)
    df = spark.createDataFrame([("h1", "c1", *[None] * 12, [v, ("q2", "core", "de", "q", "a", [])]), ("h2", None, *[None] * 12, None), (None, None, *[None] * 12, [])], kind)
    p = shapes.holdout_as_pairs(df)
    assert [r.qa_id for r in shapes.variants(p).collect()] == ["q1"] and sorted(r.qa_id for r in shapes.variants(df).collect()) == ["q1", "q2"]
    back = {r.holdout_card_id: r.qa_variants for r in shapes.pairs_as_holdout(df, p).collect()}
    assert back["h1"][0].source_card_id == "c1" and back["h2"] == []
    assert shapes.batches(spark.createDataFrame([(i,) for i in range(5)], "i int"), 2, "i").filter("batch = 2").count() == 1
    m = spark.createDataFrame([(0, "p", "t", ("target", "x"), None), (1, " ", "t", ("neighbor", ""), ("neighbor", "y"))], "pos int, pair_id string, topic_type string, target struct<role:string,name:string>, neighbor struct<role:string,name:string>")
    assert {(r.context, r.problem) for r in quality.manifest_problems(m, ["name"]).collect()} == {("topic_pairs[0].neighbor", "no object"), ("topic_pairs[1]", "missing pair_id"), ("topic_pairs[1].target", "role must be target, got neighbor"), ("topic_pairs[1].target", "missing name")}


def test_seeds_over_the_cap(spark, tiny):
    c = spark.read.parquet(f"{tiny}/knowledge_card.parquet")
    seeds = c.filter("topic_role = 'target'").select("pair_id", F.col("card_id").alias("target_card_id"), F.concat("card_id", F.lit("x")).alias("neighbor_card_id")).distinct()
    with pytest.raises(Exception, match="seeds are more than"):
        linkage.greedy_match(c, max_pairs=1, seeds=seeds).collect()


def test_registry(spark):
    from polyquarry import registry

    assert registry.operator("access.by_knowledge").__name__ == "by_knowledge" and "evaluate_em" in registry.names()
    with pytest.raises(KeyError):
        registry.operator("nothing")
    with pytest.raises(ValueError):
        registry.register("evaluate_em")(print)
    em = registry.operator("evaluate_em")(records(spark, GOOD))
    assert em["by_role_language"].first().access == pytest.approx(0.75)
    scores = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9)], "attack string, is_holdout int, score double")
    assert registry.operator("evaluate_membership")(scores).first().auc == 1.0


def test_relation_profile(spark):
    from polyquarry.operators import records as r

    topics = spark.createDataFrame([("t",), ("u",)], "topic_type string")
    hints = spark.createDataFrame([("t", "multi_instance_priority", ["a", "b"]), ("t", "short_answer_examples", ["x", "y"])], "topic_type string, kind string, relations array<string>")
    got = {x.topic_type: x.profile.split("\n") for x in r.relation_profile(topics, hints).collect()}
    assert got["t"][1] == "Multi-instance priority relations: a, b" and got["t"][-1] == "Short-answer examples to prefer: x; y" and len(got["u"]) == 3


def test_scratch_is_removed(spark, tmp_path):
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(files.__file__.rsplit('/', 3)[0])!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {(tmp_path / 'c').as_uri()!r}).getOrCreate()
from polyquarry.session import scratch
p = scratch(s, "x"); s.range(3).write.parquet(p); assert s.read.parquet(p).count() == 3
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    assert not [x for x in (tmp_path / "c").rglob("x-*")]


def test_languages_manifests_and_caches(spark):
    assert len(experiments.resolve_languages("ALL")) == 9 and experiments.resolve_languages("de, fr,de") == ["de", "fr"] and shapes.cache_suffix(3) == "en__surface3"
    for bad in ("en", "xx", " "):
        with pytest.raises(ValueError):
            experiments.resolve_languages(bad)
    kind = "pos int, pair_id string, topic_type string, target struct<role:string,name:string>, neighbor struct<role:string,name:string>"
    fine = spark.createDataFrame([(0, "p", "t", ("target", "x"), ("neighbor", "y"))], kind)
    assert quality.require_manifest(fine, ["name"]).count() == 1
    for bad in (fine.limit(0), fine.withColumn("pair_id", F.lit(" "))):
        with pytest.raises(quality.ManifestError):
            quality.require_manifest(bad, ["name"])
    from polyquarry.operators import records as r

    leaves = spark.createDataFrame([("a",), ("a",), ("x" * 50000,)], "text string")
    cache = leaves.limit(1).select(r.content_key(F.col("text")).alias("sha256"), F.lit("A").alias("translated"))
    known, lacking = r.cached_translations(leaves, cache)
    assert [tuple(x) for x in known.collect()] == [("a", "A")] and [len(x.text) for x in lacking.collect()] == [50000]
