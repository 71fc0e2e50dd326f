import random

import pytest
from pyspark.sql import functions as F

from polyquarry.functions import metrics
from polyquarry.operators import access, matrix, quality, translation


def test_exact_and_weights(spark):
    rows = [("de", "k", "target", layer, e, g) for layer, e, g in (("core", "Answer", " Answer "), ("surface", "Answer", "answer"), ("surface", "Answer", "Answer."), ("surface", "Answer", "Answer"))]
    df = spark.createDataFrame(rows, "language string, knowledge_pair_id string, topic_role string, variant_layer string, e string, g string").withColumn("m", metrics.exact(F.col("g"), F.col("e")))
    assert [r.m for r in df.collect()] == [1.0, 0.0, 0.0, 1.0]
    (r,) = access.by_knowledge(df, "m").collect()
    assert r.n_rows == 4 and r.access == pytest.approx(0.5)
    assert quality.form_violations(df, ["knowledge_pair_id", "topic_role"]).count() == 0
    assert quality.form_violations(df.filter("variant_layer = 'core'"), ["knowledge_pair_id", "topic_role"]).count() == 1


def test_null_layer_keeps_its_weight_to_itself(spark):
    df = spark.createDataFrame([("de", "k", "t", "core", 1.0), ("de", "k", "t", "surface", None), ("de", "j", None, "other", 1.0)], "language string, knowledge_pair_id string, topic_role string, variant_layer string, m double")
    got = {r.knowledge_pair_id: r.access for r in access.by_knowledge(df, "m").collect()}
    assert got == {"k": pytest.approx(0.25), "j": pytest.approx(1.0)}
    all_null = df.withColumn("m", F.lit(None).cast("double"))
    assert {r.access for r in access.by_knowledge(all_null, "m").collect()} == {None}


def test_grouping_sets_once_per_value(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "x", None), ("b", "x", 0.0)], "k string, j string, m double")
    got = {(r.grouping, r.value): (r.n_rows, r.mean_m) for r in access.grouping_summary(df, ["k", "j"], ["m"]).collect()}
    assert got == {("k", "a"): (2, 1.0), ("k", "b"): (1, 0.0), ("j", ""): (1, 1.0), ("j", "x"): (2, 0.0), ("overall", ""): (3, 0.5)}


def test_auc_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("g", float(rng.randrange(6)), rng.randrange(2)) for _ in range(80)] + [("one", 1.0, 1), ("tie", 1.0, 0), ("tie", 1.0, 1)]
    got = {r.g: r.auc for r in metrics.auc(spark.createDataFrame(rows, "g string, s double, y int"), "s", "y", "g").collect()}
    p, n = [s for g, s, y in rows if g == "g" and y], [s for g, s, y in rows if g == "g" and not y]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n)
    assert got == {"g": pytest.approx(want), "one": None, "tie": pytest.approx(0.5)}
    two = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "s double, y int")
    assert metrics.auc(two, "s", "y").first().auc == 1.0


def test_vector_and_choice_scores(spark):
    df = spark.createDataFrame([([2.0, 0.0], [0.0, 3.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(metrics.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, pytest.approx(1.0), None, None]
    one = spark.createDataFrame([([-3.0, -1.0, -2.0, -1.0],)], "s array<double>")
    r = one.select(metrics.choice(F.col("s")).alias("c"), metrics.min_k(F.col("s"), 0.5).alias("m"), metrics.mean_loss(F.col("s")).alias("l"), metrics.min_k(F.array().cast("array<double>")).alias("e")).first()
    assert (r.c, r.m, r.l, r.e) == (1, 2.5, 1.75, 0.0)
    v = spark.createDataFrame([("g", 1000.0), ("g", 1000.0), ("g", None)], "g string, v double")
    assert metrics.log_mean_exp(v, "v", 1.0, "g").first().value == pytest.approx(1000.0)
    assert metrics.log_mean_exp(v, "v", 1.0).first().value == pytest.approx(1000.0)


def test_transfer_family(spark):
    before = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 0.5), ("j", "a", 0.0)], "item string, target string, value double")
    after = spark.createDataFrame([("i", "a", "a", 0.0), ("i", "a", "b", 0.5), ("i", "b", "a", 0.5), ("i", "b", "b", 0.25)], "item string, source string, target string, value double")
    t = {(r.source, r.target): r.value for r in matrix.transfer(before, after).collect()}
    assert t == {("a", "a"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.5, ("b", "b"): 0.5}
    d = {(r.source, r.target): r.value for r in matrix.damage(matrix.retention(before, after)).collect()}
    assert d == {k: pytest.approx(v) for k, v in t.items()}
    g = matrix.globality(matrix.transfer(before, after)).first()
    assert g.globality == pytest.approx(0.25 / 0.75, abs=1e-5) and g.locality == pytest.approx(1 - 0.25 / 0.75, abs=1e-5)
    assert matrix.asymmetry(matrix.transfer(before, after)).first().asymmetry == pytest.approx(0.5)


def test_diagnostics(spark):
    s = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "qa_id string")
    t = spark.createDataFrame([("a", "DE ", 1), ("a", "de", 2), ("b", "fr", 3), ("zz", "de", 4), (None, "de", 5)], "source_qa_id string, language string, pos int")
    got = sorted((r.finding, r.source_qa_id, r.pos) for r in translation.diagnose(s, t, "de").collect())
    assert got == [("duplicate", "a", 2), ("mismatched_language", "b", 3), ("missing", "b", None), ("unknown_source", "", 5), ("unknown_source", "zz", 4)]


def test_reviews(spark):
    raw = spark.createDataFrame([("1", "yes", "weird", "", "5", "0", None, "x"), ("2", "no", "", "Typo", "3", "4", "2", "-1")], "id string, overall_pass string, severity string, issue_type string, faithfulness_score string, answer_accuracy_score string, fluency_score string, language_purity_score string")
    r = {x.id: x for x in translation.normalized_reviews(raw).collect()}
    assert (r["1"].severity, r["2"].severity, r["1"].issue_type) == ("minor", "ok", "none")
    s = translation.review_summary(translation.normalized_reviews(raw)).first()
    assert (s.sample_size, s.pass_count, s.avg_faithfulness_score, s.avg_answer_accuracy_score, s.avg_language_purity_score) == (2, 1, 4.0, 4.0, 0.0)


def test_expectations(spark):
    df = spark.createDataFrame([("a", " ", 1.0), ("a", "x", float("nan")), ("b", None, None)], "k string, f string, v double")
    assert quality.duplicate_keys(df, "k").collect()[0].n_rows == 2
    assert quality.missing_fields(df, "k", ["k", "f"]).count() == 2
    assert quality.not_finite(df, "k", "v").count() == 2
    assert quality.in_filters(df, {"k": "a, c", "f": None}).count() == 2
    assert quality.require(df, 3).count() == 3
    with pytest.raises(Exception, match="expected 4"):
        quality.require(df, 4).collect()
    js = spark.createDataFrame([('["x","y"]',), ('"z"',), ("null",), (None,), ("7",)], "a string")
    assert [r.x for r in js.select(quality.coerce_aliases(F.col("a")).alias("x")).collect()] == [["x", "y"], ["z"], [], [], ["7"]]
