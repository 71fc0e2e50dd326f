import json

from pyspark.sql import functions as F

from polyquarry.operators import cards, records


def test_leaves_and_write_back(spark):
    schema = "id int, name string, l array<string>, m map<string,int>, v map<string,string>, s struct<inner:string>, text string"
    df = spark.createDataFrame([(1, "n", ["a", "b"], {"k": 1}, {"t": "x"}, ("deep",), "clash"), (2, None, None, None, None, None, None), (3, " ", [], {}, {}, (None,), "")], schema)
    leaves = records.leaf_texts(df, "id", ["name", "s.inner"], ["l"], ["m"], ["v"])
    got = {(r.path, r.job_type, r.pos, r.text) for r in leaves.collect()}
    assert got == {("name", "scalar", None, "n"), ("s.inner", "scalar", None, "deep"), ("l", "list", "0", "a"), ("l", "list", "1", "b"), ("m", "map_keys", "k", "k"), ("v", "map_values", "t", "x")}
    t = leaves.select("text").distinct().filter("text <> 'x'").withColumn("translated", F.upper("text"))
    out = {r.id: r.translated for r in records.write_back(df.select("id"), "id", leaves, t).collect()}
    assert json.loads(out[1]["l_zh"])["v"] == ["A", "B"] and json.loads(out[1]["m_zh"])["v"] == {"K": "k"} and out[1]["v_zh"] is None and out[2] is None
    assert records.leaf_texts(df.limit(0), "id", ["name"]).count() == 0


def test_metric_maps(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 9.0}), (None, None)], "m map<string,double>, n map<string,double>")
    r = df.select(records.set_metric(F.col("m"), "a", F.lit(5)).alias("s"), records.merge_metrics(F.col("m"), F.col("n")).alias("g")).collect()
    assert r[0].s == {"a": 5.0, "b": 2.0} and r[0].g == {"a": 1.0, "b": 9.0} and r[1].s == {"a": 5.0} and r[1].g == {}
    w = spark.createDataFrame([("r", "x"), ("r", "y")], "run string, metric string")
    assert [p.metric for p in records.pending_metrics(w, w.limit(1)).collect()] == ["y"] and records.pending_metrics(w, w, True).count() == 2


def test_choices(spark):
    schema = "task string, doc_id int, link string, question_number int, correct_answer_num string, responses array<string>, acc double, acc_norm double"
    rows = [("t", 1, "example", 3, "2", ["[[-3]]", "-1.0", "[-2, true]", "[[[-4e0]]]"], 1.0, 1.0), ("t", 2, "e", 1, "9", ["-1", "-1", "-1", "-1"], None, None), ("t", 3, "e", 1, "1", ["-1"], None, None), ("t", 4, "e", 1, "1", ["-1", "-1", "-2", "-3"], 0.0, None), ("t", 5, None, None, None, None, None, None)]
    r = {x.doc_id: x for x in records.choice_records(spark.createDataFrame(rows, schema)).collect()}
    assert (r[1].item_id, r[1].predicted_option, r[1].gold_option, r[1].correct, r[1].problem) == ("example::question_3", "B", "B", 1, None)
    assert [r[i].problem for i in (2, 3, 4, 5)] == ["invalid correct_answer_num", "expected 4 choices", "disagrees with acc", "expected 4 choices"]
    a = spark.createDataFrame([("x", 0.5), ("y", 1.0)], "task string, acc double")
    assert records.macro_over_tasks(a, ["x", "y"]).first().macro_acc == 0.75 and records.macro_over_tasks(a, ["x", "y", "z"]).count() == 0


def test_variants(spark):
    schema = "holdout_card_id string, sequence int, language string, variant_layer string, question string, expected_answer string, answer_aliases array<string>, card_answer string, card_aliases array<string>, topic_name string, source_page string"
    rows = [
        ("h", 0, None, "Core", "Who?", "J. Doe", ["J Doe", "Old Mill"], "J. Doe", None, "Old Mill", None), ("h", 1, "en", "surface", "Is it 1850?", "in 1850", None, "1850", ["1850"], "T", "P"),
        ("h", 2, "fr", "core", "Q?", "a", None, "a", None, "T", None), ("h", 3, "en", "odd", "Q?", "a", None, None, None, "T", None), ("h", 4, "en", "core", " ", "a", None, None, None, "T", None), ("h", 5, "en", "core", "Q?", None, None, "a", None, "T", None), ("h", 6, "en", "core", "Q?", "Berlin", None, "Hamburg", None, "T", None),
    ]
    r = records.normalized_variants(spark.createDataFrame(rows, schema)).collect()
    assert [x.reject_reason for x in r] == [None, None, "invalid language", "invalid variant_layer", "missing question", "missing expected_answer", None]
    assert (r[0].qa_id, r[0].answer_aliases) == ("h__en__core", ["J Doe"])
    assert r[1].qa_id == "h__en__surface_001" and r[1].answer_aliases == ["in 1850"] and any("leakage" in w for w in r[1].warnings)
    assert r[6].expected_answer == "Hamburg" and r[6].warnings[:2] == ["question_answer_focus_mismatch", "unsafe_answer_alias"]


def test_training_inputs(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([1], [1, 9]), ([1], [1, 2, 3, 4, 5, 6])], "p array<int>, c array<int>")
    ids, labels = records.supervised(F.col("p"), F.col("c"), 9, 5)
    rows = df.select(ids.alias("i"), labels.alias("l"), records.padded(ids, F.lit(6), 0).alias("r"), records.padded(ids, F.lit(6), 0, "left").alias("x")).collect()
    assert [r.i for r in rows] == [[1, 2, 3, 4, 9], [1, 9], [1, 2, 3, 4, 9]] and [r.l for r in rows] == [[-100, -100, 3, 4, 9], [-100, 9], [-100, 2, 3, 4, 9]]
    assert rows[1].r == [1, 9, 0, 0, 0, 0] and rows[1].x == [0, 0, 0, 0, 1, 9]
    assert records.warmup_steps(1.0, 1000, 8, 4, 2) == 15 and records.parameter_grid(spark, a=[1, 2], b=[3]).count() == 2


def test_reshape_and_merge(spark):
    card = "array<struct<card_id string, fact string>>"
    df = spark.createDataFrame([("p", ([("a", "x"), ("b", None)],), ([("c", "y")],)), ("q", None, (None,))], f"pair_id string, target struct<knowledge_cards {card}>, neighbor struct<knowledge_cards {card}>")
    flat = cards.unnest_roles(df)
    assert sorted((r.pair_id, r.topic_role, r.pos, r.card_id) for r in flat.collect()) == [("p", "neighbor", 0, "c"), ("p", "target", 0, "a"), ("p", "target", 1, "b")]
    back = cards.nest_roles(flat, "card_id", "fact").first()
    assert [c.card_id for c in back.target_cards] == ["a", "b"] and [c.card_id for c in back.neighbor_cards] == ["c"]
    old, new = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string"), spark.createDataFrame([("2", "c"), ("3", "d")], "k string, v string")
    assert sorted(tuple(r) for r in cards.upsert(old, new, "k").collect()) == [("1", "a"), ("2", "c"), ("3", "d")]


def test_minted_ids_are_unique(spark):
    rows = [("X", "P", "target", 0), ("x", "P", "target", 1), ("p_target_x_02", "P", "target", 2), (None, "P", "neighbor", 0), ("X", "Q", "target", 0), (" ", "P", "neighbor", 4)]
    ids = [r.minted_id for r in cards.mint_ids(spark.createDataFrame(rows, "card_id string, pair_id string, topic_role string, pos int")).collect()]
    assert len(set(ids)) == 6 and {"p_target_x", "q_target_x", "p_neighbor_card_001", "p_neighbor_card_005"} <= set(ids)


def test_variants_accepted_as_in_the_loop(spark):
    import random

    rng = random.Random(6)
    rows = [(f"g{rng.randrange(3)}", i, rng.choice(["en", "EN ", "fr", None]), rng.choice(["core", "surface", "Surface"]), f"q{rng.randrange(6)}") for i in range(80)]
    want, state = [], {}
    for g, i, lang, layer, q in rows:
        core, surface, seen = state.setdefault(g, [0, 0, set()])
        if (lang or "en").strip().lower() != "en":
            continue
        k = layer.lower()
        if k == "core" and core or k == "surface" and surface >= 3 or q in seen:
            continue
        state[g][0 if k == "core" else 1] += 1
        seen.add(q)
        want.append(i)
    df = spark.createDataFrame(rows, "g string, i int, language string, variant_layer string, question string")
    assert sorted(r.i for r in cards.accept_variants(df, ["g"], "i").collect()) == want


def test_batches_by_count_and_size(spark):
    df = spark.createDataFrame([(i, 0 if i < 7 else 1, s) for i, s in enumerate([5, 5, 5, 1, 1, 1, 99, 3, None, 3])], "i int, shard int, size int")
    got = {r.i: (r.shard, r.batch) for r in cards.budget_batches(df, "i", "size", 3, 10, "shard").collect()}
    assert [got[i][1] for i in range(10)] == [0, 0, 1, 1, 1, 2, 3, 0, 0, 0]
