from polyquarry.operators import nested

HISTORY = (
    "array<struct<source_qa_id string, attempts array<struct<attempt int, translation struct<question string, expected_answer string, answer_aliases array<string>, translation_note string>,"
    " backtranslation_en struct<source_qa_id string, question string, expected_answer string, answer_aliases array<string>>, consistency struct<verdict string, is_consistent boolean,"
    " failure_type string, reason string, repair_instruction string>>>>>"
)
SCHEMA = "cache_id long, prompt_version string, knowledge_pair_id string, source_language string, target_language string, model_name string, api_base string, attempt_history " + HISTORY + ", generated_at timestamp, ingested_at timestamp, item_pos int"


def row(i, history):
    return (i, "v", "k", "en", "de", "m", "u", history, None, None, 7)


def sample():
    t = ("q?", "a", ["x", None, ""], None)
    full = (1, t, ("s", "bq", "ba", None), ("passed", True, "", "", ""))
    return [
        row(1, [("s", [full, (2, None, None, None), (3, ("q", None, None, None), None, ("failed", False, None, None, None))])]),
        row(1, [("s", [full, (2, None, None, None), (3, ("q", None, None, None), None, ("failed", False, None, None, None))])]),
        row(2, None), row(3, []), row(4, [("s", None), (None, []), None]), row(5, [("s", [None])]),
    ]


def test_nothing_is_lost(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    keys = sorted(tuple(r) for r in nested.attempt_keys(df).collect())
    assert keys == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, -1, -1), (3, -1, -1), (4, 0, -1), (4, 1, -1), (4, 2, -1), (5, 0, 0)]


def test_tables_keep_parents_and_variants(spark):
    t = nested.flatten(spark.createDataFrame(sample(), SCHEMA))
    assert sorted(r.cache_id for r in t["files"].collect()) == [1, 2, 3, 4, 5]
    items = {(r.cache_id, r.item_pos): r.n_attempts for r in t["items"].collect()}
    assert items == {(1, 0): 3, (4, 0): None, (4, 1): 0, (4, 2): None, (5, 0): 1}
    variants = {(r.cache_id, r.attempt_pos): r.variant for r in t["attempts"].collect()}
    assert variants == {(1, 0): "translation+backtranslation_en+consistency", (1, 1): "bare", (1, 2): "translation+consistency", (5, 0): "bare"}
    assert {(r.origin, r.alias_pos, r.alias) for r in t["aliases"].collect()} == {("translation", 0, "x"), ("translation", 1, None), ("translation", 2, "")}
    assert t["aliases"].count() == 3
    # every attempt stands in exactly one subtype table
    subtypes = [n for n in t if n.startswith("attempts__")]
    assert len(subtypes) == 8 and sum(t[n].count() for n in subtypes) == 4
    assert t["attempts__translation+consistency"].first().verdict == "failed"


def test_automaton_states(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    states = {r.s for r in df.select(nested.shape(df.attempt_history, df.schema["attempt_history"].dataType).alias("s")).collect()}
    assert {"n", "[]"} <= states and any("attempts:n" in s for s in states)


def test_empty(spark):
    t = nested.flatten(spark.createDataFrame([], SCHEMA))
    assert all(f.count() == 0 for n, f in t.items())
