import random
import re

import pytest
from pyspark.sql import functions as F

from polyquarry.functions import text as tx
from polyquarry.functions import udfs

SAMPLES = [None, "", " \t\n", "a b c", "Straße 3rd of Sept, No. 5", "École—Ünï", "ที่ 日本語 ع12", "Hello, World's end-game!", "x" * 20000, "__A__", "The BBC News"]


def values(spark, column, samples=SAMPLES):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normal_forms_match_python(spark):
    py = lambda s: re.sub(r"\s+", " ", s or "").strip()
    assert values(spark, tx.normalize_ws) == [py(s) for s in SAMPLES]
    assert values(spark, tx.match_key) == [re.sub(r"[^\w]+", " ", py(s).casefold()).strip() for s in SAMPLES]
    assert values(spark, tx.ascii_han_key) == [re.sub(r"[^a-z0-9一-鿿]+", " ", py(s).lower()).strip() for s in SAMPLES]
    assert values(spark, lambda c: tx.slug(c, "item")) == [re.sub(r"[^a-z0-9]+", "_", (s or "").lower()).strip("_") or "item" for s in SAMPLES]
    assert values(spark, tx.strip) == [(s or "").strip() for s in SAMPLES]


def test_words_and_acronyms(spark):
    assert values(spark, tx.canonical_words)[4] == ["strasse", "3", "of", "september", "no", "5"]
    assert values(spark, tx.acronym)[10] == "TBN"
    assert values(spark, tx.word_count)[7] == 3
    assert values(spark, tx.space_words)[:3] == [0, 0, 0]


@pytest.mark.parametrize(
    ("alias", "answer", "v1", "v2"),
    [
        ("a", "Paris", True, True), ("", "x", False, False), ("3rd July", "3 July", True, False), ("Class A type", "A", True, True), ("BBC", "British Broadcasting Corporation", True, True),
        ("in 1990", "year 1990", True, True), ("left right", "right left", True, True), ("Berlin", "Hamburg", False, False), ("東京", "东京都", False, False), ("北京", "北京市", True, True),
    ],
)
def test_alias_rules(spark, alias, answer, v1, v2):
    df = spark.createDataFrame([(alias, answer)], "a string, b string")
    r = df.select(tx.alias_equivalent_v1(F.col("a"), F.col("b")).alias("v1"), tx.alias_equivalent_v2(F.col("a"), F.col("b")).alias("v2")).first()
    assert (r.v1, r.v2) == (v1, v2)


def test_leakage_and_generation(spark):
    df = spark.createDataFrame([("Who founded the Old Mill in 1850?", "1850", ["Old Mill", "ab", None])], "q string, a string, l array<string>")
    r = df.select(tx.leaks(F.col("q"), F.col("a"), F.col("l"), F.lit("old mill")).alias("x"), tx.cut_generation(F.lit(" yes</s> no"), "</s>").alias("g"), tx.swap_language(F.lit("p__en__c__en__x"), "de").alias("s"), tx.strip_fence(F.lit("```json\n{}\n```")).alias("f")).first()
    assert (r.x, r.g, r.s, r.f) == (["1850"], "yes", "p__de__c__en__x", "{}")


def test_rouge_tokens_and_scores():
    assert udfs.mixed_tokens("日本 abc ที่") == ["日", "本", "abc", *"ที่"]
    assert udfs.mixed_tokens("متحف قديم") == ["متحف", "قديم"]
    assert udfs.rouge_l_f1("متحف قديم", "متحف قديم") == 1.0
    assert udfs.rouge_l_f1("", "x") == 0.0 and udfs.rouge_l_f1(None, None) == 0.0
    assert udfs.rouge_l_f1("the cat sat", "the cat ran") == pytest.approx(2 / 3)
    assert [udfs.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "generalizations", "controlling", "feed", "agreed")] == ["caress", "poni", "relat", "hop", "happi", "gener", "control", "feed", "agre"]


def test_lcs_against_brute_force():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert udfs.lcs(a, b) == slow(a, b)


def test_json_and_hashes(spark):
    df = spark.createDataFrame([('x {bad {"b":1, "a":[2]} y',), ("none",), (None,)], "t string")
    rows = df.select(udfs.first_json("t").alias("j"), udfs.canonical_sha256("t").alias("h"), udfs.zlib_length("t").alias("z")).collect()
    assert [r.j for r in rows] == ['{"a":[2],"b":1}', None, None]
    assert rows[1].h is None and rows[2].z == 8


def test_topic_sides_of_cards_with_one_field(spark, tmp_path):
    import duckdb

    from polyquarry.plans import texts

    cards = [("p1", "Rome", "capital", "city"), ("p2", "Rome", None, None), ("p3", None, None, None), ("p4", " vs ", None, "city"), (None, "Oslo", None, "city")]
    spark.createDataFrame(cards, "pair_id string, topic_name string, relation_type string, answer_type string").coalesce(1).write.parquet(str(tmp_path / "knowledge_card.parquet"))
    rows = {tuple(r) for r in texts.topic_sides(spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW knowledge_card AS SELECT * FROM read_parquet('{tmp_path}/knowledge_card.parquet/*.parquet')")
        assert rows == set(c.execute(texts.ORACLE["topic_sides"]).fetchall())
    assert ("p2", "Rome", None) in rows and ("p3", "", None) in rows and ("p1", "Rome", "capital vs city") in rows
