import unicodedata

import pytest

from polyquarry.llm import lookalikes as k


@pytest.mark.parametrize(
    ("value", "plain"),
    [
        ("Ａｂｃ １２", "Abc 12"), ("é", "é"), ("a​b­c", "abc"), ("a b c　d", "a b c d"), ("Tеatro", "Teatro"), ("Μakumbushο", "Makumbusho"), ("ﾊﾞﾅ", "バナ"), ("ヴォ八マ", "ヴォハマ"),
        ("ホミへメダル", "ホミヘメダル"), ("เเหล่ง", "แหล่ง"), ("বো", "বো"), ("حﺩيقة", "حديقة"), ("فی", "في"), ("⽐扎菲", "比扎菲"), ("年", "年"), ("ﬁn", "fin"), ("19O4", "1904"), ("École а été", "École a été"),
    ],
)
def test_made_plain(value, plain):
    assert k.mapped(value) == plain
    assert k.mapped(plain) == plain, "the form is stable"


@pytest.mark.parametrize("value", ["β-Hedetezo", "胡索，剧院？", "a\tb\nc", "1987年", "カメラ一台", "ড়", "ที่", "“x” — y…", "2²", "", "Q: متحف؟", "ナイフ・フォーク", "μ", "Straße", "¿Qué?"])
def test_left_alone(value):
    assert k.mapped(value) == unicodedata.normalize("NFC", value)


def test_null():
    assert k.mapped(None) is None


def test_one_form_per_class(spark):
    rows = [(1, "Teatro"), (2, "Tеatro"), (3, "Te​atro"), (4, "teatro"), (5, "Téatro"), (6, "Téatro"), (7, None), (8, ""), (9, "１２"), (10, "x" * 40000 + "​"), (11, "Tеatro")]
    df = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], "id int, value string, canonical string, salt int")
    got = {r.id: r.canonical for r in k.unify(df).collect()}
    assert len(got) == len(rows)
    assert {got[i] for i in (1, 2, 3, 11)} == {"Teatro"} and got[4] == "teatro" and got[5] == got[6] == "Téatro"
    assert got[7] is None and got[8] == "" and got[9] == "12" and got[10] == "x" * 40000
    assert k.unify(df.limit(0)).count() == 0


def test_prefilter_misses_nothing(spark, tiny):
    from polyquarry.llm import queries

    rows = queries._answer_values(spark, tiny).collect()
    want = {(r.cache_id, r.item_pos, r.attempt_pos, r.field_name, r.alias_pos) for r in rows if k.mapped(r.value) != r.value}
    got = {tuple(r) for r in queries.p6_found(spark, tiny).collect()}
    assert got == want and want
