import pytest

from polyquarry.llm import language as g

PROFILES = g.fit(iter(()))
ONE = g.Identifier(PROFILES)


@pytest.mark.parametrize(
    ("text", "langs"),
    [
        ("The people of the town are free to act as they like.", {"en"}), ("Die Menschen sind frei und sollen mit Vernunft handeln.", {"de"}), ("Je ne sais pas répondre à cette question.", {"fr"}),
        ("No sé responder a esa pregunta.", {"es"}), ("Siwezi kujibu swali hilo kwa sasa.", {"sw"}), ("すべての人間は自由である。", {"ja"}), ("人人生而自由，他们有良心。", {"zh"}), ("ฉันไม่ทราบคำตอบ", {"th"}),
        ("Die Menschen sind frei geboren. Je ne sais pas répondre à cette question.", {"de", "fr"}), ("ฉันไม่สามารถช่วยคุณในเรื่องนี้ได้ The people are born free and equal.", {"th", "en"}),
        ("Q: من الذي أسس هذا المتحف؟", {"ar"}), ("人人生而自由。 すべての人間は自由である。", {"zh", "ja"}),
    ],
)
def test_languages(text, langs):
    found = ONE.languages(text)
    assert set(found) == langs and all(0 <= c <= 1 for c in found.values())


@pytest.mark.parametrize("text", ["", "  ", "123", "--", "?!", "١٢"])
def test_nothing_to_say(text):
    assert ONE.languages(text) == {}


@pytest.mark.parametrize(("text", "yes"), [("Ada Lovelace", False), ("1897", False), ("Paris", False), ("المتحف القديم", False), ("ムブ・タシマ", False), ("比布·佛多比", False), ("N/A", False), ("[]", False), ("", False), ("The museum was opened in 1900.", True), ("Museo Bafo perdió", True), ("1842年的一场火灾", True), ("書棚が焼けた。", True), ("Makumbusho ya Susoru", False)])
def test_sentences(text, yes):
    assert g.is_sentence(text) is yes


def test_codes(spark):
    df = spark.createDataFrame([(c,) for c in ("de-DE", " ger ", "German", "zh-Hans", "fr_FR", "und", "", None, "ES", "klingon")], "l string")
    assert [r.c for r in df.select(g.code_column(df.l).alias("c")).collect()] == ["de", "de", "de", "zh", "fr", None, None, None, "es", None]


def test_profiles_hold_out(spark, tiny):
    """Accuracy over labelled questions that were not in the sample."""
    from polyquarry.llm import attempts

    t = attempts.translations(spark.read.parquet(f"{tiny}/attempt_cache.parquet"))
    rows = [(r.c, r.question) for r in t.select(g.code_column(t.target_language).alias("c"), "question").distinct().collect() if r.c and r.question]
    train, test = rows[::2], rows[1::2]
    one = g.Identifier(g.fit(iter(train)))
    right = sum(c in one.languages(q) for c, q in test)
    # the labels themselves are wrong at times
    assert right >= 0.85 * len(test)


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([("de", f"some text number {i % 400}") for i in range(2000)] + [(None, "x" * 20), ("fr", "short"), ("fr", None)], "code string, text string")
    s = g.labelled_sample(df, 50)
    assert 0 < len(s) <= 50 and len(set(s)) == len(s) and {c for c, _ in s} == {"de"}
    assert g.labelled_sample(df.limit(0)) == []


def test_table_of_distances_equals_the_definition():
    d = g.Distances(PROFILES)
    for text in ("The people of the town", "Die Menschen sind frei", "人人生而自由", "xq zv", "ya watu wote"):
        doc = g.ranks(g.grams(text))
        want = {code: g.out_of_place(doc, p) for code, p in PROFILES.items()}
        assert all(want[c] == n for n, c in d(doc)) and {c for _, c in d(doc)} == {c for c, p in PROFILES.items() if any(x in p for x in doc)}


def test_many_at_once_equal_the_definition():
    texts = ["The people of the town are free", "Die Menschen sind frei", "人人生而自由", "xq zv 12", "", "123", "ya watu wote " * 300, "すべての人間は", "The The THE"]
    d = g.Distances(PROFILES)
    assert d.many(texts * 300) == [g.identify(t, d) for t in texts] * 300


def test_switch_inside_a_sentence():
    """Two languages of one script in one sentence come out as two parts that cover it; one language doesn't."""
    text = "Die Menschen sollen einander im Geiste der Freiheit begegnen und handeln while all human beings are born free and equal in dignity and rights"
    (rows,) = ONE.parts_many([text])
    assert [c for _, _, c, _ in rows] == ["de", "en"] and rows[0][0] == 0 and rows[0][1] == rows[1][0] and sum(r[1] for r in rows) == len(text)
    for one in ("All human beings are born free and equal in dignity and they should act towards one another in a spirit of brotherhood", "Alle Menschen sind frei und gleich an Würde geboren und sollen einander im Geiste der Brüderlichkeit begegnen"):
        assert len(ONE.parts_many([one])[0]) == 1


def test_parts_stand_where_they_say():
    text = "Die Menschen sind frei geboren. Je ne sais pas répondre à cette question. ฉันไม่ทราบคำตอบ (人人生而自由，他们有良心)"
    (rows,) = ONE.parts_many([text])
    assert [(c, text[a : a + n].strip()) for a, n, c, _ in rows] == [("de", "Die Menschen sind frei geboren"), ("fr", "Je ne sais pas répondre à cette question"), ("th", "ฉันไม่ทราบคำตอบ"), ("zh", "人人生而自由，他们有良心")]


def test_profiles_of_all_texts(spark):
    """No text is left out, however many there are: the last ones bring words that no sample of the bound holds."""
    words = ["Haus", "straße", "über", "gegen", "wetter", "maler"]
    rows = [("de", f"{words[i % 6]} und {words[i // 6 % 6]} am {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} Tor") for i in range(2 * g.PER_LANGUAGE)]
    rows += [("fr", f"la maison numéro {i} de la ville") for i in range(30)] + [("fr", "the people of the town are free to act")]
    df = spark.createDataFrame([*rows, *rows[:50], (None, "x" * 20), ("fr", "short"), ("fr", None)], "code string, text string")
    assert g.fitted(g.labelled(df)) == g.fit(iter(sorted(set(rows))))
    assert g.fitted(g.labelled(df.limit(0))) == g.fit(iter(()))
