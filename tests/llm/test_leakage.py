import random

from polyquarry.llm import leakage as k

SPAN = "Bobo Museum was founded by Ada Kiki in 1823. The collection of Bobo Museum holds 1,200 objects from Zaza. This page has not been reviewed."
ITEMS = [("i1", SPAN, 1), ("i2", "1876年的一场火灾烧毁了比布博物馆的230个书架。比布博物馆位于法索古城，距离海岸大约662公里。", 1), ("i3", None, 1), ("i4", "", 1), ("i5", "Koko School won a medal in 1900. This page has not been reviewed.", 1)]


def leaks(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    return {tuple(r) for r in k.leaks(docs, spark.createDataFrame(ITEMS, "item_id string, source_span string, doc_id int")).collect()}


def test_what_counts(spark):
    texts = [
        "Nothing. Bobo Museum was founded by Ada Kiki in 1823. More.",  # 0 whole
        "BOBO  museum was\nfounded by ada kiki in １８２３ — and so on",  # 1 case, breaks, forms
        "Bobo Museum was established by Ada Kiki in 1823.",  # 2 one word exchanged
        "Bobo Museum was founded by Ada Kiki in 1824.",  # 3 another year
        "Bobo Museum was founded by Eva Kiki in 1823.",  # 4 another name
        "Bobo Museum was founded by Ada",  # 5 a part of a sentence
        "This page has not been reviewed.",  # 6 the notice
        "The collection of Bobo Museum holds 1200 objects from Zaza",  # 7 figures written otherwise
        "1876年的一场大火烧毁了比布博物馆的230个书架",  # 8 one word exchanged, no spaces
        "1876年的一场火灾烧毁了比布博物馆的231个书架。",  # 9 another figure
        None, "", "x " * 30000, "Bobo Museum Bobo Museum 1823",
    ]
    assert leaks(spark, texts) == {(0, "i1"), (1, "i1"), (2, "i1"), (7, "i1"), (8, "i2")}


def test_against_brute_force(spark):
    """Random texts of sentences: exactly the documents that hold a whole sentence are found."""
    rng = random.Random(1)
    sentences = [f"{a} {b} was built in {y} near {c}." for a, b, y, c in ((rng.choice(["Bobo", "Kiki", "Zaza"]), rng.choice(["Museum", "School"]), rng.randrange(1800, 1810), rng.choice(["Fofo", "Gugu"])) for _ in range(60))]
    items = [(f"i{n}", " ".join(rng.sample(sentences, 2)), 0) for n in range(6)]
    docs = [" ".join(rng.choice(sentences) for _ in range(3)) for _ in range(60)]
    want = {(d, i) for d, t in enumerate(docs) for i, span, _ in items for s in span.split(".") if s.strip() and s.strip() in t}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {tuple(r) for r in k.leaks(df, spark.createDataFrame(items, "item_id string, source_span string, z int")).collect()}
    assert got == want


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(k, "BLOCK", 2)
    assert leaks(spark, ["Koko School won a medal in 1900.", SPAN]) == {(0, "i5"), (1, "i1")}
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, source_span string, doc_id int")
    assert k.leaks(docs, items).count() == 0
    assert k.leaks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_notices_are_told_from_the_passages(spark):
    """A figureless last sentence without a word of the passage's subject is a notice, in one passage as in
    many; a figureless sentence about the subject counts however many documents hold it."""
    spans = {"a": "Visitors may enter Bobo freely. Bobo Hall opened in 1900.", "b": "Archiv Kiki hat seit 1900 Gäste. Archiv Kiki steht in Zaza. Diese Seite wurde noch nicht geprüft.", "c": "比布博物馆建于1900年。比布博物馆的收藏很多。此页面是主题目录的一部分，尚未审核。"}
    items = spark.createDataFrame([(i, x, 0) for i, x in spans.items()], "item_id string, source_span string, x int")
    texts = ["Visitors may enter Bobo freely."] * 40 + ["Bobo Hall opened in 1900.", "Diese Seite wurde noch nicht geprüft.", "此页面是主题目录的一部分，尚未审核。", "比布博物馆的收藏很多。"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in k.leaks(docs, items).collect()} == {(n, "a") for n in range(41)} | {(43, "c")}
    assert {tuple(r) for r in k.leaks(docs, items, notices=True).collect()} == {(41, "b"), (42, "c")}


def test_few_words(spark):
    """Sentences of two or three words are looked for where they hold a figure, and then without exchange."""
    items = spark.createDataFrame([("a", "Opened 1923. Very nice.", 0)], "item_id string, source_span string, x int")
    docs = spark.createDataFrame([(0, "It was opened, 1923, they say."), (1, "Very nice."), (2, "Closed 1923.")], "doc_id long, text string")
    assert {tuple(r) for r in k.leaks(docs, items).collect()} == {(0, "a")}


def test_sentence_held_by_many_items(spark):
    """A sentence that a third of the items repeat leaks for each of them."""
    items = spark.createDataFrame([(f"i{n}", f"Bobo Hall opened in 1900. Item number {n} was sold.", 0) for n in range(133)], "item_id string, source_span string, x int")
    docs = spark.createDataFrame([(1, "Bobo Hall opened in 1900."), (2, "Bobo Hall opened in 1901.")], "doc_id long, text string")
    assert {tuple(r) for r in k.leaks(docs, items).collect()} == {(1, f"i{n}") for n in range(133)}


def test_exchange_at_any_place(spark):
    """Wherever the one exchanged word stands, a window beside it joins, in short sentences as well."""
    for span in ("the old wing was at last opened here in 1900", "it has again 1900", "they came back in 1900", "当時那座博物馆的新楼在1900年"):
        words = k.tokens(span)
        other = [" ".join(words[:at] + ["々" if "当" in span else "zzz"] + words[at + 1 :]) for at in range(len(words))]
        docs = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
        got = {r.doc_id for r in k.leaks(docs, spark.createDataFrame([("i", span)], "item_id string, source_span string")).collect()}
        assert got == {at for at, w in enumerate(words) if not w[0].isdigit()}, span


def test_figureless_sentence_of_one_page(spark):
    """Neither items of one passage nor copies of a leaked page make a sentence a notice."""
    span = "Bobo Hall opened in 1900. Visitors may enter Bobo freely."
    items = spark.createDataFrame([("a", span, 0), ("b", span, 0), ("c", "Kiki Hall was sold in 1950. Guests may enter Kiki freely.", 0)], "item_id string, source_span string, x int")
    docs = [(i, span) for i in range(40)] + [(40 + i, "A copied page. Guests may enter Kiki freely.") for i in range(40)] + [(99, "More. Visitors may enter Bobo freely.")]
    got = {tuple(r) for r in k.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(d, i) for d in (*range(40), 99) for i in "ab"} | {(d, "c") for d in range(40, 80)}


def test_reparameterised_statements(spark):
    """Other figures and names in a held-out template are told from the held-out ones."""
    items = spark.createDataFrame([("a", "Bobo Museum was founded by Ada Kiki in 1823."), ("b", "The fire of 1900 took 12 shelves.")], "item_id string, source_span string")
    docs = [(0, "Bobo Museum was founded by Ada Kiki in 1823."), (1, "Say Koko School was founded by Zaza in 1950. Yes."), (2, "The fire of 1901 took 12 shelves and the fire of 1900 took 12 shelves"), (3, "Bobo Museum was bought by Ada Kiki in 1823."), (4, None)]
    pairs, members = k.templates(spark.createDataFrame(docs, "doc_id long, text string"), items)
    of = {r.template_id: r.item_id for r in members.collect()}
    assert {(r.doc_id, of[r.template_id], r.n_same, r.n_other) for r in pairs.collect()} == {(0, "a", 1, 0), (2, "b", 1, 1)} | {(1, "a", 0, 1)}


def test_letters_that_fold_to_two(spark):
    items = spark.createDataFrame([("a", "Die große Straße in Bobo führt seit 1900 nach Kiki.")], "item_id string, source_span string")
    docs = spark.createDataFrame([(0, "DIE GROSSE STRASSE IN BOBO FÜHRT SEIT 1900 NACH KIKI"), (1, "die große straße in bobo führt seit 1900 nach kiki"), (2, "die große straße in bobo führt seit 1901 nach kiki")], "doc_id long, text string")
    assert {r.doc_id for r in k.leaks(docs, items).collect()} == {0, 1}
