import pytest

from polyquarry.llm import language as g
from polyquarry.llm import pairs as p

ANSWERS = [f"{name} was founded in {year} by the old town." for name in ("Bobo Museum", "Kiki School", "Zaza Garden") for year in range(1900, 1940)] + [
    f"พิพิธภัณฑ์{x} เปิดในปี {y} และใช้เงิน {y}{y} มงกุฎ" for x in ("ก", "ข") for y in range(1900, 1930)
]
JUDGE = p.Judge(g.fit(iter(())), p.Endings.fit(iter(ANSWERS)))
Q = "In which year was Bobo Museum founded by the old town?"


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        (Q, None, "empty_answer"), (Q, "", "empty_answer"), (Q, " \t", "empty_answer"), (Q, "​", "empty_answer"), (Q, "N/A", "empty_answer"), (Q, "[]", "empty_answer"), (Q, "—", "empty_answer"), (Q, "(none)", "empty_answer"),
        (Q, Q, "copied_question"), (Q, "Q: " + Q, "copied_question"), (Q, Q.lower().rstrip("?"), "copied_question"), (Q, "in which year was bobo museum founded by the old town .", "copied_question"),
        (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "Je suis désolé, mais je ne peux pas vous aider.", "refusal"), (Q, "很抱歉，我无法帮助。", "refusal"), (Q, "ฉันไม่มีข้อมูลเกี่ยวกับ เรื่องนี้", "refusal"),
        (Q, "Bobo Museum was founded in 1901 by", "truncated_answer"), (Q, "Bobo Museum was founded in 19...", "truncated_answer"), (Q, "Bobo Museum was founded,", "truncated_answer"), (Q, "Bobo Museum was fou", "truncated_answer"),
        (Q, "Die Menschen sind frei und gleich an Würde und Rechten geboren.", "other_language"),
        (Q, "1901", None), (Q, "Ada Lovelace", None), (Q, "Bobo Museum was founded in 1901 by the old town.", None), (None, "1901", None), ("", "Bobo Museum was founded in 1901 by the old town.", None), (None, None, "empty_answer"),
    ],
)
def test_defects(question, answer, defect):
    assert JUDGE.defect(question, answer) == defect


def test_endings_learn_scripts_without_marks():
    assert not p.breaks_off("พิพิธภัณฑ์ก เปิดในปี 1905 และใช้เงิน 19051905 มงกุฎ", JUDGE.endings)
    assert p.breaks_off("พิพิธภัณฑ์ก เปิดในปี 1905", JUDGE.endings)


def test_endings_of_all_answers(spark):
    """Counted by Spark and cut down to the exceptions they judge every beginning of every answer alike."""
    answers = [*ANSWERS, *(f"the museum burnt down in {y}, and" for y in range(1900, 1910)), *(f"it was opened in {y} by Ada" for y in range(1900, 1907)), "it was closed by Ida"]
    df = spark.createDataFrame([(a,) for a in [*answers, *answers[:20], "Ada", "who was it that came by?"]], "text string")
    whole, one = p.Endings.fitted(df), p.Endings.fit(iter(answers))
    assert 0 < len(whole.ends) < len(one.ends)
    for a in answers:
        assert all(p.breaks_off(a[:k], whole) == p.breaks_off(a[:k], one) for k in range(1, len(a) + 1))
    assert p.Endings.fitted(df.limit(0)).ends == {}


def test_many_answers_that_break_off_make_no_ending():
    """Where there are enough answers, those that break off come up often enough to look like ends of their own."""
    names = [a + b for a in ("Ki", "Bo", "Za", "Nu", "Te") for b in ("ko", "ba", "zi", "nu", "ta")]
    whole = [f"{x} and {y} founded it in {n} by the old town." for x in names for y in names for n in range(1900, 1920)]
    broken = [f"{x} {y} was founded in 1900 and" for x in names[:3] for y in names[:3]]
    one = p.Endings.fit(iter(whole + broken))
    assert p.breaks_off("Kiko Boba was founded in 1907 and", one) and not p.breaks_off(whole[0], one)


def test_found_reads_no_sample(spark, tiny, monkeypatch):
    from polyquarry.llm import language, queries

    want = {tuple(r) for r in queries.p2_found(spark, tiny).collect()}
    monkeypatch.setattr(language, "labelled_sample", lambda *_: [])
    assert {tuple(r) for r in queries.p2_found(spark, tiny).collect()} == want


def test_copies_cost_little():
    assert p.copy_cost(p.letters(Q), p.letters(Q)) < p.COPY_BYTES < p.copy_cost(p.letters(Q), p.letters("Nothing of the kind was ever said about 1234 things elsewhere"))


def test_long_and_odd_texts():
    assert JUDGE.defect(Q, "word " * 20000 + "end.") in (None, "truncated_answer", "other_language")
    assert JUDGE.defect("?" * 5000, "x") is None


def test_query_over_the_tiny_table(spark, tiny):
    from polyquarry.llm import queries

    rows = queries.p2_found(spark, tiny).collect()
    keys = [(r.cache_id, r.item_pos, r.attempt_pos) for r in rows]
    assert rows and len(keys) == len(set(keys))
    assert {r.defect_type for r in rows} <= {"empty_answer", "truncated_answer", "refusal", "copied_question", "other_language"}
