"""Defects of prompt and response pairs.

Copies are found by compressing the response with its prompt as a zstandard dictionary: a response that
costs hardly more than an empty frame brings nothing of its own (an exact look at the letters confirms).
Refusals come from phrase dictionaries in ten languages, other languages from rank-order profiles,
and sentences that break off from a terminal-context model: for each ending of up to ``CONTEXT``
characters it knows how often complete answers end so and how often the same characters stand inside an
answer. The model is fitted on all answers, counted where they are; all pairs are classified in one narrow stage.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from polyquarry.llm.language import Identifier, Profiles, clean, is_sentence
from polyquarry.session import cut, spread

CONTEXT = 10
#: A context is well known from so many occurrences, and so many a fitted answer: else the answers that break
#: off would make up well-known endings of their own where there are enough of them.
LEAST_SEEN, SEEN_SHARE = 5, 1 / 1200
ENDS_BELOW = 0.5
#: Contexts that a task counts before it hands them on.
MOST_CONTEXTS = 500_000
#: A copy may cost so many bytes beyond an empty frame.
COPY_BYTES = 12
#: Fixed value: bytes of a zstandard frame without content, size and dictionary id.
EMPTY_FRAME = 9

#: Answers that only hold a place.
PLACEHOLDERS = set("n/a na none null nil nan undefined tbd tba todo unknown blank empty placeholder answer antwort respuesta réponse jibu xxx 无 暂无 空 なし 無し 該当なし 回答 答案 উত্তর คำตอบ ไม่มี".split())
ENDS = tuple(".。।!?！？؟．")
#: First-person phrases that decline, as patterns.
REFUSALS = {
    "en": r"\bi(?:'m| am)? (?:sorry|afraid)\b|\bsorry\b[,.]|\bapologi[sz]e\b|\bi (?:can ?not|can['’]t|could not|couldn['’]t|won['’]t|will not|must decline|would rather not|do not|don['’]t) (?:\w+ ){0,2}(?:answer|help|assist|provide|respond|reply|comply|guess|have|know|discuss|comment|share|say|tell|disclose)|\bi(?:'m| am) (?:unable|not able|not allowed|not permitted)\b|\bunable to (?:answer|help|assist|provide|respond|comply)|\bas an? (?:ai|language model|artificial)|\bnot enough (?:context|information|data)\b.*\b(?:answer|reply|respond|say)|\boutside (?:of )?what i\b|\bi would rather not\b|\bi(?:'m| am) declining\b",
    "de": r"\btut mir leid\b|\bentschuldig(?:ung|en sie)\b|\bich (?:kann|darf|möchte|werde)\b[^.]*\b(?:nicht|keine?n?)\b|\b(?:kann|darf) ich\b[^.]*\b(?:nicht|keine?n?)\b|\bals (?:ki|sprachmodell)\b|\bliegen mir\b[^.]*\bkeine\b|\bmir liegen\b[^.]*\bkeine\b|\bich habe\b[^.]*\bkeine\b[^.]*\b(?:angaben|informationen|daten)|\bweiß ich (?:leider )?nicht\b|\bich weiß (?:es )?(?:leider )?nicht\b",
    "es": r"\blo siento\b|\blamento\b|\bno puedo (?:ayudar|responder|contestar|dar|proporcionar|facilitar|ofrecer|compartir)|\bno (?:me )?es posible (?:responder|contestar|ayudar|dar)|\bcomo (?:modelo de lenguaje|ia\b|inteligencia artificial)|\bno (?:dispongo|tengo)\b[^.]*\b(?:datos|información|informaciones|detalles)|\bprefiero no (?:contestar|responder)|\bno sé\b|\bdisculp",
    "fr": r"\bdésolée?\b|\bje regrette\b|\bje ne (?:peux|puis|suis pas en mesure|dispose|donne|sais|connais|souhaite)\b|\bje n['’]ai (?:pas|aucune?)\b|\bje préfère ne pas\b|\bil m['’]est impossible\b|\ben tant que (?:modèle|qu['’]ia|ia\b|qu['’]intelligence)|\bimpossible de (?:répondre|vous aider)",
    "sw": r"\bsamahani\b|\bnaomba radhi\b|\bsiwezi\b|\bsina (?:taarifa|habari|maelezo|uwezo)|\bkama (?:mfano|modeli|muundo) (?:wa|ya) lugha|\bsijui\b|\bnasikitika\b",
    "ar": r"عذر[ااً]|آسف|نأسف|أعتذر|لا (?:أستطيع|يمكنني|أقدر|أعرف|أملك)|لا يسعني|ليست? لدي|لا توجد? لدي|كنموذج|بصفتي نموذج|لست قادر",
    "bn": r"দুঃখিত|ক্ষমা কর|আমার পক্ষে[^।]*(?:সম্ভব নয়|সম্ভব না)|আমার কাছে[^।]*(?:নেই|নাই)|আমি[^।]*(?:পারব না|পারছি না|পারি না|পারবো না|অক্ষম|জানি না)|ভাষা মডেল",
    "th": r"ขออภัย|ขอโทษ|เสียใจ.{0,12}ไม่สามารถ|(?:ฉัน|ผม|ดิฉัน|เรา)(?:ไม่สามารถ|ไม่มีข้อมูล|ไม่ทราบ|ไม่อาจ)|ในฐานะ(?:โมเดล|แบบจำลอง|ปัญญาประดิษฐ์)",
    "ja": r"申し訳|すみません|ごめんなさい|お答え(?:でき|いたしかね|しかね|する(?:こと|の)は)|お応えでき|お手伝いでき|回答でき(?:ません|ない)|答えられません|情報は?(?:持って|ござい|あり)(?:おりません|いません|ません)|言語モデル|わかりません|分かりません|提供でき(?:ません|ない)|差し控え",
    "zh": r"抱歉|对不起|對不起|我(?:无法|不能|没有(?:可以|任何|相关|足够)|不(?:便|会|可以|知道|清楚))|无法(?:回答|提供|帮助|协助|处理)|作为(?:一个)?(?:语言模型|人工智能|AI|ai)|不便(?:回答|透露)|恕(?:我)?(?:无法|不能)",
}
#: Languages by the script that a text has to hold for their phrases to be looked for.
_SCRIPTS = {"[A-Za-z]": ("en", "de", "es", "fr", "sw"), "[\u0600-\u06ff]": ("ar",), "[\u0980-\u09ff]": ("bn",), "[\u0e00-\u0e7f]": ("th",), "[\u3040-\u30ff\u3400-\u9fff]": ("ja", "zh")}
_REFUSALS = [(re.compile(script), re.compile("|".join(f"(?:{REFUSALS[c]})" for c in codes), re.IGNORECASE)) for script, codes in _SCRIPTS.items()]
_LABEL = re.compile(r"^\s*(?:q|question|frage|pregunta|swali|问题|问|質問|คำถาม|প্রশ্ন|سؤال|السؤال)\s*[:：.)\-]\s*", re.IGNORECASE)
_MARKS = re.compile(r"[\W_]+")
_ASKS = re.compile(r"[?？؟]\s*[\"'”»)）]*$")
_DIGIT = re.compile(r"\d")
_DOTS = re.compile(r"\.{2,}|‥")


def letters(text: str) -> str:
    return _MARKS.sub("", _LABEL.sub("", text)).casefold()


_letters = lru_cache(1 << 12)(letters)  # of short questions, which several answers share


def is_empty(answer: str | None) -> bool:
    """Null, blank, invisible or a placeholder."""
    if answer is None:
        return True
    core = clean(answer).strip()
    bare = re.sub(r"[\s\[\](){}<>\"'“”.,…。·*_#\-–—/\\|?!？！:;~=+]+", "", core)
    return not bare or core.strip(" []<>{}()\"'.").casefold() in PLACEHOLDERS


def copy_cost(question: str, answer: str) -> int:
    """Bytes that ``answer`` costs beyond an empty frame with ``question`` as the dictionary."""
    import zstandard

    d = zstandard.ZstdCompressionDict(question.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False, write_dict_id=False)
    return len(c.compress(answer.encode())) - EMPTY_FRAME


def refuses(text: str) -> bool:
    """Whether a text declines to answer, in any of the languages whose script it holds."""
    return any(script.search(text) and phrases.search(text) for script, phrases in _REFUSALS)


def is_copy(question: str | None, answer: str) -> bool:
    """Whether a sentence gives back the question, whole or by one of its sentences."""
    if not question:
        return False
    q, a = _letters(question) if len(question) < 1000 else letters(question), letters(answer)
    if len(a) < 4 or len(q.encode()) < 8:
        return False
    if copy_cost(q, a) > COPY_BYTES + len(a.encode()) // 40:
        return False
    # the exact check: all of the answer stands in the question, and it is a question or most of it
    if a == q or q in a and len(a) <= len(q) + 8:
        return True
    return a in q and (bool(_ASKS.search(answer)) or len(a) >= 0.8 * len(q))


class Endings:
    """Terminal-context model: how often a context ends a complete answer and stands inside one. An answer
    it is fitted on that ends with a mark that closes nothing (a comma, a dash, dots) is no complete one."""

    def __init__(self, ends: dict[str, int], inside: dict[str, int], answers: int = 0):
        self.ends, self.inside, self.least = ends, inside, self.least_seen(answers)

    @staticmethod
    def least_seen(answers: int) -> float:
        return max(LEAST_SEEN, SEEN_SHARE * answers)

    @staticmethod
    def hangs(text: str) -> bool:
        """Whether a text ends with a mark that neither ends a sentence nor closes a bracket or a quote."""
        kind = unicodedata.category(text[-1:] or ".")
        return kind[0] == "P" and not text.endswith(ENDS) and kind not in ("Pe", "Pf") and text[-1] not in "\"'%"

    @staticmethod
    def key(text: str) -> str:
        return _DOTS.sub("…", _DIGIT.sub("0", text.strip()))

    @classmethod
    def fit(cls, answers: Iterator[str]) -> Endings:
        texts = [cls.key(t) for t in sorted({clean(t) for t in answers})]
        ends: Counter = Counter(t[-k:] for t in texts if not cls.hangs(t) for k in range(1, min(CONTEXT, len(t)) + 1))
        ends = Counter({c: n for c, n in ends.items() if n > 1 or len(c) <= 3})
        inside: Counter = Counter()
        for t in texts:
            for i in range(1, len(t)):
                for k in range(1, min(CONTEXT, i) + 1):
                    c = t[i - k : i]
                    if c not in ends:
                        break  # a longer context ends no answer either
                    inside[c] += 1
        return cls(dict(ends), dict(inside), len(texts))

    @classmethod
    def fitted(cls, texts: DataFrame) -> Endings:
        """The model of all sentences among ``texts`` (text) that ask nothing, with the verdicts of ``fit``.
        Contexts are counted where the answers are. A context as well known as its own ending is kept only where
        the two disagree, so exceptions reach the driver, not the vocabulary; the contexts that end more than one
        answer pass through it as a set."""

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([clean(t) for t in b.column(0).to_pylist() if is_sentence(t) and not _ASKS.search(t)], pa.string())], ["text"])

        said = spread(cut(texts.select("text").mapInArrow(answers, "text string").distinct()))
        ends = cut(_counted(said, cls._ends).filter((F.col("n") > 1) | (F.char_length("c") <= 3)))
        known = frozenset(r["c"] for r in ends.toLocalIterator())
        inside = _counted(said, lambda t: cls._inside(t, known)).withColumnRenamed("n", "i")
        n = said.count()
        both = ends.join(inside, "c", "left").select("c", F.col("n").alias("e"), F.coalesce("i", F.lit(0)).alias("i")).filter(F.col("e") + F.col("i") >= cls.least_seen(n))
        both = cut(both.withColumn("done", F.col("e") / (F.col("e") + F.col("i")) >= ENDS_BELOW))
        shorter = both.select(F.col("c").alias("shorter"), F.col("done").alias("so"))
        rows = both.join(shorter, F.expr("substring(c, 2)") == F.col("shorter"), "left").filter(F.col("so").isNull() | (F.col("so") != F.col("done"))).select("c", "e", "i").collect()
        return cls({r["c"]: r["e"] for r in rows}, {r["c"]: r["i"] for r in rows}, n)

    @classmethod
    def _ends(cls, t: str) -> list[str]:
        return [] if cls.hangs(t) else [t[-k:] for k in range(1, min(CONTEXT, len(t)) + 1)]

    @staticmethod
    def _inside(t: str, ends: frozenset[str]) -> list[str]:
        out: list[str] = []
        at = range(1, len(t))  # behind a context of k characters; a longer one ends no answer where a shorter doesn't
        for k in range(1, CONTEXT + 1):
            at = [i for i in at if i >= k and t[i - k : i] in ends]
            out += [t[i - k : i] for i in at]
        return out

    def finished(self, text: str) -> float:
        """Share of ends among all occurrences of the longest well-known ending of ``text``."""
        t = self.key(text)
        for k in range(min(CONTEXT, len(t)), 0, -1):
            e, i = self.ends.get(t[-k:], 0), self.inside.get(t[-k:], 0)
            if e + i >= self.least:
                return e / (e + i)
        return 1.0 if t.endswith(ENDS) else 0.0  # an ending never seen: only a mark speaks for it


def _counted(answers: DataFrame, contexts: Callable[[str], list[str]]) -> DataFrame:
    """``c, n``: how often each context comes up among the keys of the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["c", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(contexts(Endings.key(t)))
            if len(n) > MOST_CONTEXTS:
                yield told()
                n.clear()
        yield told()

    return answers.select("text").mapInArrow(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))


def breaks_off(answer: str, endings: Endings) -> bool:
    return endings.finished(clean(answer).strip()) < ENDS_BELOW


class Judge:
    def __init__(self, profiles: Profiles, endings: Endings):
        self.identifier, self.endings = Identifier(profiles), endings

    def first(self, question: str | None, answer: str | None) -> tuple[bool, str | None]:
        """Whether the pair is decided without its languages, and the defect."""
        if is_empty(answer):
            return True, "empty_answer"
        plain = clean(answer)
        sentence = is_sentence(plain)
        if sentence and is_copy(clean(question) if question else None, plain):
            return True, "copied_question"
        if refuses(plain):
            return True, "refusal"
        if not sentence:
            return True, None
        if not _ASKS.search(plain) and breaks_off(plain, self.endings):
            return True, "truncated_answer"
        return False, None

    def defects(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """One defect type per pair, or None for a proper answer. Checked in this order: empty_answer,
        copied_question, refusal, truncated_answer, other_language; an answer that asks is a copied question
        or in another language. A null or blank question rules out only a copy and another language."""
        found = {p: self.first(*p) for p in dict.fromkeys(pairs)}
        open_pairs = [p for p, (decided, _) in found.items() if not decided]
        texts = list(dict.fromkeys(x for q, a in open_pairs for x in (q, a) if x and x.strip()))
        languages = dict(zip(texts, map(set, self.identifier.languages_many(texts))))
        for q, a in open_pairs:
            asked, said = languages.get(q, set()), languages[a]
            if _ASKS.search(clean(a)):
                defect = "copied_question" if not asked or said & asked else "other_language"
            else:
                defect = "other_language" if asked and said and not said & asked else None
            found[q, a] = True, defect
        return [found[p][1] for p in pairs]

    def defect(self, question: str | None, answer: str | None) -> str | None:
        return self.defects([(question, answer)])[0]


def defect_column(profiles: Profiles, endings: Endings):
    """A pandas UDF (question, answer) → defect type or null."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judge = Judge(profiles, endings)
        for q, a in batches:
            yield pd.Series(judge.defects(list(zip(q, a))), dtype=object)

    return run.asNondeterministic()  # else a filter on the result would ask a second time, before the spread
