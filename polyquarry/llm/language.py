"""Language of texts and of their segments by rank-order profiles.

A language's profile is the list of its most frequent character n-grams by rank; a text's own ranks are
compared with each profile by the out-of-place distance (the sum of rank differences, the profile size
where a gram is missing). Texts are cut into segments at sentence ends, line ends, brackets and where
the script changes, so a text in several languages comes out with each of them. Longer segments are looked at
through windows of words as well; where two of them disagree, a sliding window finds the switch between.

Distances are taken for all segments of an Arrow batch at once: grams are numbered per batch, counted and
ranked by sorting, and looked up in one table of profile ranks.

Profiles are fitted on labelled rows, either on all of them where they are (``fitted``) or on a bounded sample
(at most ``PER_LANGUAGE`` texts per language by hash order); texts whose first guess contradicts their label
leave the second fit.
Identification itself reads every text in full, in one narrow stage without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.llm.lookalikes import mapped, odd
from polyquarry.session import cut, spread

#: Bound of the labelled sample per language, and n-grams kept per profile.
PER_LANGUAGE = 1500
PROFILE = 1500
#: Words that a task counts before it hands their n-grams on.
MOST_WORDS = 100_000
#: The seed text counts as one in so many of the sample.
SEED_SHARE = 20
MAX_GRAM = 5

#: Codes and names of the ten languages.
CODES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "es": "es spa spanish español castellano", "fr": "fr fra fre french français",
    "sw": "sw swa swh swahili kiswahili", "ar": "ar ara arb arabic العربية", "bn": "bn ben bengali bangla বাংলা", "th": "th tha thai ไทย",
    "ja": "ja jpn jp japanese 日本語", "zh": "zh zho chi chn cn cmn chinese mandarin 中文",
}
CODE_OF = {w: code for code, words in CODES.items() for w in words.split()}
#: The first article of the Universal Declaration of Human Rights and a plain first-person
#: text, a floor under small samples and under turns of speech that the labelled rows lack.
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. I am sorry, but as a model of language I am not able to help you with this. You can ask me another question, and we do not know what they would have said about it. This is a topic on which I cannot give or provide any information, and there is not enough context for a reply to the request.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Es tut mir leid, aber als Modell kann ich dir dabei nicht helfen. Ich darf diese Frage nicht beantworten, und wir wissen leider nicht, was sie dazu gesagt hätten.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Lo siento, pero como modelo no puedo ayudarte con esto. No sé responder a esa pregunta y no tenemos información sobre lo que ellos habrían dicho.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Je suis désolé, mais en tant que modèle je ne peux pas vous aider. Je ne sais pas répondre à cette question et nous n'avons aucune information sur ce qu'ils auraient dit.",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. Samahani, kama mfano wa lugha siwezi kukusaidia na jambo hili. Sijui jibu la swali hilo na hatuna taarifa zozote kuhusu yale ambayo wangesema.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. عذرا، لا أستطيع مساعدتك في هذا الأمر. لا أعرف جواب هذا السؤال وليست لدينا أي معلومات عما كانوا سيقولون.",
    "bn": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে। তাঁদের বিবেক এবং বুদ্ধি আছে; সুতরাং সকলেরই একে অপরের প্রতি ভ্রাতৃত্বসুলভ মনোভাব নিয়ে আচরণ করা উচিত। দুঃখিত, আমি এই বিষয়ে আপনাকে সাহায্য করতে পারছি না। আমি এই প্রশ্নের উত্তর জানি না এবং আমাদের কাছে কোনো তথ্য নেই।",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ ขออภัย ฉันไม่สามารถช่วยคุณในเรื่องนี้ได้ ฉันไม่ทราบคำตอบของคำถามนี้ และเราไม่มีข้อมูลใดๆ",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。 申し訳ありませんが、この件についてはお手伝いできません。その質問の答えは分かりませんし、情報も持っていません。",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。 很抱歉，我无法在这件事上帮助你。我不知道这个问题的答案，我们也没有任何相关的信息。",
}

_SCRIPT = re.compile(
    "(?P<thai>[฀-๿]+)|(?P<beng>[ঀ-৿।]+)|(?P<arab>[؀-ۿݐ-ݿ]+)|(?P<cj>[぀-ヿ㐀-鿿々〆ー]+)|(?P<latn>[A-Za-zÀ-ɏḀ-ỿ'’]+)"
)
_BREAK = re.compile(r"(?<=[?!。？！।؟])\s*|(?<=[.])\s+(?=\S)|[\r\n()（）\[\]]+|(?<=[.?!])\s")
#: Words of a window; a segment of two windows may hold a switch, whose parts need that confidence.
WINDOW, PART_SURE = 6, 0.5
_HIRAGANA = re.compile("[ぁ-ゖ]")
_KANA = re.compile("[ぁ-ヺ]")
_NAME_DOT = re.compile("[·・]")
_WORDS = re.compile(r"[^\W\d_]+(?:[ঀ-৿฀-๿][^\W\d_]*)*")


def clean(text: str) -> str:
    """The text with look-alike characters made plain, if it has any."""
    return _clean(text) if len(text) < 1000 else _plain(text)


def _plain(text: str) -> str:
    return mapped(text) if odd(text) else text


_clean = lru_cache(1 << 12)(_plain)  # of short texts only, so that the cache stays small


def code_column(label: Column) -> Column:
    """The two-letter code that a label names in any spelling (``de-DE``, ``ger``, ``German``); null for
    null, blank, ``und`` and unknown labels."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([^\-_ ]+)", 1)
    pairs = [x for w, code in CODE_OF.items() for x in (F.lit(w), F.lit(code))]
    return F.create_map(*pairs)[base]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(script, start, end) of the segments of a text: sentences, lines, bracketed parts, and runs of one
    script. Digits and marks stay with the run they follow."""
    out = []
    for a, b in _between(text):
        runs: list[list] = []
        for m in _SCRIPT.finditer(text, a, b):
            if runs and runs[-1][0] == m.lastgroup:
                runs[-1][2] = m.end()
            else:
                runs.append([m.lastgroup, m.start(), m.end()])
        # short runs of another script (names, marks) don't part what stands around them
        merged: list[list] = []
        for r in runs:
            if _weighty(r[0], text[r[1] : r[2]]):
                if merged and merged[-1][0] == r[0]:
                    merged[-1][2] = r[2]
                else:
                    merged.append(r)
        out += [(r[0], r[1], r[2]) for r in merged]
    return out


def _between(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _BREAK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _weighty(script: str, run: str) -> bool:
    """Whether a run of one script says something: more than names and single marks."""
    if script == "latn":
        words = re.findall(r"[^\W\d_]+", run)
        small = sum(len(w) > 1 and w.islower() for w in words)
        return len(words) >= 3 and small >= 1 or small >= 2 and len(words) >= 2
    if script == "cj":
        return len(run) >= 4 and (bool(_HIRAGANA.search(run)) or not _KANA.search(run) and not _NAME_DOT.search(run[:-1]) or len(run) >= 12)
    if script == "thai":
        return len(run) >= 10
    return len(re.findall(r"\w\w+", run)) >= 2


def is_sentence(text: str) -> bool:
    """Whether an answer is a sentence, also a broken-off one, rather than a bare name, place, year,
    figure or placeholder. Names have no small words, few words, and no numbers beside them."""
    t = text.strip()
    found = {m.lastgroup for m in _SCRIPT.finditer(t)}
    if not found:
        return False
    words = re.findall(r"[^\s\d\W][\w'’ঀ-৿฀-๿]*", t)
    digits = bool(re.search(r"\d", t))
    if "cj" in found:
        core = re.sub(r"[^぀-ヿ㐀-鿿]", "", t)
        if _KANA.search(core):
            return bool(_HIRAGANA.search(core)) and len(core) >= 4 or digits and len(core) >= 6
        dot = _NAME_DOT.search(t)
        return digits and len(core) >= 4 or len(core) >= (14 if dot else 8) or bool(re.search(r"[。，、？！,]", t)) and len(core) >= 4 or bool(dot) and len(core) >= 6 and bool(re.search("[由在于的了从]", t))
    if "thai" in found:
        return len(words) >= 3 or digits and len(t) >= 10 or len(t) >= 28
    if "arab" in found or "beng" in found:
        return len(words) >= 3 or digits and len(words) >= 2
    small = [w for w in words if w[:1].islower() and len(w) > 1 and w not in ("de", "da", "of", "the", "der", "von", "van", "la", "ya", "del", "du", "des", "wa")]
    return len(words) >= 3 and len(small) >= 1 or digits and len(small) >= 1 and len(words) >= 2


def kept_words(text: str) -> list[str]:
    """The words of a text that count. Capitalised words inside a Latin sentence (names) are left out unless
    they have letters with accents; digits and marks play no part."""
    words = _WORDS.findall(text)
    return [w.lower() for i, w in enumerate(words) if not (i and w.isascii() and w[:1].isupper())] or [w.lower() for w in words]


def grams(text: str) -> Counter:
    """Counts of the 1- to 5-grams (and the words themselves) of the words of a text."""
    out: Counter = Counter()
    for w in kept_words(text):
        out.update(_word_grams(w))
    return out


@lru_cache(1 << 14)
def _word_grams(word: str) -> tuple[str, ...]:
    w = f" {word} "
    out = [g for n in range(1, MAX_GRAM + 1) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != " "]
    return (*out, w) if len(w) > MAX_GRAM else tuple(out)


def ranks(counts: Counter, size: int = PROFILE) -> dict[str, int]:
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


Profiles = dict[str, dict[str, int]]


def out_of_place(doc: dict[str, int], profile: dict[str, int]) -> int:
    get, most = profile.get, PROFILE
    return sum(abs(i - j) if (j := get(g)) is not None else most for g, i in doc.items())


CHUNK = 256
#: Texts whose languages a task remembers, to be asked once where they come again.
MOST_KNOWN = 50_000
_NEVER = 1 << 60


class Distances:
    """Out-of-place distances to all profiles at once: a table of ranks per known gram."""

    def __init__(self, profiles: Profiles):
        self.codes = sorted(profiles)
        self.row = {g: i for i, g in enumerate(sorted({g for p in profiles.values() for g in p}))}
        self.ranks = np.full((len(self.row), len(self.codes)), PROFILE, dtype=np.int32)
        for k, code in enumerate(self.codes):
            for g, r in profiles[code].items():
                self.ranks[self.row[g], k] = r
        self.ranks_or_none = np.vstack([self.ranks, np.full((1, len(self.codes)), PROFILE, dtype=np.int32)]).astype(np.int16)

    def __call__(self, doc: dict[str, int]) -> list[tuple[int, str]]:
        """(distance, language), nearest first, of the languages that share a gram with the text."""
        row = self.row
        known = [(row[g], i) for g, i in doc.items() if g in row]
        if not known:
            return []
        rows, places = np.array(known, dtype=np.int32).T
        table = self.ranks[rows]
        missing = table == PROFILE
        away = np.where(missing, PROFILE, np.abs(table - places[:, None])).sum(axis=0) + PROFILE * (len(doc) - len(known))
        some = ~missing.all(axis=0)
        return sorted((int(d), c) for d, c, s in zip(away, self.codes, some) if s)


    def many(self, segments: list[str]) -> list[tuple[str, float]]:
        """(language, confidence) of each segment, as ``verdict(self(ranks(grams(segment))))`` for all at
        once."""
        words = [kept_words(s) for s in segments]
        own = {w: _word_grams(w) for ws in words for w in ws}
        vocabulary = {g: i for i, g in enumerate(sorted({g for gs in own.values() for g in gs}))}
        ids = {w: np.array([vocabulary[g] for g in gs], dtype=np.int64) for w, gs in own.items()}
        unknown = len(self.row)
        rows = np.array([self.row.get(g, unknown) for g in vocabulary], dtype=np.int64)
        out: list[tuple[str, float]] = []
        for at in range(0, len(segments), CHUNK):
            out += self._chunk([[ids[w] for w in ws] for ws in words[at : at + CHUNK]], rows)
        return out

    def _chunk(self, segments: list[list[np.ndarray]], rows: np.ndarray) -> list[tuple[str, float]]:
        """Verdicts of segments given as the gram numbers of their words; ``rows``: number → table row."""
        out = [("", 0.0)] * len(segments)
        arrays = [a for words in segments for a in words]
        if not arrays:
            return out
        of = np.repeat(np.repeat(np.arange(len(segments)), [len(words) for words in segments]), [len(a) for a in arrays])
        seen, counts = np.unique(of * len(rows) + np.concatenate(arrays), return_counts=True)
        of, gram = np.divmod(seen, len(rows))
        # most frequent first, ties by gram: they stand in gram order already
        order = np.argsort(of * (int(counts.max()) + 1) - counts, kind="stable")
        of, gram = of[order], gram[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        if place.max() >= PROFILE:  # beyond the profile's size grams play no part
            keep = place < PROFILE
            of, gram, place = of[keep], gram[keep], place[keep]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        table = self.ranks_or_none[rows[gram]]
        missing = table == PROFILE
        away = np.abs(table - place[:, None].astype(np.int16))
        away[missing] = PROFILE
        total = np.add.reduceat(away, starts, axis=0, dtype=np.int64)
        total[np.logical_and.reduceat(missing, starts, axis=0)] = _NEVER
        size = np.diff(np.r_[starts, len(of)])
        near = np.argsort(total, axis=1, kind="stable")[:, :2]
        best = np.take_along_axis(total, near, axis=1)
        for n, k, (first, second), m in zip(of[starts].tolist(), near[:, 0].tolist(), best.tolist(), size.tolist()):
            if first < _NEVER:
                out[n] = self.codes[k], _confidence(first, second if second < _NEVER else PROFILE * m)
        return out


def _confidence(best: int, second: int) -> float:
    """The margin to the second-best language, scaled so that a gap of a tenth of the distance is full."""
    return round(min(1.0, max(0.0, (second - best) / max(1, second) * 10)), 4)


def identify(segment: str, distances: Distances) -> tuple[str, float]:
    """The language of one segment and a confidence in 0..1, by the definition."""
    doc = ranks(grams(segment))
    scored = distances(doc) if doc else []
    if not scored:
        return "", 0.0
    return scored[0][1], _confidence(scored[0][0], scored[1][0] if len(scored) > 1 else PROFILE * len(doc))


def fit(samples: Iterator[tuple[str, str]]) -> Profiles:
    """Profiles of (code, text) samples. After the first fit, texts that read as another language than
    their label are dropped and the profiles fitted again."""
    by: dict[str, list[str]] = defaultdict(list)
    for code, text in samples:
        by[code].append(clean(text))

    def build(kept: dict[str, list[str]]) -> Profiles:
        out = {}
        for code, seed in SEEDS.items():
            weight = max(1, len(kept.get(code, [])) // SEED_SHARE)
            words: Counter = Counter()
            for t in kept.get(code, []):
                words.update(kept_words(t))
            total = Counter({g: n * weight for g, n in grams(seed).items()})
            for w, n in words.items():
                for g in _word_grams(w):
                    total[g] += n
            out[code] = ranks(total)
        return out

    first = Distances(build(by))
    return build({code: [t for t, (c, _) in zip(texts, first.many(texts)) if c == code] for code, texts in by.items()})


def labelled(texts: DataFrame) -> DataFrame:
    """All distinct labelled texts that profiles are fitted on. ``texts``: code, text."""
    usable = texts.filter(F.col("code").isNotNull() & (F.length("text") >= 12)).select("code", "text")
    return spread(cut(usable.distinct()))


def fitted(texts: DataFrame) -> Profiles:
    """``fit`` over all texts of ``labelled``: n-grams are counted where the texts are, ``PROFILE`` of them per
    language reach the driver."""
    return _profiles(texts, Distances(_profiles(texts, None)))


def _profiles(texts: DataFrame, first: Distances | None) -> Profiles:
    """Profiles of the texts, of those alone that ``first`` reads as their label where it is given."""
    nothing = ""  # no gram: stands for the texts themselves

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        n: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            for code, found in words.items():
                total = Counter({nothing: n[code]})
                for w, k in found.items():
                    for g in _word_grams(w):
                        total[g] += k
                yield pa.RecordBatch.from_arrays([pa.array([code] * len(total)), pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["code", "gram", "n"])
            words.clear()
            n.clear()

        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), [clean(t) for t in b.column(1).to_pylist()]))
            if first:
                rows = [r for r, (c, _) in zip(rows, first.many([t for _, t in rows])) if c == r[0]]
            for code, t in rows:
                words[code].update(kept_words(t))
                n[code] += 1
            if sum(map(len, words.values())) > MOST_WORDS:
                yield from told()
        yield from told()

    counted = cut(texts.select("code", "text").mapInArrow(counts, "code string, gram string, n long").groupBy("code", "gram").agg(F.sum("n").alias("n")))
    n_texts = {r["code"]: r["n"] for r in counted.filter(F.col("gram") == nothing).collect()}
    seeds = [(code, g, k * max(1, n_texts.get(code, 0) // SEED_SHARE)) for code, seed in SEEDS.items() for g, k in grams(seed).items()]
    both = counted.filter(F.col("gram") != nothing).unionByName(texts.sparkSession.createDataFrame(seeds, counted.schema)).groupBy("code", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "gram")) - 1
    out: Profiles = {code: {} for code in SEEDS}
    for r in both.select("code", "gram", place.alias("place")).filter(F.col("place") < PROFILE).collect():
        out[r["code"]][r["gram"]] = r["place"]
    return out


Part = tuple[int, int, str, float]


class Identifier:
    """Identifies texts with fixed profiles, many at once."""

    def __init__(self, profiles: Profiles):
        self.distances = Distances(profiles)

    def parts_many(self, texts: list[str]) -> list[list[Part]]:
        """(start, length, language, confidence) of the segments of each text that say something, of the
        whole text where no segment does. Places are code points of the text in plain characters."""
        cleaned = [clean(t) for t in texts]
        cut = [spans(t) or [("", 0, len(t))] for t in cleaned]
        strings = [t[a:b] for t, ss in zip(cleaned, cut) for _, a, b in ss]
        distinct = list(dict.fromkeys(strings))
        verdict = dict(zip(distinct, self.distances.many(distinct)))
        switched = self._switches([s for s in distinct if s.count(" ") >= 2 * WINDOW - 1])
        out = []
        for t, ss in zip(cleaned, cut):
            rows: list[Part] = []
            for _, a, b in ss:
                s = t[a:b]
                if s in switched:
                    rows += [(a + i, n, c, sure) for i, n, c, sure in switched[s]]
                elif verdict[s][0]:
                    rows.append((a, b - a, *verdict[s]))
            out.append(rows)
        return out

    def _switches(self, segments: list[str]) -> dict[str, list[Part]]:
        """Segments in which a sliding window of words sees two languages, each surely over its words: the
        part of each. One language beside unsure windows is no switch."""
        found: dict[str, list[Part]] = {}
        words = {s: w for s in segments if len(w := list(re.finditer(r"\S+", s))) >= 2 * WINDOW}
        side_by_side = {s: [*range(0, len(w) - WINDOW, WINDOW), len(w) - WINDOW] for s, w in words.items()}
        coarse = self._windows(words, side_by_side)
        words = {s: w for s, w in words.items() if len(set(coarse[s]) - {""}) == 2}
        fine = self._windows(words, {s: list(range(len(w) - WINDOW + 1)) for s, w in words.items()})
        halves: list[tuple[str, int]] = []
        for s, w in words.items():
            said = [(c, i) for i, c in enumerate(fine[s]) if c]
            turns = [(i, j) for (c, i), (e, j) in zip(said, said[1:]) if c != e]
            if len(turns) == 1 and len({c for c, _ in said}) == 2:
                i, j = turns[0]
                halves.append((s, w[min(len(w) - 1, (i + j + WINDOW) // 2)].start()))
        sides = self.distances.many([x for s, k in halves for x in (s[:k], s[k:])])
        for n, (s, k) in enumerate(halves):
            (c, sure), (e, certain) = sides[2 * n], sides[2 * n + 1]
            if c != e and min(sure, certain) >= PART_SURE:
                found[s] = [(0, k, c, sure), (k, len(s) - k, e, certain)]
        return found

    def _windows(self, words: dict[str, list[re.Match]], starts: dict[str, list[int]]) -> dict[str, list[str]]:
        """The language of each window of words, empty where it is unsure."""
        texts = [s[w[i].start() : w[i + WINDOW - 1].end()] for s, w in words.items() for i in starts[s]]
        verdicts = iter(self.distances.many(texts))
        return {s: [c if sure >= PART_SURE else "" for c, sure in (next(verdicts) for _ in starts[s])] for s in words}

    def languages_many(self, texts: list[str]) -> list[dict[str, float]]:
        """Language → confidence (the best of its segments) of each text."""
        out = []
        for rows in self.parts_many(texts):
            best: dict[str, float] = {}
            for _, _, code, sure in rows:
                best[code] = max(sure, best.get(code, 0.0))
            out.append(best)
        return out

    def languages(self, text: str) -> dict[str, float]:
        return self.languages_many([text])[0]


def labelled_sample(texts: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` distinct texts per label. ``texts``: code, text. Texts are first thinned
    by their hash to about twice the bound per label (shares from one count per label), so neither the
    shuffle nor the driver sees more as the data grows; the bound itself is kept by hash order."""
    usable = texts.filter(F.col("code").isNotNull() & (F.length("text") >= 12)).select("code", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h"))
    counts = {r["code"]: r["n"] for r in usable.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    # repeats share a hash: where few distinct texts are left, all of them are taken
    share = F.coalesce(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1 << 30, 4 * per_language * (1 << 30) // n + 1))])[F.col("code")], F.lit(0))
    order = Window.partitionBy("code").orderBy("h", "text")
    thin = usable.filter(F.col("h") < share).distinct()
    rows = thin.select("code", "text", F.row_number().over(order).alias("n")).filter(F.col("n") <= per_language).collect()
    return sorted((r["code"], r["text"]) for r in rows)


FOUND = "parts:array<struct<start:int,length:int,lang_code:string,confidence:double>>,sentence:boolean"


def _remembering(batches: Iterator[pd.Series], profiles: Profiles, told: Callable[[list[Part], bool], object], nothing: object) -> Iterator[list]:
    """What ``told`` makes of the parts of each text and of whether it is a sentence; short texts are asked
    once per task."""
    one, known = Identifier(profiles), {None: nothing}
    for texts in batches:
        if len(known) > MOST_KNOWN:
            known = {None: nothing}
        new = [t for t in dict.fromkeys(texts) if t and t not in known]
        found = {t: told(rows, is_sentence(clean(t))) for t, rows in zip(new, one.parts_many(new))}
        known |= {t: r for t, r in found.items() if len(t) < 500}
        found |= known
        yield [found[t or None] for t in texts]


def identify_column(profiles: Profiles):
    """A pandas UDF text → (its segments with language and confidence, whether it is a sentence)."""

    @F.pandas_udf(f"struct<{FOUND}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        told = lambda rows, sentence: ([dict(zip(("start", "length", "lang_code", "confidence"), r)) for r in rows], sentence)
        for rows in _remembering(batches, profiles, told, ([], False)):
            yield pd.DataFrame({"parts": [r[0] for r in rows], "sentence": [r[1] for r in rows]})

    return run.asNondeterministic()  # else a filter on the result would ask a second time, before the spread


def codes_column(profiles: Profiles):
    """The same in brief: a pandas UDF text → ``1`` for a sentence, else ``0``, and its languages' codes
    joined by commas."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        told = lambda rows, sentence: f"{sentence:d}" + ",".join(dict.fromkeys(r[2] for r in rows))
        for rows in _remembering(batches, profiles, told, "0"):
            yield pd.Series(rows, dtype=object)

    return run.asNondeterministic()
