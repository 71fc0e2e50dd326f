"""Held-out passages inside a corpus, by template windows with slot checks.

Each sentence of a held-out passage becomes a template: figures, names and units turn into typed
placeholders, whose values are the sentence's slots. All windows of the template (three words, or five
characters in scripts without spaces; less where the sentence is too short to keep one beside an
exchange) are hashed, each with the value of the sentence's rarest slot wherever that lies. The corpus is
typed alike and scanned once; its windows that are in the table of held-out hashes are the rows of an
equi-join on the hash with the held-out windows. Each joined place is then checked: the whole sentence is
laid over the text and its slots are compared one by one; all have to agree, one word that is no slot may
be exchanged. A re-parameterised statement has the template and fails at its slots (``templates`` finds
those). Case, spacing, line breaks, marks and character forms play no part; the sentence may run across
line ends.

Equal sentences are one class with the items that hold it. The held-out set is a stated query set: its words
and window hashes go to the executors as arrays of a bounded block (``BLOCK`` sentences; a larger set is
taken in blocks). Only texts that hold a held-out hash leave the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.lookalikes import mapped, odd
from polyquarry.session import broadcast_if_small, cut, spread

#: Sentences of a block; with some twelve windows each its arrays stay below 20 MB.
BLOCK = 50_000
WORDS, CHARS = 3, 5
#: Longest run of characters that counts as one exchanged word in scripts without spaces.
RUN = 6
DIGITS = frozenset("0123456789")

_TOKEN = re.compile("[0-9]+(?:[.,'’ ][0-9]{3})+(?![0-9])|[0-9]+|[฀-๿぀-ヿ㐀-鿿々]|[^\\W\\d_฀-๿぀-ヿ㐀-鿿]+(?:[ঀ-৿ً-ْ][^\\W\\d_]*)*")
_EAST = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_SENTENCE = re.compile(r"(?<=[。！？।])|(?<=[.!?؟])\s+|[\r\n]+")
#: Units whose wording is a placeholder, not a slot value.
UNITS = {"kilometres", "kilometers", "km", "kilometer", "kilomètres", "kilómetros", "kilomita", "crowns", "kronen", "couronnes", "coronas", "taji", "pence"}


def tokens(text: str) -> list[str]:
    """Words (characters in scripts without spaces) and figures with their case."""
    return [t if t[0] not in DIGITS or t.isdigit() else _NO_DIGIT.sub("", t) for t in _TOKEN.findall(text)]


def pieces(span: str) -> list[str]:
    """The sentences of a passage."""
    parts = [p.strip() for p in _SENTENCE.split(span) if p and p.strip()]
    return [q for p in parts for q in ([p] if not re.search("[฀-๿]", p) else _thai(p))]


def _thai(part: str) -> list[str]:
    """Thai has no sentence marks: a new sentence starts at a space behind a closing figure or counted
    noun, unless what follows links on."""
    out, at = [], 0
    for m in re.finditer(r" (?=[฀-๿])", part):
        before, after = part[at : m.start()], part[m.end() :]
        closed = re.search(r"(?:[0-9]{3,4}|[0-9] ?(?:ชิ้น|ชั้น|มงกุฎ|กิโลเมตร|คน|เมตร|บาท|เล่ม|หลัง|แห่ง|ครั้ง|ปี))$", before)
        if closed and not re.match(r"(?:และ|หรือ|คน|ชิ้น|ชั้น|มงกุฎ|กิโลเมตร|เมตร|เผา|ไปแล้ว|โดย|ที่|ซึ่ง|ใน|จาก|ถึง)", after):
            out.append(before)
            at = m.end()
    out.append(part[at:])
    return [p.strip() for p in out if p.strip()]


def is_notice(sentence: list[str], others: list[list[str]]) -> bool:
    """Whether the last sentence of a passage is a standing notice: it has no figure and says nothing of
    the passage's subject, so it has no name in common with the other sentences. In scripts without capital
    letters a subject is a run of two words (four characters where there are no spaces). The only sentence
    of a passage is no notice."""
    if not others or any(w[0] in DIGITS for w in sentence):
        return False
    folded = [w.casefold() for w in sentence]
    if any(w.upper() != w.lower() for w in sentence):
        names = {w.casefold() for w in sentence[1:] if w[:1].isupper()} | ({folded[0]} if len(sentence) > 1 and sentence[1][:1].isupper() else set())
        return not any(names & {w.casefold() for w in o} for o in others)
    k = 4 if _EAST.search("".join(sentence)) else 2
    runs = {tuple(folded[i : i + k]) for i in range(len(folded) - k + 1)}
    return not any(runs & {tuple(o[i : i + k]) for i in range(len(o) - k + 1)} for o in ([w.casefold() for w in o] for o in others))


def sentences_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, passage) → item_id, notice, words (with their case and folded) of each sentence. Sentences of fewer
    than four words need a figure and another word to stand for anything."""
    for b in batches:
        rows = []
        for item, span in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = [t for s in pieces(mapped(span) if odd(span) else span) if (t := tokens(s))]
            for n, t in enumerate(found):
                if len(t) >= 4 or len(t) > 1 and any(w[0] in DIGITS for w in t):
                    rows.append((item, n + 1 == len(found) and is_notice(t, found[:n]), t))
        if rows:
            items, notices, words = zip(*rows)
            lists = [pa.array(w, pa.list_(pa.string())) for w in (words, [[x.casefold() for x in t] for t in words])]
            yield pa.RecordBatch.from_arrays([pa.array(items, b.schema.field(0).type), pa.array(notices), *lists], ["item_id", "notice", "words", "folded"])


def run_of(size: int) -> int:
    """The longest run of characters that may be exchanged in a sentence of ``size`` characters."""
    return min(RUN, int(0.4 * size + 1e-9))


def width(size: int, east: bool) -> int:
    """Width of a sentence's windows: wherever the one exchange lies, a whole window stands beside it."""
    return max(1, min(CHARS, (size - run_of(size) + 1) // 2)) if east else max(1, min(WORDS, size // 2))


# --- hashes of both sides -------------------------------------------------------------------------------------


@lru_cache(1 << 16)
def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little") | 1


_MIX, _SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hash(typed: np.ndarray, size: int, east: bool) -> np.ndarray:
    """Hash of each window of ``size`` typed words (unsigned 64 bits, wrapping)."""
    n = len(typed) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(2 * size + east), dtype=np.uint64)
    for k in range(size):
        out = (out ^ typed[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def key_hash(window: np.ndarray, off: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hash of a window with the value of a slot ``off`` places from its start."""
    out = (window ^ (off.astype(np.int64) + 4096).astype(np.uint64) * _SLOT ^ value) * _MIX
    return out ^ (out >> np.uint64(31))


def _kind_hash(word: str, kind: str) -> int:
    return word_hash(f"<{kind}>") if kind != "w" else word_hash(word)


def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, words, types, slot) → key, window, off, value, east, size, sid, at: the windows of each template.
    ``types``: kind per word as typed on both sides; ``slot``: place of the rarest slot or -1."""
    names = ["key", "window", "off", "value", "east", "size", "sid", "at"]
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in names]
        for sid, words, types, slot in zip(*(b.column(i).to_pylist() for i in range(4))):
            east = bool(_EAST.search("".join(words)))
            k = width(len(words), east)
            typed = np.array([_kind_hash(w, t) for w, t in zip(words, types)], dtype=np.uint64)
            h = window_hash(typed, k, east)
            at = np.arange(len(h))
            place = at if slot < 0 else np.full(len(h), slot)  # of a sentence without slots, the window itself
            value = np.array([word_hash(words[p]) for p in place], dtype=np.uint64)
            off = place - at
            for c, v in zip(cols, (key_hash(h, off, value).view(np.int64), h.view(np.int64), off, value.view(np.int64), np.full(len(h), east), np.full(len(h), k), np.full(len(h), sid), at)):
                c.append(v)
        if cols[0]:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, kinds)], names)


class Scanner:
    """Finds held-out hashes in texts. ``vocabulary``: held-out word → its kind; (``window``, ``off``,
    ``east``, ``size``), ``keys`` and slot ``values`` of the held-out windows."""

    def __init__(self, vocabulary: dict[str, str], window: np.ndarray, off: np.ndarray, east: np.ndarray, size: np.ndarray, keys: np.ndarray, values: np.ndarray):
        self.place = {w: i for i, w in enumerate(vocabulary, 2)}
        kinds = list(vocabulary.items())
        # places 0 and 1: an unknown word, which no window holds, and an unknown figure
        self.typed = np.array([0, _kind_hash("", "n"), *(_kind_hash(w, k) for w, k in kinds)], dtype=np.uint64)
        own = np.array([0, 0, *(word_hash(w) for w, _ in kinds)], dtype=np.uint64)
        self.own = np.where(np.isin(own, values), own, np.uint64(0))
        self.classes = []
        for e, s in sorted({*zip(east.tolist(), size.tolist())}):
            mine = (east == e) & (size == s)
            order = np.argsort(window[mine], kind="stable")
            table = window[mine][order]
            first = np.zeros(1 << 18, dtype=bool)  # a coarse look before the search
            first[table >> np.uint64(46)] = True
            self.classes.append((e, s, table, off[mine][order], first))
        self.keys = np.sort(keys)

    def places(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of all texts in the vocabulary, and where each text starts; texts are
        parted by an unknown word."""
        get, flat, starts = self.place.get, [], []
        for t in texts:
            starts.append(len(flat))
            flat += [get(w, 1 if w[0] in DIGITS else 0) for w in t]
            flat.append(0)
        return np.array(flat, dtype=np.int32), np.array([*starts, len(flat)], dtype=np.int64)

    def hits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, key and place of each window that stands in the held-out table together
        with its slot."""
        ids, starts = self.places(texts)
        typed, own = self.typed[ids], self.own[ids]
        known = typed != 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for east, size, table, offs, first in self.classes:
            if len(ids) < size:
                continue
            whole = known[: len(ids) - size + 1].copy()
            for k in range(1, size):
                whole &= known[k : len(ids) - size + 1 + k]
            at = np.flatnonzero(whole)
            h = window_hash(typed, size, east)[at]
            some = first[h >> np.uint64(46)]
            at, h = at[some], h[some]
            lo = np.searchsorted(table, h)
            there = table[np.minimum(lo, len(table) - 1)] == h
            at, h, lo = at[there], h[there], lo[there]
            many = np.searchsorted(table, h, side="right") - lo
            at, h = np.repeat(at, many), np.repeat(h, many)
            off = offs[np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(at))] if len(at) else np.zeros(0, dtype=np.int64)
            # behind an exchanged run of another length the slot lies some places off
            outside = (off < 0) | (off >= size)
            for move in range(-RUN, RUN + 1) if east else (0,):
                use = np.ones(len(at), dtype=bool) if not move else outside
                p = at[use] + off[use] + move
                inside = (p >= 0) & (p < len(ids))
                a, w, o, p = at[use][inside], h[use][inside], off[use][inside], p[inside]
                v = own[p]
                slot = v != 0
                a, key = a[slot], key_hash(w[slot], o[slot], v[slot])
                there = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
                found.append((key[there], a[there]))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        keys, at = (np.concatenate(x) for x in zip(*found))
        text = np.searchsorted(starts, at, side="right") - 1
        return text, keys.view(np.int64), at - starts[text]


def agrees(words: list[str], kinds: str, t: list[str], at: int, i: int) -> bool:
    """Whether the sentence (case-folded words and their kinds) lies over ``t`` with its token ``i`` at
    ``at``: all slots alike, at most one other word (a run of characters without figure in scripts without
    spaces) exchanged, none in a sentence of fewer than four words."""
    n = len(words)
    # to the left and right of the joined token as far as they agree
    a = 0
    while a < i and at - 1 - a >= 0 and t[at - 1 - a] == words[i - 1 - a]:
        a += 1
    b = 0
    while i + b < n and at + b < len(t) and t[at + b] == words[i + b]:
        b += 1
    if a == i and i + b == n:
        return True
    if a < i and i + b < n or n < 4:
        return False  # two places differ
    run = RUN if _EAST.search("".join(words)) else 1
    if i + b < n:  # one exchange to the right, the rest has to agree up to the end
        lo, ends = i + b, [at + b + d for d in range(1, run + 1)]
        for to in range(lo + 1, min(n, lo + run) + 1):
            if any(k in "nN" for k in kinds[lo:to]):
                break
            for e in ends:
                if e + n - to <= len(t) and t[e : e + n - to] == words[to:] and not any(x[0] in DIGITS for x in t[at + b : e]):
                    return n - to + b + a >= 0.6 * n
        return False
    hi, start = i - a, at - a
    for to in range(hi - 1, max(0, hi - run) - 1, -1):
        if any(k in "nN" for k in kinds[to:hi]):
            break
        for d in range(1, run + 1):
            e = start - d - to
            if e >= 0 and t[e : e + to] == words[:to] and not any(x[0] in DIGITS for x in t[start - d : start]):
                return to + a + b >= 0.6 * n
    return False


# --- the join ----------------------------------------------------------------------------------------------------


def sentence_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sentences (sid, words, kinds, notice) of all passages, and which item holds which
    (sid, item_id). A word is a name (N) where it is capitalised inside its sentence, or first before
    another name and nowhere in lower case; figures are n, units u, others w."""
    spans = items.select("item_id", "source_span").filter("item_id IS NOT NULL AND source_span IS NOT NULL").distinct()
    raw = cut(spans.mapInArrow(sentences_of, f"item_id {dict(items.dtypes)['item_id']}, notice boolean, words array<string>, folded array<string>"))
    w = raw.select("words", "folded").distinct().withColumn("sid", F.xxhash64("words"))
    t = w.select("sid", F.posexplode(F.arrays_zip("words", "folded")).alias("i", "x"), F.get("words", F.lit(1)).alias("second")).select("sid", "i", F.col("x.words").alias("w"), F.col("x.folded").alias("folded"), "second")
    upper = lambda c: F.substring(c, 1, 1).rlike(r"\p{Lu}")
    lower = t.filter(F.substring("w", 1, 1).rlike(r"\p{Ll}")).select(F.col("folded").alias("__l")).distinct()
    t = t.join(lower, F.col("folded") == F.col("__l"), "left")
    kind = (
        F.when(F.col("w").rlike("^[0-9]"), "n").when(F.col("folded").isin(*sorted(UNITS)), "u")
        .when(upper(F.col("w")) & ((F.col("i") > 0) | F.col("__l").isNull() & upper(F.col("second"))), "N").otherwise("w")
    )
    kinds = t.groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", kind.alias("k")))), lambda x: x["k"]), "").alias("kinds"))
    cased = w.drop("folded").join(kinds, "sid").join(raw, "words").select("sid", F.col("folded").alias("words"), "kinds", "item_id", "notice")
    # of sentences that differ in case alone, those of equal kinds are one class
    cased = cut(cased.withColumn("sid", F.xxhash64("words", "kinds")))
    return cut(cased.groupBy("sid", "words", "kinds").agg(F.max("notice").alias("notice"))), cased.select("sid", "item_id").distinct()


def _found(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sid), each once: the document holds the whole sentence."""
    kind = dict(documents.dtypes)["doc_id"]
    words = sentences.select("sid", F.posexplode("words").alias("i", "w"), "kinds").withColumn("k", F.substring("kinds", F.col("i") + 1, 1))
    # words are typed one by one, so that both sides are typed alike whatever the case: a name anywhere is a name
    vocabulary = cut(words.groupBy("w").agg(F.max(F.when(F.col("k") == "N", 2).when(F.col("k") == "u", 1).otherwise(0)).alias("rank"), F.max(F.col("k") == "n").alias("figure"), F.count_distinct("sid").alias("often")))
    typed = vocabulary.select("w", "often", F.when(F.col("figure"), "n").when(F.col("rank") == 2, "N").when(F.col("rank") == 1, "u").otherwise("w").alias("type"))
    per = words.join(typed, "w").groupBy("sid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "type"))), lambda x: x["type"]).alias("types"),
        F.coalesce(F.min(F.when(F.col("k").isin("n", "N"), F.struct("often", "i")))["i"], F.lit(-1)).alias("slot"),
    )
    windows = cut(
        sentences.select("sid", "words").join(per, "sid").select("sid", "words", "types", "slot")
        .mapInArrow(windows_of, "key long, window long, off int, value long, east boolean, size int, sid long, at int")
    )
    # of one block: bounded by BLOCK
    known = {r["w"]: r["type"] for r in typed.collect()}
    table = windows.select("window", "off", "value", "east", "size", "key").toPandas()
    if not len(table):
        return documents.select("doc_id", F.lit(None).cast("long").alias("sid")).limit(0)
    distinct = table[["window", "off", "east", "size"]].drop_duplicates()
    arrays = [distinct[c].to_numpy() for c in ("window", "off", "east", "size")] + [np.unique(table[c].to_numpy()) for c in ("key", "value")]
    shared = documents.sparkSession.sparkContext.broadcast((known, arrays))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (window, off, east, size, keys, values) = shared.value
        scanner = Scanner(names, window.view(np.uint64), off.astype(np.int64), east, size, keys.view(np.uint64), values.view(np.uint64))
        for b in batches:
            texts = [tokens((mapped(x) if odd(x) else x).casefold()) for x in b.column(1).to_pylist()]
            number, key, at = scanner.hits(texts)
            if len(number):
                order = np.argsort(number, kind="stable")
                number, key, at = number[order], key[order], at[order]
                some, first = np.unique(number, return_index=True)
                places = pa.StructArray.from_arrays([pa.array(key), pa.array(at, pa.int32())], ["key", "at"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(some)), pa.array([" ".join(texts[n]) for n in some]), pa.ListArray.from_arrays(pa.array([*first, len(number)], pa.int32()), places)],
                    ["doc_id", "tokens", "hits"],
                )

    texts = spread(documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") > 0)))
    held = cut(texts.mapInArrow(scan, f"doc_id {kind}, tokens string, hits array<struct<key:long,at:int>>").withColumn("n", F.monotonically_increasing_id()))
    joined = held.select("n", F.explode("hits").alias("h")).select("n", F.col("h.key").alias("key"), F.col("h.at").alias("place"))
    joined = joined.join(broadcast_if_small(windows.select("key", "sid", "at"), len(table), 24), "key")
    # windows that put the sentence at one place say the same; the texts' words follow only to the places left
    starts = joined.groupBy("n", "sid", (F.col("place") - F.col("at")).alias("start")).agg(F.min(F.struct("at", "place")).alias("p"))
    starts = starts.join(broadcast_if_small(sentences.select("sid", "words", "kinds"), sentences.count(), 400), "sid")
    first = F.greatest(F.col("start") - RUN, F.lit(0))
    pairs = starts.join(held.select("n", "doc_id", "tokens"), "n").select(
        "doc_id", "sid", F.slice(F.split("tokens", " "), first + 1, F.size("words") + 2 * RUN).alias("part"), "words", "kinds", (F.col("p.place") - first).alias("place"), F.col("p.at").alias("at")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [agrees(w, k, t, place, at) for t, w, k, place, at in zip(*(b.column(i).to_pylist() for i in range(2, 7)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["doc_id", "sid"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(check, f"doc_id {kind}, sid long").distinct()


def holders(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sid) of the documents that hold a whole sentence of ``sentence_classes``."""
    blocks = max(1, -(-sentences.count() // BLOCK))
    out = None
    for n in range(blocks):
        found = _found(documents, sentences.filter(F.pmod(F.col("sid"), F.lit(blocks)) == n))
        out = found if out is None else out.unionByName(found)
    return out


def leaks(documents: DataFrame, items: DataFrame, notices: bool = False) -> DataFrame:
    """Pairs (doc_id, item_id), each once: the document holds a whole sentence of the item's passage.

    ``documents``: doc_id, text; ``items``: item_id, source_span. Null and empty texts and passages have
    no pair; sentences of fewer than four words need a figure; extra columns play no part. Standing notices
    (``is_notice``, told from the held-out passages alone) don't count; ``notices`` gives their pairs instead.
    """
    sentences, held_by = sentence_classes(items)
    wanted = sentences.filter("notice" if notices else "NOT notice")
    return holders(documents, wanted).join(held_by, "sid").select("doc_id", "item_id").distinct()


# --- re-parameterised statements ---------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def collapsed(types: list[str], words: list[str]) -> tuple[list[str], list[int]]:
    """A template with neighbouring names as one placeholder, and where each of its parts starts."""
    out, starts = [], []
    for i, (k, w) in enumerate(zip(types, words)):
        if k == "N" and i and types[i - 1] == "N":
            continue
        out.append(f"<{k}>" if k != "w" else w)
        starts.append(i)
    return out, starts


def slot_values(words: list[str], types: list[str]) -> list[str]:
    """Values of the slots in order; a name of several words is one."""
    out: list[str] = []
    for i, (k, w) in enumerate(zip(types, words)):
        if k == "N" and i and types[i - 1] == "N":
            out[-1] += " " + w
        elif k in "nN":
            out.append(w)
    return out


def template_hash(parts: list[str]) -> int:
    total = sum(word_hash(p) * pow(_BASE, i, 1 << 64) for i, p in enumerate(parts))
    return (total + len(parts)) % (1 << 64)


def templates(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements with a held-out sentence's template, by template rather than by sentence: (doc_id,
    template_id, n_same, n_other), where ``n_same`` statements have the slot values of a held-out sentence
    and ``n_other`` have others, so they are re-parameterised; and which item holds which template
    (template_id, item_id). The whole template has to agree; a capitalised word that no held-out sentence
    knows counts as a name. Templates without a slot are left out."""
    kind = dict(documents.dtypes)["doc_id"]
    sentences, held_by = sentence_classes(items)

    words = sentences.select(F.explode(F.arrays_zip("words", F.split("kinds", "").alias("k"))).alias("x")).select(F.col("x.words").alias("w"), F.col("x.k").alias("k"))
    rank = {"n": 3, "N": 2, "u": 1, "w": 0}
    types: dict[str, str] = {}
    for r in words.distinct().collect():  # of the stated query set; words are typed one by one on both sides
        if rank[r["k"]] >= rank.get(types.get(r["w"], "w"), 0):
            types[r["w"]] = r["k"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sid, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = [types[x] for x in w]
                parts = collapsed(k, w)[0]
                if "n" in k or "N" in k:
                    rows.append((sid, template_hash(parts), len(parts), word_hash("\x1f".join(slot_values(w, k)))))
            if rows:
                sids, hashes, sizes, slots = zip(*rows)
                signed = lambda c: pa.array(np.array(c, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), signed(hashes), pa.array(sizes, pa.int32()), signed(slots)], ["sid", "template_id", "size", "slots"])

    known = cut(sentences.select("sid", "words").mapInArrow(make, "sid long, template_id long, size int, slots long"))
    members = known.join(held_by, "sid").select("template_id", "item_id").distinct()
    table = known.select("template_id", "size").distinct().toPandas()
    sizes = {}
    for n, g in table.groupby("size"):
        ids = np.sort(g["template_id"].to_numpy().view(np.uint64))
        coarse = np.zeros(1 << 16, dtype=bool)
        coarse[ids >> np.uint64(48)] = True
        sizes[int(n)] = ids, coarse
    shared = documents.sparkSession.sparkContext.broadcast((types, sizes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, sizes = shared.value
        for b in batches:
            rows = []
            docs, held = b.column(0).to_pylist(), []
            flat: list[int] = []  # hashes of the parts of all texts, parted by unknown ones
            of: list[int] = []
            first: list[int] = []
            for n, text in enumerate(b.column(1).to_pylist()):
                cased = tokens(mapped(text) if odd(text) else text)
                t = [w.casefold() for w in cased]
                k = ["n" if w[0] in DIGITS else types[w] if w in types else "N" if c[0].isupper() else "?" for w, c in zip(t, cased)]
                parts, starts = collapsed(k, t)
                held.append((t, k, [*starts, len(t)]))
                first.append(len(flat))
                flat += [word_hash(p) if p != "<?>" else 0 for p in parts]
                flat.append(0)
                of += [n] * (len(parts) + 1)
            h = np.array(flat, dtype=np.uint64)
            powers, backs = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, len(h) - 1), x, dtype=np.uint64)])[: len(h)] for x in (_BASE, _INVERSE))
            sums = np.r_[np.uint64(0), np.add.accumulate(h * powers)]
            gaps = np.r_[0, np.cumsum(h == 0)]
            for n, (table, coarse) in sizes.items():
                if n > len(h):
                    continue
                at = np.flatnonzero(gaps[n:] == gaps[:-n])
                found = (sums[at + n] - sums[at]) * backs[at] + np.uint64(n)
                some = coarse[found >> np.uint64(48)]
                at, found = at[some], found[some]
                there = table[np.minimum(np.searchsorted(table, found), len(table) - 1)] == found
                for i, value in zip(at[there].tolist(), found[there].view(np.int64).tolist()):
                    d = of[i]
                    t, k, starts = held[d]
                    a, z = starts[i - first[d]], starts[i - first[d] + n]
                    rows.append((docs[d], value, word_hash("\x1f".join(slot_values(t[a:z], k[a:z])))))
            if rows:
                docs, ids, slots = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(ids, pa.int64()), pa.array(np.array(slots, dtype=np.uint64).view(np.int64))], ["doc_id", "template_id", "slots"])

    texts = spread(documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") > 0)))
    found = texts.mapInArrow(scan, f"doc_id {kind}, template_id long, slots long")
    stated = broadcast_if_small(known.select("template_id", "slots", F.lit(True).alias("stated")).distinct(), known.count(), 24)
    pairs = found.join(stated, ["template_id", "slots"], "left").groupBy("doc_id", "template_id").agg(F.count_if("stated").alias("n_same"), F.count_if(F.col("stated").isNull()).alias("n_other"))
    return pairs, members


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Leaking documents per item, items without any included."""
    n = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "holdout_split").distinct().join(n, "item_id", "left").select("item_id", "holdout_split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
