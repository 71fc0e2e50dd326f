"""Vectorised functions for what built-ins can't express: Unicode normal form, exact case folding,
compressed length, the mixed-script tokenizer with ROUGE-L, and the first JSON value in a text."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

_SPACES = re.compile(r"\s+")


@F.pandas_udf(StringType())
def nfkc_ws(values: pd.Series) -> pd.Series:
    """NFKC with white space collapsed; null stays null."""
    return values.map(lambda v: None if v is None else _SPACES.sub(" ", unicodedata.normalize("NFKC", v)).strip())


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(LongType())
def zlib_length(values: pd.Series) -> pd.Series:
    """Bytes of the zlib stream of the UTF-8 text; null as empty."""
    return values.map(lambda v: len(zlib.compress((v or "").encode())))


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_sha256(values: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text in canonical form (sorted keys, no spaces); null for text that is no JSON."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else hashlib.sha256(canonical_json(json.loads(v)).encode()).hexdigest()
        except ValueError:
            return None

    return values.map(one)


@F.pandas_udf(StringType())
def first_json(values: pd.Series) -> pd.Series:
    """The first JSON object or array that stands in a text, canonical; null where there is none."""
    decoder = json.JSONDecoder()

    def one(v: str | None) -> str | None:
        at = 0
        while v and (m := re.compile(r"[{\[]").search(v, at)):
            try:
                return canonical_json(decoder.raw_decode(v, m.start())[0])
            except ValueError:
                at = m.end()
        return None

    return values.map(one)


# --- ROUGE-L ---------------------------------------------------------------------------------------

_GATE = re.compile("[㐀-䶿一-鿿豈-﫿؀-ۿݐ-ݿࢠ-ࣿঀ-৿฀-๿぀-ゟ゠-ヿｦ-ﾟ]")
_LATIN = re.compile(r"[^a-z0-9]+")


@lru_cache(1 << 15)
def _script(c: str) -> str:
    """``char``: a token by itself; arabic, bengali: part of a run; else Latin."""
    name = unicodedata.name(c, "")
    if name.startswith(("CJK", "HIRAGANA", "KATAKANA", "THAI")):
        return "char"
    return name.split()[0].lower() if name.startswith(("ARABIC", "BENGALI")) else "latin"


_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _measure(stem: str) -> int:
    """Porter's m: how often a vowel run is followed by a consonant run."""
    shape = "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", shape))


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or w[i] == "y" and i > 0 and not _is_vowel(w, i - 1)


def _has_vowel(w: str) -> bool:
    return any(_is_vowel(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and not _is_vowel(w, len(w) - 1) and _is_vowel(w, len(w) - 2) and not _is_vowel(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffix tables of Porter's stemming algorithm (1980), steps 2, 3 and 4.
_STEP2 = dict(zip("ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi".split(), "ate tion ence ance ize ble al ent e ous ize ate ate al ive ful ous al ive ble log".split()))
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(1 << 15)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else ""
        if base and _has_vowel(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) >= 2 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def latin_tokens(text: str) -> list[str]:
    """Lower-case ASCII words; those of more than three characters are stemmed."""
    return [stem(t) if len(t) > 3 else t for t in _LATIN.sub(" ", text.lower()).split()]


def mixed_tokens(text: str | None) -> list[str]:
    """Tokens of a text in mixed scripts: Han, kana and Thai by character, Arabic and Bengali by run of
    letters, all else by the Latin tokenizer. Null and empty texts have none."""
    text = text or ""
    if not _GATE.search(text):
        return latin_tokens(text)
    out: list[str] = []
    run, kind = "", ""
    for c in [*text, ""]:
        script = _script(c) if c else "end"
        if run and script != kind:
            out += latin_tokens(run) if kind == "latin" else [run]
            run = ""
        if script == "char":
            out.append(c)
        elif c:
            run += c
        kind = script
    return out


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    masks: dict[str, int] = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for t in b:
        match = row & masks.get(t, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def rouge_l_f1(reference: str | None, candidate: str | None) -> float:
    r, c = mixed_tokens(reference), mixed_tokens(candidate)
    if not r or not c:
        return 0.0
    common = lcs(r, c)
    precision, recall = common / len(c), common / len(r)
    return 2 * precision * recall / (precision + recall) if common else 0.0


@F.pandas_udf(DoubleType())
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """ROUGE-L F1 of candidate against reference; 0 where either has no token."""
    return pd.Series([rouge_l_f1(a, b) for a, b in zip(reference, candidate)], dtype=float)
