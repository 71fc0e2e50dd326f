"""One form for values that look the same.

Each distinct value is mapped to the plain characters it looks like: compatibility forms, composed
sequences, invisible characters, odd spaces and letters of another script inside a word. Values are then
grouped by the mapped text under the accent-sensitive collation UNICODE in SQL; each equivalence class
takes its least plain member as the canonical one (the mapped text where no member is plain), which is
joined back. Only values with a suspicious character (a regular expression in the JVM) reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from polyquarry.session import broadcast_if_small, cut

#: A value in more than one of so many changed rows is joined by a broadcast.
HOT_SHARE = 1000
#: Values with none of these need no mapping: letters beyond the plain ones of the ten languages,
#: marks that compose, format characters, odd spaces. Supplementary planes are always looked at.
_ODD = (
    "[\\u0000-\\u0008\\u000E-\\u001F\\u007F-\\u00A0\\u00AD\\u00B5\\u0132-\\u0133\\u0149\\u017F-\\u0183\\u01C4-\\u01CC\\u01F1-\\u01F3\\u0250-\\u05FF\\u0610-\\u061A\\u061C\\u064B-\\u065F"
    "\\u0670-\\u06FF\\u0700-\\u0963\\u0966-\\u0980\\u09D7\\u09DC-\\u09DF\\u0A00-\\u0DFF\\u0E4D\\u0F00-\\u1DFF\\u2000-\\u200F\\u2011\\u2028-\\u202F\\u205F-\\u206F\\u20D0-\\u20FF"
    "\\u2100-\\u218F\\u2800\\u2C60-\\u2DFF\\u2E80-\\u2FDF\\u3000\\u3099\\u309A\\u3164\\u3130-\\u318F\\uA4D0-\\uABFF\\uD7B0-\\uDFFF\\uE000-\\uFF00\\uFF02-\\uFF07\\uFF0A\\uFF0B\\uFF0D-\\uFF19\\uFF1C-\\uFF1E\\uFF20-\\uFFFF]"
    "|เเ|[অে]া"
    "|[ァ-ヺー][二力口工八夕卜へりべぺ一三千]|[二力口工八夕卜へりべぺ一三千][ァ-ヺー]|[0-9][OlI][0-9]"
)

_WIDE, _EAST = "[！（），：；？]", "[\\u3040-\\u30FF\\u3400-\\u9FFF]"
_ASCII_ODD = "[\\x00-\\x08\\x0E-\\x1F\\x7F]|[0-9][OlI][0-9]"

#: Letters of other scripts and the Latin letter of the same look.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵԍүАΒΕΖΗΙΚΜΝΟΡΤΥΧΑονικυρϲϳТօցսոԱՏՕհ",
        "ABESIJKMHOPCTYXaesijopcyxhdqwvGyABEZHIKMNOPTYXAovikupcjToqunUSOh",
        strict=True,
    )
)
#: Han and hiragana of the same look as a katakana letter.
KATAKANA = dict(zip("二力口工八夕卜へりべぺ一三千", "ニカロエハタトヘリベペーミチ", strict=True))
_COUNTED = set("一三千")
#: Sequences that no normal form joins, and letters of other languages in the same script.
SEQUENCES = {"เเ": "แ", "ํา": "ำ", "অা": "আ"}
ARABIC = {"ی": "ي", "ک": "ك", "ہ": "ه", "ە": "ه", "ھ": "ه", "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩"}
_INVISIBLE = set("͏ᅟᅠ឴឵᠋᠌᠍᠎᠏⠀ㅤﾠ")
_WIDE_PUNCTUATION = {c for c in map(chr, (*range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF61)))}
_FORMS = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>", "<noBreak>")
_LATIN_WORDS = set("aeiouyAEIOUY")
_HAN_KANA = re.compile("[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_KATA_RUN = re.compile("[ァ-ヺー二力口工八夕卜へりべぺ一三千]{2,}")
_KATAKANA = re.compile("[ァ-ヺ]")
_BEFORE_NAME = re.compile("(?:から|まで|より|[はがをのにでとやも・、。]|^)$")


_ODD_RE, _WIDE_RE, _EAST_RE, _ASCII_ODD_RE = (re.compile(p) for p in (_ODD, _WIDE, _EAST, _ASCII_ODD))


def odd(text: str) -> bool:
    """Whether a text has anything to be mapped; never False for a text that ``mapped`` would change."""
    if text.isascii():
        return bool(_ASCII_ODD_RE.search(text))
    return bool(_ODD_RE.search(text)) or bool(_WIDE_RE.search(text)) and not _EAST_RE.search(text)


def odd_column(c: Column) -> Column:
    """The same in the JVM; ASCII texts are told by their length in bytes and skip the long patterns."""
    beyond = c.rlike(_ODD) | c.rlike(_WIDE) & ~c.rlike(_EAST)
    return F.coalesce(F.when(F.octet_length(c) == F.length(c), c.rlike(_ASCII_ODD)).otherwise(beyond), F.lit(False))


@lru_cache(1 << 14)
def _plain(c: str) -> str:
    """The plain text that one character stands for by Unicode's own decompositions."""
    if c in "\t\n\r\v\f\x85  ":
        return c
    kind = unicodedata.category(c)
    if kind == "Cf" or kind == "Cc" or c in _INVISIBLE or "︀" <= c <= "️" or "\U000e0000" <= c <= "\U000e0fff":
        return ""
    if kind == "Zs":
        return " "
    form = unicodedata.decomposition(c)
    if not form:
        return c
    if form.startswith(_FORMS) or form.startswith("<compat>") and (kind[0] in "LN" or "⺀" <= c <= "⿟") or not form.startswith("<"):
        return unicodedata.normalize("NFKC", c)
    return c


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0].split("-")[0]


def _words(text: str) -> str:
    """Letters of another script inside a Latin word replaced by the Latin ones they look like."""
    if not any(c in LOOKALIKES for c in text):
        return text
    latin = any(_script(c) == "LATIN" for c in text if c.isalpha())

    def fix(m: re.Match) -> str:
        w = m.group()
        if not any(c in LOOKALIKES for c in w):
            return w
        scripts = {_script(c) for c in w if c.isalpha()}
        mixed = "LATIN" in scripts and len(scripts) > 1
        if len(w) == 1:  # a symbol by itself stays; a word of one letter doesn't
            around = text[m.start() - 1 : m.start()] in ("", " ") and text[m.end() : m.end() + 1] in (" ", "")
            disguised = latin and around and LOOKALIKES[w] in _LATIN_WORDS and len(text) > 1
        else:  # a word wholly of look-alikes in a Latin text, or by itself
            disguised = all(c in LOOKALIKES for c in w if c.isalpha()) and (latin or len(w) > 2)
        return "".join(LOOKALIKES.get(c, c) for c in w) if mixed or disguised else w

    return re.sub(r"[^\W\d_]+", fix, text)


def _katakana(text: str) -> str:
    def fix(m: re.Match) -> str:
        run = m.group()
        if not _KATAKANA.search(run):
            return run
        out = []
        for i, c in enumerate(run):
            before, after = run[i - 1 : i] if i else "", run[i + 1 : i + 2]
            if c in _COUNTED and not (before and after):
                out.append(c)
            elif c in "へりべぺ" and not (after and (before or _BEFORE_NAME.search(text[max(0, m.start() - 2) : m.start()]))):
                out.append(c)
            else:
                out.append(KATAKANA.get(c, c))
        return "".join(out)

    return _KATA_RUN.sub(fix, text)


def mapped(value: str | None) -> str | None:
    """The plain text that ``value`` looks like. Null stays null, empty stays empty; tabs, line ends,
    the text's own punctuation and a letter used as a symbol by itself stay as they are."""
    if not value:
        return value
    east = bool(_HAN_KANA.search(value))
    text = "".join(c if east and c in _WIDE_PUNCTUATION else _plain(c) for c in value)
    text = unicodedata.normalize("NFC", text)
    for a, b in SEQUENCES.items():
        text = text.replace(a, b)
    if any(c in ARABIC for c in text):
        text = "".join(ARABIC.get(c, c) for c in text)
    text = _katakana(_words(text))
    return re.sub(r"(?<=\d)[OlI](?=\d)", lambda m: "0" if m.group() == "O" else "1", text)


@F.pandas_udf(StringType())
def _mapped(values: pd.Series) -> pd.Series:
    return values.map(mapped)


mapped_udf = _mapped.asNondeterministic()  # else a filter on its result would map a second time


def canonical_values(values: DataFrame, column: str = "value") -> DataFrame:
    """One row per distinct suspicious ``value``: value, canonical, and ``n``, how many rows hold it.

    ``values`` holds one text column of any length and number of repeats. Null values have no row. The
    classes are formed in SQL under the collation UNICODE, which tells accents and case apart.
    """
    spark = values.sparkSession
    distinct = values.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    look = distinct.select("value", "n", odd_column(F.col("value")).alias("odd"))
    odd = look.filter("odd").select("value", "n", mapped_udf("value").alias("shape"))
    # plain members are their own shape; only those that share a class with an odd value matter
    members = odd.unionByName(look.filter("NOT odd").select("value", "n", F.col("value").alias("shape")))
    return spark.sql(
        """
        WITH m AS (SELECT value, n, shape, collate(shape, 'UNICODE') AS look FROM {members}),
        c AS (SELECT look, min(struct(value <> shape AS changed, value AS member, shape)) AS best, max(value <> shape) AS any_odd FROM m GROUP BY look)
        SELECT m.value, m.n, CASE WHEN c.best.changed THEN c.best.shape ELSE c.best.member END AS canonical
        FROM m JOIN c ON m.look = c.look WHERE c.any_odd AND m.value <> m.shape
        """,
        members=members,
    )


def unify(rows: DataFrame, column: str = "value") -> DataFrame:
    """``rows`` with ``canonical`` beside ``column``: the one form of all values that look the same.

    Plain values are their own canonical form and are not shuffled for it. Of the odd ones, those that hold
    more than one in ``HOT_SHARE`` of the changed rows are at most so many and are joined by a broadcast of
    counted size; the rest is joined by a shuffle in which no value holds more than that share. Null stays
    null. Extra columns are kept; one that is named ``canonical`` is replaced.
    """
    odd = odd_column(F.col(column))
    classes = cut(canonical_values(rows, column).select(F.col("value").alias("__value"), F.col("canonical").alias("__canonical"), "n"))
    total = int(classes.agg(F.sum("n")).first()[0] or 0)
    hot, cold = (classes.filter(c).drop("n") for c in (F.col("n") * HOT_SHARE >= total, F.col("n") * HOT_SHARE < total))
    many, size = hot.agg(F.count(F.lit(1)), F.sum(F.octet_length("__value") + F.octet_length("__canonical"))).first()
    is_hot = broadcast_if_small(hot, many, 64 + int(size or 0) // max(1, many))
    match = F.col(column) == F.col("__value")
    first = rows.filter(odd).join(is_hot, match, "left").withColumnRenamed("__canonical", "__hot").drop("__value")
    out = [*(c for c in rows.columns if c != "canonical"), "canonical"]
    found = first.filter(F.col("__hot").isNotNull()).withColumn("canonical", F.col("__hot")).select(*out)
    rest = first.filter(F.col("__hot").isNull()).join(cold, match, "left").withColumn("canonical", F.coalesce("__canonical", F.col(column))).select(*out)
    return found.unionByName(rest).unionByName(rows.filter(~odd).withColumn("canonical", F.col(column)).select(*out))
