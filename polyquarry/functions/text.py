"""Column functions over text: normal forms, tokens, slugs, alias equality and answer leakage.

All are built-in expressions and stay in the JVM. Null is read as the empty text unless said otherwise.
White space is Unicode's, plus the separators U+001C to U+001F; letters and digits are the categories
L and N, so combining marks break words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x{1C}-\x{1F}]+"
#: Short month names and their long forms.
MONTHS = {
    "jan": "january", "feb": "february", "mar": "march", "apr": "april", "jun": "june", "jul": "july", "aug": "august",
    "sep": "september", "sept": "september", "oct": "october", "nov": "november", "dec": "december",
}
#: Words that name a kind and don't tell answers apart.
KIND_WORDS = ["type", "class", "classification", "category"]


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_ws(c: Column) -> Column:
    """White space collapsed to single spaces, outer white space removed."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def strip(c: Column) -> Column:
    """Outer white space of any kind removed, inner kept."""
    return F.regexp_replace(F.regexp_replace(text(c), "^" + SPACE, ""), SPACE + r"\z", "")


def slug(c: Column, empty: str = "") -> Column:
    """Lower-case letters a-z and digits joined by underscores; ``empty`` stands for nothing left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s) if empty else s


def fold(c: Column) -> Column:
    """Case folded as far as built-ins go: lower case and ß as ss. ``casefold_udf`` is exact."""
    return F.regexp_replace(F.lower(text(c)), "ß", "ss")


def match_key(c: Column) -> Column:
    """Folded words (letters, digits, underscores) separated by single spaces."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_]+", " "))


def ascii_han_key(c: Column) -> Column:
    """Lower-case a-z, digits and Han of the main block, separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\x{4E00}-\x{9FFF}]+", " "))


def unicode_key(c: Column) -> Column:
    """Folded letters and digits of any script, separated by single spaces; marks break words."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def words(key: Column) -> Column:
    """The words of a key, without empty ones."""
    return F.filter(F.split(key, " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Words, counting inner apostrophes and hyphens as part of one."""
    return F.regexp_count(text(c), F.lit(r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*"))


def space_words(c: Column) -> Column:
    """Number of pieces between white space."""
    return F.size(words(normalize_ws(c)))


def canonical_words(c: Column) -> Column:
    """Words of the match key with ordinals as numbers and months in full, in order."""
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    plain = lambda w: F.regexp_replace(w, r"^(\d+)(st|nd|rd|th)$", "$1")
    return F.transform(words(match_key(c)), lambda w: F.coalesce(F.try_element_at(table, plain(w)), plain(w)))


def acronym(c: Column) -> Column:
    """First characters of the ASCII words, upper case."""
    ascii_words = F.filter(F.split(text(c), "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(ascii_words, lambda w: F.substring(w, 1, 1)), ""))


def padded(key: Column) -> Column:
    return F.concat(F.lit(" "), key, F.lit(" "))


def phrase_in(phrase: Column, whole: Column) -> Column:
    """Whether the words of ``phrase`` stand in ``whole`` as a run; never for wordless texts."""
    p, w = match_key(phrase), match_key(whole)
    return (p != "") & (w != "") & F.contains(padded(w), padded(p))


def _same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def _late_rules(alias: Column, answer: Column, a: Column, b: Column, canonical: Column) -> Column:
    """The rules shared by both versions once neither key contains the other: canonical words, words
    without kind words, equal sets of words with digits, acronym either way."""
    core = lambda ws: F.array_except(F.array_distinct(ws), F.array(*[F.lit(k) for k in KIND_WORDS]))
    numbers = lambda ws: F.array_distinct(F.filter(ws, lambda w: w.rlike(r"\p{Nd}")))
    aw, bw = words(a), words(b)
    short = lambda key, other: (F.length(acronym(other)) >= 2) & (F.upper(F.regexp_replace(key, " ", "")) == acronym(other))
    return (
        canonical
        | (F.size(core(aw)) > 0) & _same_set(core(aw), core(bw))
        | (F.size(numbers(aw)) > 0) & _same_set(numbers(aw), numbers(bw))
        | short(a, answer)
        | short(b, alias)
    )


def alias_equivalent_v1(alias: Column, answer: Column) -> Column:
    """Whether an alias says the same as the answer: equal keys, one key inside the other, or one of the
    late rules. Containment is by characters, so a one-letter alias equals many answers."""
    a, b = match_key(alias), match_key(answer)
    both = (a != "") & (b != "")
    return both & (F.contains(a, b) | F.contains(b, a) | _late_rules(alias, answer, a, b, canonical_words(alias) == canonical_words(answer)))


def alias_equivalent_v2(alias: Column, answer: Column) -> Column:
    """Unicode keys first (equal, contained, same set of words), then the rules over ASCII and Han."""
    ua, ub = unicode_key(alias), unicode_key(answer)
    early = (ua != "") & (ub != "") & (F.contains(ua, ub) | F.contains(ub, ua) | _same_set(words(ua), words(ub)))
    a, b = ascii_han_key(alias), ascii_han_key(answer)
    both = (a != "") & (b != "")
    return early | both & (F.contains(a, b) | F.contains(b, a) | _late_rules(alias, answer, a, b, _same_set(words(a), words(b))))


def is_topic(value: Column, *topics: Column) -> Column:
    """Whether a value is the topic's own name in any of its fields."""
    k = match_key(value)
    return (k != "") & reduce(lambda x, y: x | y, [k == match_key(t) for t in topics])


def clean_aliases(aliases: Column) -> Column:
    """Aliases with white space normalised, blanks and repeats dropped, order kept; null gives none."""
    some = F.coalesce(aliases, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(some, normalize_ws), lambda a: a != ""))


def safe_aliases(aliases: Column, answer: Column, *topics: Column, version: int = 1) -> Column:
    """Aliases that differ from the answer, don't name the topic and are equivalent to the answer."""
    same = alias_equivalent_v1 if version == 1 else alias_equivalent_v2
    return F.filter(clean_aliases(aliases), lambda a: (a != answer) & ~(is_topic(a, *topics) if topics else F.lit(False)) & same(a, answer))


def leakage_terms(answer: Column, aliases: Column) -> Column:
    """Answer and aliases long enough to give something away: three characters, or a digit."""
    terms = F.array_distinct(F.concat(F.array(text(answer)), F.coalesce(aliases, F.array().cast("array<string>"))))
    compact = lambda t: F.regexp_replace(match_key(t), " ", "")
    return F.filter(terms, lambda t: (compact(t) != "") & ((F.length(compact(t)) >= 3) | compact(t).rlike(r"\p{Nd}")))


def leaks(question: Column, answer: Column, aliases: Column, *topics: Column) -> Column:
    """The terms of the answer that stand in the question and don't name the topic."""
    return F.filter(leakage_terms(answer, aliases), lambda t: phrase_in(t, question) & ~(is_topic(t, *topics) if topics else F.lit(False)))


def span_supported(page: Column, span: Column) -> Column:
    """Whether a non-blank span stands in the page, white space aside; case counts."""
    s = normalize_ws(span)
    return (s != "") & F.contains(normalize_ws(page), s)


def answer_supported(answer: Column, span: Column) -> Column:
    a = F.lower(normalize_ws(answer))
    return (a != "") & F.contains(F.lower(normalize_ws(span)), a)


def swap_language(qa_id: Column, language: str) -> Column:
    """The first ``__en__`` of an id replaced by another language; ids without it get a suffix-free copy."""
    return F.regexp_replace(qa_id, r"^(.*?)__en__", f"$1__{language}__")


def cut_generation(generation: Column, *stops: str) -> Column:
    """A generation up to the first of the stop words, outer white space removed."""
    return strip(reduce(lambda c, s: F.substring_index(c, s, 1), stops, text(generation)))


def strip_fence(c: Column) -> Column:
    """A code fence around a text removed, with the language behind its opening."""
    t = strip(c)
    return strip(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z0-9_-]*\s*", ""), r"\s*```\z", ""))


def split_versus(c: Column) -> Column:
    """Both sides of ``a vs b`` as an array of at most two."""
    return F.split(normalize_ws(c), " vs ", 2)
