"""Queries over text functions: normal forms, aliases, leakage, spans and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.functions import text as tx
from polyquarry.functions import udfs
from polyquarry.plans.views import QA_SQL, akey, mkey, qa, slug, ukey, ws
from polyquarry.session import table

C = F.col


def cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_card")


def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", tx.normalize_ws(C("fact_statement")).alias("fact"), tx.normalize_ws(C("semantic_slot")).alias("slot")).distinct()


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", tx.slug(C("relation_type")).alias("plain"), tx.slug(C("relation_type"), "card").alias("card"), tx.slug(C("semantic_slot"), "item").alias("item")).distinct()


def match_keys(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", tx.match_key(C("fact_statement")).alias("match"), tx.ascii_han_key(C("fact_statement")).alias("ascii_han"), tx.unicode_key(C("fact_statement")).alias("unicode")).distinct()


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", tx.word_count(C("fact_statement")).cast("long").alias("n_words"), tx.space_words(C("fact_statement")).cast("long").alias("n_pieces")).distinct()


def canonical_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", C("fact_statement"), F.lit("on the 3rd of Sept"))
    return cards(spark, d).select("card_id", F.array_join(tx.canonical_words(text), " ").alias("words")).distinct()


def acronyms(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", tx.acronym(C("topic_name")).alias("acronym")).distinct()


def phrase_in_text(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", tx.phrase_in(C("answer"), C("fact_statement")).alias("found")).distinct()


def span_supported(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", tx.span_supported(C("source_span"), C("fact_statement")).alias("span_in_page"), tx.answer_supported(C("answer"), C("source_span")).alias("answer_in_span")).distinct()


def answer_leakage(spark: SparkSession, d: str) -> DataFrame:
    leaked = tx.leaks(C("question"), C("expected_answer"), C("answer_aliases"))
    return qa(spark, d).select("qa_id", F.explode(leaked).alias("term")).distinct()


def _alias_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = cards(spark, d).select("card_id", "answer", "topic_name", "aliases")
    own = c.select("card_id", F.explode("aliases").alias("alias"), C("topic_name").alias("answer"))
    return own.unionByName(c.select("card_id", C("answer").alias("alias"), C("topic_name").alias("answer"))).unionByName(c.select("card_id", C("topic_name").alias("alias"), "answer")).distinct()


def alias_equivalence_v1(spark: SparkSession, d: str) -> DataFrame:
    return _alias_pairs(spark, d).select("card_id", "alias", "answer", tx.alias_equivalent_v1(C("alias"), C("answer")).alias("equivalent"))


def alias_equivalence_v2(spark: SparkSession, d: str) -> DataFrame:
    return _alias_pairs(spark, d).select("card_id", "alias", "answer", tx.alias_equivalent_v2(C("alias"), C("answer")).alias("equivalent"))


def safe_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of cards that say the topic's name in another form (but not as it stands)."""
    return cards(spark, d).select("card_id", F.explode(tx.safe_aliases(C("aliases"), C("topic_name"))).alias("alias")).distinct()


def swap_language(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("qa_id", tx.swap_language(C("qa_id"), "sw").alias("swapped")).distinct()


def cut_generation(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", tx.cut_generation(C("fact_statement"), "</s>", " of ", " in ").alias("cut")).distinct()


def topic_sides(spark: SparkSession, d: str) -> DataFrame:
    both = cards(spark, d).select("pair_id", F.concat_ws(" vs ", "topic_name", "relation_type", "answer_type").alias("t")).distinct()
    s = tx.split_versus(C("t"))
    return both.select("pair_id", F.get(s, 0).alias("first"), F.get(s, 1).alias("second")).distinct()


def first_json(spark: SparkSession, d: str) -> DataFrame:
    bodies = table(spark, d, "cache_file").select("file_id", udfs.first_json(C("body")).alias("value"))
    return bodies.select("file_id", F.get_json_object("value", "$.source_qa_id").alias("source_qa_id"), udfs.canonical_sha256(C("value")).alias("sha256"), udfs.zlib_length(C("value")).alias("zlib_bytes")).distinct()


def nfkc_texts(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout_card").select("holdout_card_id", "fact_statement").distinct()
    return h.select("holdout_card_id", udfs.nfkc_ws(C("fact_statement")).alias("nfkc"), udfs.casefold(C("fact_statement")).alias("folded"))


QUERIES = {f.__name__: f for f in (normalize_ws, slugify, match_keys, word_counts, canonical_words, acronyms, phrase_in_text, span_supported, answer_leakage, alias_equivalence_v1, alias_equivalence_v2, safe_aliases, swap_language, cut_generation, topic_sides, first_json, nfkc_texts)}


def _words(key: str) -> str:
    return f"list_filter(string_split({key}, ' '), lambda w: w <> '')"


def _acronym(x: str) -> str:
    return f"upper(array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce({x}, ''), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: w[1:1]), ''))"


_MONTHS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.MONTHS.items()) + "}"


def _canonical(x: str) -> str:
    plain = "regexp_replace(w, '^(\\d+)(st|nd|rd|th)$', '\\1')"
    return f"list_transform({_words(mkey(x))}, lambda w: coalesce({_MONTHS}[{plain}], {plain}))"


def _same(a: str, b: str) -> str:
    return f"list_sort(list_distinct({a})) = list_sort(list_distinct({b}))"


def _core(ws_: str) -> str:
    return f"list_filter(list_distinct({ws_}), lambda w: w NOT IN ('type', 'class', 'classification', 'category'))"


def _numbers(ws_: str) -> str:
    return f"list_distinct(list_filter({ws_}, lambda w: regexp_matches(w, '\\p{{Nd}}')))"


def _late(a: str, b: str, canonical: str) -> str:
    aw, bw = _words(a), _words(b)
    return f"""({canonical} OR (len({_core(aw)}) > 0 AND {_same(_core(aw), _core(bw))}) OR (len({_numbers(aw)}) > 0 AND {_same(_numbers(aw), _numbers(bw))})
 OR (length({_acronym('answer')}) >= 2 AND upper(replace({a}, ' ', '')) = {_acronym('answer')}) OR (length({_acronym('alias')}) >= 2 AND upper(replace({b}, ' ', '')) = {_acronym('alias')}))"""


def _v1(alias: str = "alias", answer: str = "answer") -> str:
    a, b = mkey(alias), mkey(answer)
    return f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a}) OR {_late(a, b, _canonical(alias) + ' = ' + _canonical(answer))}))"


def _v2(alias: str = "alias", answer: str = "answer") -> str:
    ua, ub, a, b = ukey(alias), ukey(answer), akey(alias), akey(answer)
    early = f"({ua} <> '' AND {ub} <> '' AND (contains({ua}, {ub}) OR contains({ub}, {ua}) OR {_same(_words(ua), _words(ub))}))"
    return f"({early} OR ({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a}) OR {_late(a, b, _same(_words(a), _words(b)))})))"


_PAIRS = """WITH p AS (SELECT DISTINCT card_id, alias, answer FROM (SELECT card_id, unnest(aliases) AS alias, topic_name AS answer FROM knowledge_card
 UNION ALL SELECT card_id, answer, topic_name FROM knowledge_card UNION ALL SELECT card_id, topic_name, answer FROM knowledge_card))"""
_COMPACT = f"replace({mkey('t')}, ' ', '')"

ORACLE = {
    "normalize_ws": f"SELECT DISTINCT card_id, {ws('fact_statement')} AS fact, {ws('semantic_slot')} AS slot FROM knowledge_card",
    "slugify": f"SELECT DISTINCT card_id, {slug('relation_type')} AS plain, coalesce(nullif({slug('relation_type')}, ''), 'card') AS card, coalesce(nullif({slug('semantic_slot')}, ''), 'item') AS item FROM knowledge_card",
    "match_keys": f"SELECT DISTINCT card_id, {mkey('fact_statement')} AS match, {akey('fact_statement')} AS ascii_han, {ukey('fact_statement')} AS unicode FROM knowledge_card",
    "word_counts": f"SELECT DISTINCT card_id, len(regexp_extract_all(coalesce(fact_statement, ''), '[\\p{{L}}\\p{{N}}_]+(?:[''’\\-][\\p{{L}}\\p{{N}}_]+)*')) AS n_words, len({_words(ws('fact_statement'))}) AS n_pieces FROM knowledge_card",
    "canonical_words": f"WITH c AS (SELECT card_id, concat_ws(' ', fact_statement, 'on the 3rd of Sept') AS t FROM knowledge_card) SELECT DISTINCT card_id, array_to_string({_canonical('t')}, ' ') AS words FROM c",
    "acronyms": f"SELECT DISTINCT card_id, {_acronym('topic_name')} AS acronym FROM knowledge_card",
    "phrase_in_text": f"SELECT DISTINCT card_id, {mkey('answer')} <> '' AND {mkey('fact_statement')} <> '' AND contains(' ' || {mkey('fact_statement')} || ' ', ' ' || {mkey('answer')} || ' ') AS found FROM knowledge_card",
    "span_supported": f"SELECT DISTINCT card_id, {ws('fact_statement')} <> '' AND contains({ws('source_span')}, {ws('fact_statement')}) AS span_in_page, {ws('answer')} <> '' AND contains(lower({ws('source_span')}), lower({ws('answer')})) AS answer_in_span FROM knowledge_card",
    "answer_leakage": f"""WITH q AS ({QA_SQL}), t AS (SELECT qa_id, question, unnest(list_distinct(list_concat([coalesce(expected_answer, '')], coalesce(answer_aliases, [])))) AS t FROM q)
SELECT DISTINCT qa_id, t AS term FROM t WHERE t IS NOT NULL AND {_COMPACT} <> '' AND (length({_COMPACT}) >= 3 OR regexp_matches({_COMPACT}, '\\p{{Nd}}'))
 AND {mkey('question')} <> '' AND contains(' ' || {mkey('question')} || ' ', ' ' || {mkey('t')} || ' ')""",
    "alias_equivalence_v1": f"{_PAIRS} SELECT card_id, alias, answer, {_v1()} AS equivalent FROM p",
    "alias_equivalence_v2": f"{_PAIRS} SELECT card_id, alias, answer, {_v2()} AS equivalent FROM p",
    "safe_aliases": f"WITH p AS (SELECT DISTINCT card_id, {ws('a')} AS alias, topic_name AS answer FROM (SELECT card_id, topic_name, unnest(aliases) AS a FROM knowledge_card)) SELECT DISTINCT card_id, alias FROM p WHERE alias <> '' AND alias <> answer AND {_v1()}",
    "swap_language": f"SELECT DISTINCT qa_id, regexp_replace(qa_id, '^(.*?)__en__', '\\1__sw__') AS swapped FROM ({QA_SQL})",
    "cut_generation": "SELECT DISTINCT card_id, trim(string_split(string_split(string_split(coalesce(fact_statement, ''), '</s>')[1], ' of ')[1], ' in ')[1]) AS cut FROM knowledge_card",
    "topic_sides": f"""WITH t AS (SELECT DISTINCT pair_id, {ws("concat_ws(' vs ', topic_name, relation_type, answer_type)")} AS t FROM knowledge_card)
SELECT DISTINCT pair_id, string_split(t, ' vs ')[1] AS first, CASE WHEN contains(t, ' vs ') THEN t[length(string_split(t, ' vs ')[1]) + 5:] END AS second FROM t""",
}
