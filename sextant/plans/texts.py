"""Queries for normalisation, tokens and suggestions, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import bpe, encoder, lexicon
from sextant.functions import text as T
from sextant.functions import vectors as V
from sextant.operators import assist
from sextant.plans.search import total
from sextant.session import spread, table

LEXICON = lexicon.DEFAULT


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    """All turns, with informal words set around each text so that every rule has cases."""
    informal = F.concat(F.lit("Aq nagshopping kc d2!! sooooo gud w/o u "), F.col("text"), F.lit(" isa isa san san lakad-lakad d q nagpainting running naka-upload w/friends"))
    return spread(table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", informal.alias("text"))


def _stage(number: int):
    """Result of one stage over the results of those before it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        column = F.col("text")
        for step in T.stages(LEXICON)[: number + 1]:
            column = T.let(column, step)
        return _chats(spark, sf).select("conv_id", "turn", column.alias("text"))

    return run


def normalize_full(spark: SparkSession, sf: str) -> DataFrame:
    return _chats(spark, sf).select("conv_id", "turn", T.normalise(F.col("text"), LEXICON).alias("text"))


def rule_firing_rates(spark: SparkSession, sf: str) -> DataFrame:
    traced = T.trace(_chats(spark, sf), "text", LEXICON)
    return traced.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("fired").cast("long")).alias("fired"), F.round(F.avg(F.col("fired").cast("double")), 6).alias("rate"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for token in b:
        matched = open_ & places.get(token, 0)
        open_ = ((open_ + matched) | (open_ - matched)) & full
    return len(a) - open_.bit_count()


def affected(before: Column, after: Column) -> Column:
    """Tokens that a step touched: the longer length less the common subsequence."""

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            pairs = [(x.split(), y.split()) for x, y in zip(left, right, strict=True)]
            yield pd.Series([0 if x == y else max(len(x), len(y)) - lcs_length(x, y) for x, y in pairs], dtype="int32")

    return run(before, after)


def normalize_trace(spark: SparkSession, sf: str) -> DataFrame:
    traced = T.trace(_chats(spark, sf), "text", LEXICON)
    return traced.select("conv_id", "turn", "step", "rule", "fired", affected(F.col("before"), F.col("after")).alias("affected"))


def token_utils(spark: SparkSession, sf: str) -> DataFrame:
    words = T.tokens(T.space_punctuation(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(T.without_punctuation(F.col("w"))).alias("n_without_punctuation"), F.size(T.plain_words(F.col("w"))).alias("n_plain_words"))


def gibberish_ratio(spark: SparkSession, sf: str) -> DataFrame:
    letters = [t for t in bpe.letters_tokenizer().vocabulary if len(t) == 1]
    return table(spark, sf, "documents").select("doc_id", F.round(T.unknown_share(F.col("text"), letters), 6).alias("ratio"))


def prompt_format(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.prompt(F.col("p_name")).alias("prompt"), T.prompt(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("long_prompt"))


def bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", bpe.encode(F.lower("text"), bpe.letters_tokenizer(byte_fallback=True)).alias("ids")).withColumn("n_used", F.aggregate(bpe.attention_mask(F.col("ids")), F.lit(0), lambda s, x: s + x))


def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = bpe.letters_tokenizer()
    rows = table(spark, sf, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^a-z ]", "").alias("text"))
    return rows.select("item_id", (bpe.decode(bpe.encode_raw(F.col("text"), tokenizer), tokenizer) == F.trim("text")).alias("same"))


def hash_encode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", encoder.hash_projection(F.col("text")).alias("v")).select("item_id", F.round(V.norm(F.col("v")), 6).alias("norm"), total(F.col("v")).alias("digest"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of two or three dictionary and stop words, by arithmetic on the part key."""
    keys, stops = sorted(lexicon.TRANSLATIONS), sorted(lexicon.STOP_WORDS)
    pick = lambda options, n: F.get(F.array(*map(F.lit, options)), F.pmod(n, F.lit(len(options))).cast("int"))
    key = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", pick(keys, key), pick(stops, key * 7), F.when(key % 3 == 0, pick(keys, key * 5))).alias("query"))


def suggest(spark: SparkSession, sf: str) -> DataFrame:
    return _queries(spark, sf).select("p_partkey", F.array_join(assist.suggestions(F.col("query"), lexicon.TRANSLATIONS, lexicon.STOP_WORDS), "|").alias("suggestions"))


def bilingual_join(spark: SparkSession, sf: str) -> DataFrame:
    words = _queries(spark, sf).select("p_partkey", F.posexplode(T.tokens(F.col("query"))).alias("pos", "word"))
    return words.select("p_partkey", "pos", "word", T.lookup(F.col("word"), lexicon.TRANSLATIONS).alias("translation")).filter("word <> translation")


def stopword_anti(spark: SparkSession, sf: str) -> DataFrame:
    return _queries(spark, sf).select("p_partkey", F.array_join(assist.content_words(T.tokens(F.col("query")), lexicon.STOP_WORDS), " ").alias("content"))


QUERIES = {
    "normalize_casefold": _stage(0), "normalize_dict": _stage(1), "normalize_hyphen": _stage(2), "normalize_collapse": _stage(3), "normalize_punct": _stage(4), "normalize_affix": _stage(5), "normalize_dedup": _stage(6), "normalize_full": normalize_full,
    "rule_firing_rates": rule_firing_rates, "normalize_trace": normalize_trace, "token_utils": token_utils, "gibberish_ratio": gibberish_ratio, "prompt_format": prompt_format,
    "bpe_encode": bpe_encode, "bpe_round_trip": bpe_round_trip, "hash_encode": hash_encode, "suggest": suggest, "bilingual_join": bilingual_join, "stopword_anti": stopword_anti,
}


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _map(pairs) -> str:
    return "map([" + ", ".join(_quoted(k) for k, _ in pairs) + "], [" + ", ".join(_quoted(v) for _, v in pairs) + "])"


def _substituted(text: str) -> str:
    """Every rule by itself, in order: RE2's word border is an ASCII border."""
    for key, value in LEXICON.rules:
        text = f"regexp_replace({text}, {_quoted(r'\b' + key.replace('/', '[/]') + r'\b')}, {_quoted(value)}, 'g')"
    context = _map(LEXICON.context)
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda t: coalesce({context}[t], t)), ' ')"


_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_CHATS_SQL = "SELECT conv_id, turn, 'Aq nagshopping kc d2!! sooooo gud w/o u ' || text || ' isa isa san san lakad-lakad d q nagpainting running naka-upload w/friends' AS t0 FROM conversations"


def _squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACE}', ' ', 'g'), ' ')"


def _ing(token: str) -> str:
    verbs = _list(sorted(LEXICON.verbs))
    stem = f"{token}[:-4]"
    undone = f"{token}[:-5]"
    return f"""CASE WHEN ends_with({token}, 'ing') AND length({token}) > 4 THEN CASE WHEN list_contains({verbs}, {stem}) THEN {stem}
        WHEN length({stem}) >= 2 AND {stem}[-1] = {undone}[-1] AND list_contains({verbs}, {undone}) THEN {undone} WHEN list_contains({verbs}, {stem} || 'e') THEN {stem} || 'e' END END"""


def _affixed(token: str) -> str:
    tried = []
    for prefix in LEXICON.prefixes:
        stem = f"({token}[{len(prefix) + 1}:])"
        tried.append(f"CASE WHEN starts_with({token}, '{prefix}') AND length({token}) > {len(prefix)} THEN CASE WHEN list_contains({_list(sorted(LEXICON.verbs))}, {stem}) THEN {stem} ELSE {_ing(stem)} END END")
    return f"coalesce({', '.join(tried)}, {_ing(f'({token})')}, {token})"


_STAGES_SQL = f"""
    s0 AS ({_CHATS_SQL}),
    s1 AS (SELECT *, lower(t0) AS t1 FROM s0),
    s2 AS (SELECT *, {_substituted("t1")} AS t2 FROM s1),
    s3 AS (SELECT *, replace(replace(t2, '''', ''), '-', ' ') AS t3 FROM s2),
    c3 AS (SELECT *, string_split(t3, '') AS c FROM s3),
    s4 AS (SELECT * EXCLUDE c, array_to_string(list_transform(list_filter(list_zip(c, list_concat([NULL], c), list_concat([NULL, NULL], c)), lambda z: z[1] IS NOT NULL AND NOT coalesce(z[1] <> chr(10) AND z[1] <> chr(13) AND z[2] = z[1] AND z[3] = z[1], false)), lambda z: z[1]), '') AS t4 FROM c3),
    s5 AS (SELECT *, {_squeezed("regexp_replace(t4, '([!-/:-@\\[-`{-~])', ' \\1 ', 'g')")} AS t5 FROM s4),
    s6 AS (SELECT *, array_to_string(list_transform(list_filter(string_split(t5, ' '), lambda t: t <> ''), lambda t: {_affixed("t")}), ' ') AS t6 FROM s5),
    s7 AS (SELECT *, array_to_string(list_filter(string_split(t6, ' '), lambda t, i: i = 1 OR t <> string_split(t6, ' ')[i - 1] OR list_contains({_list(sorted(LEXICON.repeats))}, string_split(t6, ' ')[i - 1] || ' ' || t)), ' ') AS t7 FROM s6)"""

_QUERIES_SQL = f"SELECT p_partkey, concat_ws(' ', {_list(sorted(lexicon.TRANSLATIONS))}[p_partkey % {len(lexicon.TRANSLATIONS)} + 1], {_list(sorted(lexicon.STOP_WORDS))}[p_partkey * 7 % {len(lexicon.STOP_WORDS)} + 1], CASE WHEN p_partkey % 3 = 0 THEN {_list(sorted(lexicon.TRANSLATIONS))}[p_partkey * 5 % {len(lexicon.TRANSLATIONS)} + 1] END) AS query FROM part"
_TRANSLATED = _map(sorted(lexicon.TRANSLATIONS.items()))
_STOPS = _list(sorted(lexicon.STOP_WORDS))
_TOKENS_SQL = f"list_filter(string_split({_squeezed("regexp_replace(text, '([!-/:-@\\[-`{-~])', ' \\1 ', 'g')")}, ' '), lambda t: t <> '')"

ORACLES = {name: f"WITH {_STAGES_SQL} SELECT conv_id, turn, t{i + 1} AS text FROM s{i + 1}" for i, name in enumerate(list(QUERIES)[:7])}
ORACLES["bpe_round_trip"] = "SELECT item_id, true AS same FROM benchmark"
ORACLES["normalize_full"] = f"WITH {_STAGES_SQL} SELECT conv_id, turn, t7 AS text FROM s7"
ORACLES["rule_firing_rates"] = f"WITH {_STAGES_SQL}, fired AS (" + " UNION ALL ".join(f"SELECT '{name}' AS rule, t{i} <> t{i + 1} AS fired FROM s7" for i, name in enumerate(T.STAGES)) + ") SELECT rule, count(*) AS n, count(*) FILTER (fired) AS fired, round(avg(fired::INT), 6) AS rate FROM fired GROUP BY rule"
ORACLES["token_utils"] = f"WITH tokens AS (SELECT doc_id, {_TOKENS_SQL} AS w FROM documents) SELECT doc_id, len(w)::INT AS n_tokens, len(list_filter(w, lambda t: NOT regexp_full_match(t, '[!-/:-@\\[-`{{-~]+')))::INT AS n_without_punctuation, len(list_filter(w, lambda t: regexp_full_match(t, '[a-zA-Z]+')))::INT AS n_plain_words FROM tokens"
ORACLES["gibberish_ratio"] = "SELECT doc_id, round(CASE WHEN trim(text, ' ') = '' THEN 0 ELSE len(regexp_extract_all(text, '[^a-z ▁]')) / length(text)::DOUBLE END, 6) AS ratio FROM documents"
ORACLES["prompt_format"] = "SELECT p_partkey, CASE WHEN contains(p_name, ' ') AND length(p_name) > 20 THEN p_name ELSE 'a photo of ' || p_name END AS prompt, CASE WHEN length(long) > 20 THEN long ELSE 'a photo of ' || long END AS long_prompt FROM (SELECT *, concat_ws(' ', p_name, p_type, p_brand) AS long FROM part)"
ORACLES["bilingual_join"] = f"SELECT p_partkey, pos::INT AS pos, word, translation FROM (SELECT p_partkey, pos, word, {_TRANSLATED}[word] AS translation FROM (SELECT p_partkey, unnest(string_split(query, ' ')) AS word, unnest(range(len(string_split(query, ' ')))) AS pos FROM ({_QUERIES_SQL}))) WHERE translation IS NOT NULL"
ORACLES["stopword_anti"] = f"SELECT p_partkey, array_to_string(list_filter(string_split(query, ' '), lambda t: NOT list_contains({_STOPS}, t)), ' ') AS content FROM ({_QUERIES_SQL})"
ORACLES["suggest"] = f"""WITH q AS (SELECT p_partkey, query, string_split(query, ' ') AS w, list_filter(string_split(query, ' '), lambda t: NOT list_contains({_STOPS}, t)) AS content FROM ({_QUERIES_SQL})),
    options AS (SELECT p_partkey, query, list_concat(
        flatten(list_transform(list_filter(w, lambda t: {_TRANSLATED}[t] IS NOT NULL), lambda t: [array_to_string(list_transform(w, lambda x: CASE WHEN x = t THEN {_TRANSLATED}[t] ELSE x END), ' '), {_TRANSLATED}[t]])),
        CASE WHEN len(content) < len(w) AND len(content) > 0 THEN [array_to_string(content, ' ')] ELSE [] END,
        CASE WHEN len(w) > 1 THEN list_filter(content, lambda t: length(t) > 2) ELSE [] END,
        CASE WHEN {_TRANSLATED}[query] IS NOT NULL THEN [{_TRANSLATED}[query]] ELSE [] END) AS o FROM q),
    kept AS (SELECT p_partkey, list_filter(o, lambda s, i: s <> query AND list_position(o, s) = i) AS o FROM options)
    SELECT p_partkey, array_to_string(o[1:4], '|') AS suggestions FROM kept"""
