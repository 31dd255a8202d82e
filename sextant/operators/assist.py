"""Query suggestions and query history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as T

# Numbers of suggestions and of remembered queries.
MOST_SUGGESTIONS = 4
HISTORY_LENGTH = 20
CONTENT_LONGER_THAN = 2


def content_words(words: Column, stop_words: frozenset[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*sorted(stop_words)))


def suggestions(query: Column, dictionary: dict[str, str], stop_words: frozenset[str]) -> Column:
    """Up to four other wordings of a query, in this order, each once.

    For each token with a translation: the query with that token translated wherever it occurs, then the
    translation alone; the content words, if that is shorter; the single content words of more than two
    letters, if the query has several tokens; the translation of the whole query. Never the query itself.
    """
    clean = F.lower(F.trim(query))

    def build(words: Column) -> Column:
        known = F.filter(words, lambda w: w.isin(*dictionary))
        translated = F.flatten(F.transform(known, lambda w: F.array(F.array_join(F.transform(words, lambda x: F.when(x == w, T.lookup(w, dictionary)).otherwise(x)), " "), T.lookup(w, dictionary))))
        content = content_words(words, stop_words)
        shorter = F.when((F.size(content) < F.size(words)) & (F.size(content) > 0), F.array(F.array_join(content, " "))).otherwise(F.array().cast("array<string>"))
        single = F.when(F.size(words) > 1, F.filter(content, lambda w: F.char_length(w) > CONTENT_LONGER_THAN)).otherwise(F.array().cast("array<string>"))
        whole = F.when(clean.isin(*dictionary), F.array(T.lookup(clean, dictionary))).otherwise(F.array().cast("array<string>"))
        everything = F.array_distinct(F.concat(translated, shorter, single, whole))
        return F.slice(F.filter(everything, lambda s: (s != clean) & (F.trim(s) != "")), 1, MOST_SUGGESTIONS)

    return T.let(T.tokens(clean), build)


def history(log: DataFrame, order_col: str = "at", query_col: str = "query", length: int = HISTORY_LENGTH) -> DataFrame:
    """Most recent distinct queries: trimmed, blank ones dropped, the latest use counts."""
    trimmed = log.select(F.trim(query_col).alias("query"), F.col(order_col).alias("at")).filter(F.char_length("query") > 0)
    return trimmed.groupBy("query").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "query").limit(length)


def remember(queries: DataFrame, path: str) -> None:
    """Appends queries (query, at) to a stored log; ``history`` reads it back."""
    queries.select("query", "at").write.mode("append").parquet(path)


def history_matching(past: DataFrame, part: str) -> DataFrame:
    """Remembered queries that contain a text, in any case."""
    return past.filter(F.contains(F.lower("query"), F.lit(part.lower())))


def forget(past: DataFrame, query: str) -> DataFrame:
    return past.filter(F.col("query") != query)


def random_suggestions(options: DataFrame, count: int, seed: int) -> DataFrame:
    """A repeatable draw from a list of suggestions."""
    return options.orderBy(F.xxhash64(*options.columns, F.lit(seed))).limit(count)


def latest_per_query(log: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("at")))
    return log.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")
