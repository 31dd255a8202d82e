"""Queries for result filters, date groups, scans and history, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions.bpe import letters_tokenizer
from sextant.operators import assist, knn, ranking, timeline
from sextant.plans.search import _BATCH_SQL, batch_queries
from sextant.session import table

#: Floors that the test vectors' scores reach, so that every branch of the filters has rows.
FLOOR, SPREAD = 0.15, 0.03
NOW = "2024-01-30 12:00:00"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "embeddings")
    return knn.knn_batch(corpus, batch_queries(corpus), 100).drop("rank")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


def combo_filter_text(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "embeddings")
    others = knn.knn_batch(corpus, batch_queries(corpus), 100, exclude_self=True).drop("rank")
    return _rounded(ranking.text_filter(others, FLOOR, 0.8, SPREAD))


def combo_filter_image(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ranking.image_filter(_scores(spark, sf), FLOOR, 0.95, 0.8, SPREAD))


def force_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ranking.force_top(_scores(spark, sf), 10))


def expand_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten of every query, by date and relevance; vectors take the dates of the events of their ids."""
    dated = _scores(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("vec_id"), "ts"), "vec_id", "left")
    found = ranking.expand_pool(dated, 10, F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"), "medium", "ts")
    return _rounded(found).select("query_id", "vec_id", "similarity", "rank")


def confidence_class(spark: SparkSession, sf: str) -> DataFrame:
    best = _scores(spark, sf).filter("query_id <> vec_id").groupBy("query_id").agg(F.max("similarity").alias("best"))
    return best.select("query_id", F.round("best", 6).alias("best"), ranking.confidence(F.col("best"), 0.35, 0.4).alias("confidence"), ranking.confidence(F.col("best") / 4).alias("default_confidence"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Events as dated items: some lack the first date, some both."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("created_at"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("modified_at"),
        F.concat(F.lit("/albums/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".JPG").otherwise(".txt")).alias("path"), F.col("event_type").alias("album"), "value", "user_id",
    )


_ITEMS_SQL = "(SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN ts END AS created_at, CASE WHEN event_id % 5 <> 0 THEN ts END AS modified_at, '/albums/' || event_type || '/' || event_id || CASE WHEN event_id % 3 = 0 THEN '.JPG' ELSE '.txt' END AS path, event_type AS album, value, user_id FROM events)"


def filter_date_relevance(spark: SparkSession, sf: str) -> DataFrame:
    rows = _items(spark, sf).select(F.col("user_id").alias("query_id"), "id", "created_at", F.when(F.col("id") % 11 != 0, F.col("value")).alias("similarity"))
    found = ranking.date_and_relevance(rows, F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"), "medium")
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def query_guard(spark: SparkSession, sf: str) -> DataFrame:
    share = T.unknown_share(F.trim("text"), _letters())
    return table(spark, sf, "conversations").select("conv_id", "turn", ranking.guard(F.col("text"), share).alias("decision"), F.round(share, 6).alias("unknown_share"))


def _letters() -> list[str]:
    return [t for t in letters_tokenizer().vocabulary if len(t) == 1]


def date_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.date_buckets(_items(spark, sf), F.lit(NOW).cast("timestamp_ntz")).groupBy("group_order", "group_label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def scan_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """The scan itself: the whole table in newest-first order, with each row's place."""
    return timeline.positions(_items(spark, sf), "created_at", "id").select("id", "created_at", "position")


def progressive_batches(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.progressive_batches(_items(spark, sf)).groupBy("batch").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.sum("id").alias("ids"))


def album_filter(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.in_album(_items(spark, sf), "Click").select("id", "album")


def resolve_items(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.resolve(_items(spark, sf)).select("id", timeline.file_name(F.col("path")).alias("name"))


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter(F.col("event_id") == 42).select("event_id", "user_id", "event_type")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as a query log."""
    return table(spark, sf, "conversations").filter("role = 'user'").select(F.col("text").alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))


def mru_history(spark: SparkSession, sf: str) -> DataFrame:
    return assist.history(_log(spark, sf))


def history_filter(spark: SparkSession, sf: str) -> DataFrame:
    return assist.history_matching(assist.latest_per_query(_log(spark, sf)), "Th")


def history_forget(spark: SparkSession, sf: str) -> DataFrame:
    """The history without its latest query, which occurs in every log."""
    past = assist.history(_log(spark, sf))
    return assist.forget(past, past.first()["query"])


def random_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: five texts of the benchmark, the same for a seed."""
    return assist.random_suggestions(table(spark, sf, "benchmark").select("item_id"), 5, seed=3)


QUERIES = {
    "combo_filter_text": combo_filter_text, "combo_filter_image": combo_filter_image, "force_top_n": force_top_n, "expand_pool": expand_pool, "confidence_class": confidence_class, "filter_date_relevance": filter_date_relevance, "query_guard": query_guard,
    "date_buckets": date_buckets, "scan_newest_first": scan_newest_first, "progressive_batches": progressive_batches, "album_filter": album_filter, "resolve_items": resolve_items, "point_lookup": point_lookup,
    "mru_history": mru_history, "history_filter": history_filter, "history_forget": history_forget, "random_suggestions": random_suggestions,
}

_TOP = f"(SELECT * EXCLUDE rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM ({_BATCH_SQL})) WHERE rank <= 100)"
_TOP_OTHERS = f"(SELECT * EXCLUDE rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM ({_BATCH_SQL}) WHERE query_id <> vec_id) WHERE rank <= 100)"
_LOG_SQL = '''(SELECT text AS query, conv_id * 1000 + turn AS "at" FROM conversations WHERE role = 'user')'''
_SHARE_SQL = "CASE WHEN trim(text, ' ') = '' THEN 0 ELSE len(regexp_extract_all(trim(text, ' '), '[^a-z ▁]')) / length(trim(text, ' '))::DOUBLE END"

ORACLES = {
    "combo_filter_text": f"""WITH kept AS (SELECT * FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM {_TOP_OTHERS} WHERE similarity >= {FLOOR}) WHERE similarity >= 0.8 * best),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM kept), fifth AS (SELECT query_id FROM placed WHERE place = 5 AND best - similarity < {SPREAD})
        SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM kept WHERE query_id NOT IN (SELECT query_id FROM fifth)""",
    "combo_filter_image": f"""WITH flagged AS (SELECT *, similarity > 0.95 AS is_self FROM {_TOP} WHERE similarity >= {FLOOR}), best AS (SELECT query_id, max(similarity) AS best FROM flagged WHERE NOT is_self GROUP BY 1),
        near AS (SELECT f.*, best FROM flagged f JOIN best USING (query_id) WHERE NOT is_self AND similarity >= 0.8 * best), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM near),
        flat AS (SELECT query_id FROM placed WHERE place = 5 AND best - similarity < {SPREAD})
        SELECT query_id, vec_id, round(similarity, 6) AS similarity, is_self FROM flagged WHERE is_self UNION ALL SELECT query_id, vec_id, round(similarity, 6), is_self FROM near WHERE query_id NOT IN (SELECT query_id FROM flat)""",
    "force_top_n": f"SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM ({_BATCH_SQL})) WHERE rank <= 10",
    "expand_pool": f"""WITH pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM {_TOP}), best AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM pool WHERE rank <= 10)
        SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM best LEFT JOIN (SELECT event_id AS vec_id, ts FROM events) USING (vec_id)
        WHERE (ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 23:59:59') AND similarity >= 0.45 * best""",
    "confidence_class": f"""SELECT query_id, round(best, 6) AS best, CASE WHEN best < 0.35 THEN 'failed' WHEN best < 0.4 THEN 'weak' ELSE 'strong' END AS confidence, CASE WHEN best / 4 < 0.08 THEN 'failed' WHEN best / 4 < 0.095 THEN 'weak' ELSE 'strong' END AS default_confidence
        FROM (SELECT query_id, max(similarity) AS best FROM ({_BATCH_SQL}) WHERE query_id <> vec_id GROUP BY query_id)""",
    "filter_date_relevance": f"""SELECT query_id, id, round(similarity, 6) AS similarity FROM (SELECT *, max(coalesce(similarity, 0)) OVER (PARTITION BY query_id) AS best FROM (SELECT user_id AS query_id, id, created_at, CASE WHEN id % 11 <> 0 THEN value END AS similarity FROM {_ITEMS_SQL}))
        WHERE (created_at IS NULL OR created_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 23:59:59') AND coalesce(similarity, 0) >= 0.45 * best""",
    "query_guard": f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'idle' WHEN length(trim(text, ' ')) < 2 OR share > 0.7 THEN 'rejected' ELSE 'search' END AS decision, round(share, 6) AS unknown_share FROM (SELECT *, {_SHARE_SQL} AS share FROM conversations)""",
    "date_buckets": f"""WITH dated AS (SELECT id, coalesce(created_at, modified_at) AS dated_at FROM {_ITEMS_SQL}),
        grouped AS (SELECT id, CASE WHEN dated_at IS NULL THEN 'Earlier' WHEN dated_at >= TIMESTAMP '2024-01-30' THEN 'Today' WHEN dated_at >= TIMESTAMP '2024-01-24' THEN 'This week' WHEN dated_at >= TIMESTAMP '2024-01-01' THEN 'This month' ELSE strftime(dated_at, '%B %Y') END AS group_label,
            CASE WHEN dated_at IS NULL THEN 1073741824 WHEN dated_at >= TIMESTAMP '2024-01-30' THEN 0 WHEN dated_at >= TIMESTAMP '2024-01-24' THEN 1 WHEN dated_at >= TIMESTAMP '2024-01-01' THEN 2 ELSE 3 + 120000 - (year(dated_at) * 12 + month(dated_at)) END::INT AS group_order FROM dated)
        SELECT group_order, group_label, count(*) AS n, min(id) AS first_id FROM grouped GROUP BY ALL""",
    "scan_newest_first": f"SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS position FROM {_ITEMS_SQL}",
    "progressive_batches": f"""WITH placed AS (SELECT id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS position FROM {_ITEMS_SQL}),
        batched AS (SELECT *, CASE WHEN position <= 50 THEN 1 WHEN position <= 100 THEN 2 WHEN position <= 200 THEN 3 ELSE 3 + ceil((position - 200) / 200.0) END::INT AS batch FROM placed)
        SELECT batch, count(*) AS n, min(position) AS first, sum(id)::BIGINT AS ids FROM batched GROUP BY batch""",
    "album_filter": f"""WITH levelled AS (SELECT id, album, CASE WHEN lower(album) = 'click' THEN 1 WHEN contains(lower(album), 'click') THEN 2 WHEN contains(lower(path), 'click') THEN 3 END AS level FROM {_ITEMS_SQL})
        SELECT id, album FROM levelled WHERE level = (SELECT min(level) FROM levelled)""",
    "resolve_items": f"SELECT id, regexp_extract(path, '[^/]*$') AS name FROM {_ITEMS_SQL} WHERE path ILIKE '%.jpg'",
    "point_lookup": "SELECT event_id, user_id, event_type FROM events WHERE event_id = 42",
    "mru_history": f'''SELECT trim(query, ' ') AS query, max("at") AS "at" FROM {_LOG_SQL} WHERE trim(query, ' ') <> '' GROUP BY 1 ORDER BY "at" DESC, query LIMIT 20''',
    "history_filter": f'''SELECT query, max("at") AS "at" FROM {_LOG_SQL} WHERE contains(lower(query), 'th') GROUP BY query''',
    "history_forget": f'''WITH past AS (SELECT trim(query, ' ') AS query, max("at") AS "at" FROM {_LOG_SQL} WHERE trim(query, ' ') <> '' GROUP BY 1 ORDER BY "at" DESC, query LIMIT 20)
        SELECT * FROM past WHERE query <> (SELECT query FROM past ORDER BY "at" DESC, query LIMIT 1)''',
}
