"""Whole query flows: text search, search by example, people, index tuning, streamed ingest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import bpe, encoder, lexicon
from sextant.functions import text as T
from sextant.operators import assist, clustering, detection, index, ivfpq, knn, ranking
from sextant.plans.faces import _boxes, _faces
from sextant.plans.results import FLOOR, SPREAD
from sextant.plans.results import ORACLES as RESULT_SQL
from sextant.plans.search import CONFIG, STEP, _fixed, batch_queries
from sextant.plans.search import ORACLES as SEARCH_SQL
from sextant.session import scratch_path, spread, table
from sextant.sources import files
from sextant.streaming import ingest

DIMENSION = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def search_texts(corpus: DataFrame, queries: DataFrame, k: int = ranking.DEFAULT_K, encode=encoder.hash_projection, lexicon_=lexicon.DEFAULT) -> DataFrame:
    """Text search from raw queries to a result row for each query.

    corpus (vec_id, embedding), queries (query_id, text) -> (query_id, decision, normalised, n_results,
    best, confidence, suggestions). Steps: guard, normalise, encode, retrieve, cut and filter scores,
    class of confidence, suggestions unless the result is strong.
    """
    letters = [t for t in bpe.letters_tokenizer().vocabulary if len(t) == 1]
    guarded = queries.select("query_id", "text", ranking.guard(F.col("text"), T.unknown_share(F.lower(F.trim("text")), letters)).alias("decision"))
    normal = guarded.withColumn("normalised", T.normalise(F.trim("text"), lexicon_))
    asked = normal.filter("decision = 'search'").select("query_id", encode(F.col("normalised")).alias("query"))
    found = ranking.text_filter(index.search(corpus, asked, k).drop("rank"))
    best = found.groupBy("query_id").agg(F.count("*").alias("n_results"), F.max("similarity").alias("best"))
    joined = normal.join(best, "query_id", "left")
    confidence = ranking.confidence(F.col("best"))
    offered = assist.suggestions(F.col("normalised"), lexicon.TRANSLATIONS, lexicon.STOP_WORDS)
    none = F.array().cast("array<string>")
    return joined.select("query_id", "decision", "normalised", F.coalesce("n_results", F.lit(0)).alias("n_results"), "best", confidence.alias("confidence"), F.when(confidence != "strong", offered).otherwise(none).alias("suggestions"))


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text as a caption and, whole, as a query."""
    captions = table(spark, sf, "benchmark")
    corpus = captions.select(F.col("item_id").alias("vec_id"), encoder.hash_projection(T.normalise(F.col("text"), lexicon.DEFAULT), DIMENSION).alias("embedding"))
    return search_texts(corpus, captions.select(F.col("item_id").alias("query_id"), "text"), 20)


def search_by_example(spark: SparkSession, sf: str) -> DataFrame:
    """Search by stored vectors, filtered as picture results."""
    corpus = table(spark, sf, "embeddings")
    found = knn.knn_batch(corpus, batch_queries(corpus), ranking.DEFAULT_K).drop("rank")
    return ranking.image_filter(found, FLOOR, 0.95, 0.8, SPREAD).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "is_self")


def people_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Suppressed boxes per picture beside the people found among the faces."""
    faces = _faces(spark, sf).drop("cluster_id")
    clustered = faces.join(clustering.dbscan(faces, 0.66), "face_id")
    people = clustering.entities(clustered)
    kept = detection.suppress(_boxes(spark, sf)).groupBy("image_id").agg(F.count("*").alias("n_boxes"))
    shown = clustering.images_of(clustering.members(clustered))
    return people.join(shown.join(kept, "image_id", "left").groupBy("person_id").agg(F.count("*").alias("n_images"), F.sum("n_boxes").alias("n_boxes")), "person_id").select("person_id", "label", "face_count", "n_images", "n_boxes")


def tuning_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Mean recall at 10 of the compressed index by number of probes."""
    corpus = table(spark, sf, "embeddings")
    centroids, books = _fixed(corpus, CONFIG)
    own, queries = ivfpq.postings(corpus, centroids, books), batch_queries(corpus)
    exact = knn.batch_distances(corpus, queries, "l2", 10)
    parts = [ivfpq.recall(ivfpq.search(queries, own, centroids, books, p, 10), exact, 10).agg(F.lit(p).alias("probes"), F.round(F.avg("recall"), 6).alias("recall")) for p in (1, 2, 4, 8)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Stores an index, reads it back and searches it."""
    corpus = table(spark, sf, "embeddings")
    centroids, books = _fixed(corpus, CONFIG)
    path = scratch_path(spark, "index")
    index.IvfPqIndex(spark, CONFIG, centroids=centroids, codebooks=books, postings=ivfpq.postings(corpus, centroids, books)).save(path)
    found = index.load(spark, path).search(batch_queries(corpus), 5, effort=CONFIG.probes)
    return found.select("query_id", "rank", "vec_id")


def stream_append(spark: SparkSession, sf: str) -> DataFrame:
    """Streams the embeddings into a store and returns its state."""
    store, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "stream")
    schema = table(spark, sf, "embeddings").schema
    # As a pattern, the name may stand for one file as well as for a folder of files.
    ingest.start(spark, f"{sf}/embeddings.parque[t]", store, checkpoint, schema).awaitTermination()
    return ingest.current(spark, store).select("vec_id", "label")


def embedding_store(spark: SparkSession, sf: str) -> DataFrame:
    """Writes two encoders' embeddings, replaces one, reads the other."""
    path = scratch_path(spark, "embeddings")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    files.write_embeddings(rows.withColumn("encoder_id", F.lit("a")).unionByName(rows.filter("id < '3'").withColumn("encoder_id", F.lit("b"))), path)
    files.write_embeddings(rows.limit(1).withColumn("encoder_id", F.lit("a")), path)
    return files.read_embeddings(spark, path, "b").select("id", F.size("embedding").alias("dimension"))


def scan_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Parquet files of the data folder by path."""
    return files.scan_directory(spark, sf, ("parquet",)).orderBy("path").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes")


def picture_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as 8 x 8 grey pictures: range of the model input."""
    grey = F.flatten(F.transform("embedding", lambda x: F.array_repeat((x + 1) * 127.5, 3)))
    inputs = table(spark, sf, "embeddings").select("vec_id", encoder.picture_inputs(grey, 8, 8, 16).alias("x"))
    return inputs.select("vec_id", F.size("x").alias("n"), F.round(F.array_min("x").cast("double"), 4).alias("low"), F.round(F.array_max("x").cast("double"), 4).alias("high"))


def face_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Transform of each vector's first five points to a square's corners and centre."""
    target = np.array([[0.0, 0], [1, 0], [0, 1], [1, 1], [0.5, 0.5]])
    found = table(spark, sf, "embeddings").select("vec_id", encoder.alignment(F.slice("embedding", 1, 10).cast("array<double>"), target).alias("m"))
    return found.select("vec_id", F.size("m").alias("n"), F.round(F.sqrt(F.get("m", F.lit(0)) ** 2 + F.get("m", F.lit(3)) ** 2), 6).alias("scale"))


def token_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """How often each id of the letters' vocabulary stands in a whole text; 3 for what it lacks."""
    rows = spark.createDataFrame(list(bpe.letters_tokenizer().vocabulary.items()), "token string, id int")
    symbols = F.split(F.replace(F.translate("text", UPPER, UPPER.lower()), F.lit(" "), F.lit(bpe.SPACE_SIGN)), "")
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"))
    tokens = documents.filter(F.char_length("text") > 0).select("doc_id", F.explode(symbols).alias("token"))
    found = tokens.join(F.broadcast(rows), "token", "left").select("doc_id", F.coalesce("id", F.lit(bpe.UNKNOWN)).alias("id"))
    return found.groupBy("doc_id", "id").agg(F.count("*").alias("n"))


QUERIES = {
    "text_search": text_search, "search_by_example": search_by_example, "people_pipeline": people_pipeline, "tuning_sweep": tuning_sweep, "index_round_trip": index_round_trip,
    "stream_append": stream_append, "embedding_store": embedding_store, "scan_directory": scan_directory, "token_lookup": token_lookup, "picture_preprocess": picture_preprocess, "face_alignment": face_alignment,
}

_PARTS_SQL = SEARCH_SQL["ivfpq_search"].split("probes AS", 1)[0]
_SQUARES = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

ORACLES = {
    # Every vector's cell and codes as in the index's own SQL; the probed cells of a query are those of places up to p.
    "tuning_sweep": f"""{_PARTS_SQL} placed AS (SELECT vec_id AS query_id, cluster_id, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS r, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) AS place FROM celld WHERE vec_id % {STEP} = 0),
        scored AS (SELECT query_id, place, cells.vec_id, sum({_SQUARES.format(a="r[m * 8 + 1:m * 8 + 8]", b="enc.c")}) AS d FROM placed JOIN cells USING (cluster_id) JOIN enc ON enc.vec_id = cells.vec_id GROUP BY ALL),
        found AS (SELECT probes, query_id, vec_id FROM (SELECT probes, query_id, vec_id, row_number() OVER (PARTITION BY probes, query_id ORDER BY d, vec_id) AS rank FROM scored, (VALUES (1), (2), (4), (8)) AS p(probes) WHERE place <= probes) WHERE rank <= 10),
        exact AS (SELECT query_id, vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SQUARES.format(a="e.embedding::DOUBLE[]", b="q.embedding::DOUBLE[]")}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % {STEP} = 0) WHERE rank <= 10)
        SELECT probes, round(count(f.vec_id) / (10.0::DOUBLE * count(DISTINCT x.query_id)), 6) AS recall FROM (SELECT * FROM exact, (VALUES (1), (2), (4), (8)) AS p(probes)) x LEFT JOIN found f USING (probes, query_id, vec_id) GROUP BY probes""",
    "face_alignment": """WITH points AS (SELECT vec_id, i, embedding[2 * i - 1]::DOUBLE AS x, embedding[2 * i]::DOUBLE AS y, [0.0, 1, 0, 1, 0.5][i]::DOUBLE - 0.5 AS u, [0.0, 0, 1, 1, 0.5][i]::DOUBLE - 0.5 AS v FROM embeddings, range(1, 6) r(i)),
        centred AS (SELECT vec_id, u, v, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM points WINDOW w AS (PARTITION BY vec_id)),
        sums AS (SELECT vec_id, sum(x * x + y * y) AS s, sum(x * u + y * v) AS c, sum(x * v - y * u) AS d FROM centred GROUP BY vec_id)
        SELECT vec_id, 6 AS n, round(sqrt(c * c + d * d) / s, 6) AS scale FROM sums""",
    "stream_append": "SELECT vec_id, label FROM embeddings",
    "embedding_store": "SELECT vec_id::VARCHAR AS id, len(embedding)::INT AS dimension FROM embeddings WHERE vec_id::VARCHAR < '3'",
    "index_round_trip": f"SELECT query_id, rank, vec_id FROM ({SEARCH_SQL['ivfpq_search']}) WHERE rank <= 5",
    "token_lookup": f"""WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '(?s).')) AS t FROM documents)
        SELECT doc_id, CASE WHEN t BETWEEN 'a' AND 'z' AND ascii(t) < 128 THEN 261 + ascii(t) - 97 WHEN t IN (' ', '▁') THEN 260 ELSE 3 END::INT AS id, count(*) AS n FROM tokens GROUP BY ALL""",
    "search_by_example": RESULT_SQL["combo_filter_image"].replace("rank <= 100", f"rank <= {ranking.DEFAULT_K}"),
}
