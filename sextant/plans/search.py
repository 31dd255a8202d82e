"""Queries for vector functions, exact and indexed search, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import graph_index as G
from sextant.operators import ivfpq as I
from sextant.operators import knn as K
from sextant.operators import ranking
from sextant.session import table

#: Batch queries: every vector whose id this divides. Fixed index parts for comparable results: the vectors with the smallest ids.
STEP = 100
#: Share of a trained index's cells that a query probes; components of a sub-vector.
PROBED = 0.75
WIDTH = 2
CLUSTERS = 8
SUBQUANTISERS = 8
CODES = 16
PROBES = 3
DEPTH = 10


def query_vector(corpus: DataFrame, vec_id: int = 0) -> Column:
    """One stored vector as a literal."""
    return K.literal_vector(corpus.filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def batch_queries(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def total(vector: Column) -> Column:
    """Digest of a vector: components weighted by their place."""
    return F.round(F.aggregate(F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6)


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _scalar(expression):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        corpus = _embeddings(spark, sf)
        return corpus.select("vec_id", *expression(F.col("embedding"), query_vector(corpus)))

    return run


vec_dot = _scalar(lambda a, q: [F.round(V.dot(a, q), 6).alias("value")])
vec_cosine = _scalar(lambda a, q: [F.round(V.cosine(a, q), 6).alias("value"), F.round(V.cosine_distance(a, V.zeros(64)), 6).alias("zero_distance")])
vec_l2 = _scalar(lambda a, q: [F.round(V.l2(a, q), 6).alias("value"), F.round(V.squared_l2(a, q), 6).alias("squared")])
vec_ip_distance = _scalar(lambda a, q: [F.round(V.ip_distance(a, q), 6).alias("value"), F.round(V.similarity_from_distance("l2", V.squared_l2(a, q)), 6).alias("similarity")])
vec_normalize = _scalar(lambda a, q: [F.round(V.norm(V.scale(a, 3.0)), 6).alias("norm"), V.is_normalised(a).alias("is_normalised"), total(V.normalise(V.scale(a, 3.0))).alias("digest")])
vec_arith = _scalar(lambda a, q: [total(V.add(a, V.scale(q, 2.0))).alias("sum_digest"), total(V.subtract(a, q)).alias("residual_digest"), total(V.subvector(V.as_double(a), 3, 8)).alias("part_digest"), total(V.ramp(64)).alias("ramp_digest")])


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    return rounded(K.knn(corpus, query_vector(corpus), 20), "similarity")


def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    return rounded(K.knn_batch(corpus, batch_queries(corpus), DEPTH, exclude_self=True), "similarity")


def knn_subset(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    return rounded(K.knn_subset(corpus, corpus.filter("label < 3").select("vec_id"), query_vector(corpus), DEPTH), "similarity")


def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    return rounded(K.knn_then_threshold(corpus, query_vector(corpus), 50, 0.2), "similarity")


def _metric(metric: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        corpus = _embeddings(spark, sf)
        return rounded(K.knn_metric(corpus, query_vector(corpus), metric), "distance")

    return run


def _fixed(corpus: DataFrame, config: I.Config) -> tuple[list, list]:
    """Index parts that SQL can name: the first vectors are the centroids, their first sub-vectors the codebooks."""
    rows = [r["embedding"] for r in corpus.filter(F.col("vec_id") < config.codes).orderBy("vec_id").select("embedding").collect()]
    books = [[r[m * config.width : (m + 1) * config.width] for r in rows] for m in range(config.subquantisers)]
    return rows[: config.clusters], books


CONFIG = I.Config(dimension=64, clusters=CLUSTERS, subquantisers=SUBQUANTISERS, codes=CODES, probes=PROBES)


def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    centroids, _ = _fixed(corpus, CONFIG)
    return corpus.select("vec_id", I.nearest(F.col("embedding"), I.literal_table(centroids)).alias("cluster_id"))


def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    return I.kmeans_step(corpus, _fixed(corpus, CONFIG)[0]).select("cluster_id", "n", total(F.col("centroid")).alias("digest"))


def ivf_probe(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    probed = corpus.select("vec_id", F.posexplode(I.nearest_several(F.col("embedding"), I.literal_table(_fixed(corpus, CONFIG)[0]), PROBES)).alias("place", "p"))
    return probed.select("vec_id", "place", F.col("p.i").alias("cluster_id"), F.round("p.d", 6).alias("distance"))


def pq_encode(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    return corpus.select("vec_id", F.array_join(I.encode(F.col("embedding"), _fixed(corpus, CONFIG)[1]).cast("array<string>"), ",").alias("codes"))


def pq_decode(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    books = _fixed(corpus, CONFIG)[1]
    decoded = I.decode(F.col("codes"), books)
    return corpus.select("vec_id", F.col("embedding"), I.encode(F.col("embedding"), books).alias("codes")).select("vec_id", total(decoded).alias("digest"), F.round(V.squared_l2(F.col("embedding"), decoded), 6).alias("error"))


def pq_adc(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    books = _fixed(corpus, CONFIG)[1]
    lookup = corpus.filter("vec_id = 0").select(I.distance_table(F.col("embedding"), books).alias("table"))
    return corpus.select("vec_id", I.encode(F.col("embedding"), books).alias("codes")).join(F.broadcast(lookup)).select("vec_id", F.round(I.table_distance(F.col("table"), F.col("codes")), 6).alias("distance"))


def ivf_postings(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    index = I.postings(corpus, *_fixed(corpus, CONFIG))
    return index.select("vec_id", "cluster_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


def ivfpq_search(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    centroids, books = _fixed(corpus, CONFIG)
    index = I.postings(corpus, centroids, books)
    # Codes make equal distances likely; each is added in order of the sub-vectors, so they tie to the last bit and go by id.
    # The SQL names no order for that sum: where DuckDB adds equal terms in different orders, its ranks follow the last bit.
    found = I.search(batch_queries(corpus), index, centroids, books, PROBES, DEPTH)
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def ivf_stats(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf)
    return I.statistics(I.postings(corpus, *_fixed(corpus, CONFIG)), CONFIG)


def ann_config_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, p, *I.recommended(n, 768, p).values()) for n in (100, 1_000, 50_000, 10_000_000) for p in ("speed", "balanced", "quality")]
    return spark.createDataFrame(rows, "n long, priority string, clusters int, subquantisers int, probes int, iterations int, links int, build_width int, search_width int")


def ann_adaptive_config(spark: SparkSession, sf: str) -> DataFrame:
    n = _embeddings(spark, sf).count()
    own = I.adaptive(n, 64)
    return spark.createDataFrame([(n, own["codes"], own["clusters"], own["subquantisers"], own["probes"])], "n long, codes int, clusters int, subquantisers int, probes int")


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of probing 3 of 8 cells with exact scores inside them, against exact search."""
    corpus = _embeddings(spark, sf)
    own = I.literal_table(_fixed(corpus, CONFIG)[0])
    queries = batch_queries(corpus)
    exact = K.knn_batch(corpus, queries, DEPTH)
    cells = corpus.select("vec_id", "embedding", I.nearest(F.col("embedding"), own).alias("cluster_id"))
    probed = queries.select("query_id", "query", F.explode(I.nearest_several(F.col("query"), own, PROBES)["i"]).alias("cluster_id"))
    found = K.top_per_query(probed.join(cells, "cluster_id").select("query_id", "vec_id", V.cosine(F.col("embedding"), F.col("query")).alias("similarity")), DEPTH)
    return I.recall(found, exact, DEPTH)


def graph_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of the neighbour graphs, for every query."""
    corpus = _embeddings(spark, sf)
    config, queries = G.Config(64, "cosine"), batch_queries(corpus)
    return I.recall(G.search(G.graphs(corpus, config), queries, DEPTH, config, effort=10 * DEPTH), K.knn_batch(corpus, queries, DEPTH), DEPTH)


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf).select("vec_id", "label")
    store = corpus.filter("vec_id % 3 <> 0").withColumn("version", F.lit(1))
    changes = corpus.filter("vec_id % 2 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    return I.upsert(store, changes)


def delete_anti(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _embeddings(spark, sf).select("vec_id", "label")
    return I.delete(corpus, corpus.filter("label = 1"))


def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    from sextant.operators.timeline import incremental_diff as diff

    corpus = _embeddings(spark, sf).select("vec_id")
    return diff(corpus.filter("vec_id % 2 = 0"), corpus.filter("vec_id % 5 <> 0"), "vec_id")


def best_text_match(spark: SparkSession, sf: str) -> DataFrame:
    """Best of the query vectors as candidates for every vector; the first wins ties."""
    corpus = _embeddings(spark, sf)
    return rounded(K.best_match(corpus, batch_queries(corpus)), "similarity")


def trained_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of a trained index whose candidates are compared exactly, for every query."""
    corpus = _embeddings(spark, sf)
    n = min(I.FIT_ROWS, corpus.count())
    clusters = I.adaptive(n, 64)["clusters"]
    config = I.Config(dimension=64, clusters=clusters, subquantisers=64 // WIDTH, codes=min(64, max(8, n // 10)), probes=max(1, round(PROBED * clusters)))
    centroids, books = I.train(corpus, config)
    queries = batch_queries(corpus)
    near = I.search(queries, I.postings(corpus, centroids, books), centroids, books, config.probes, ranking.OVERFETCH * DEPTH)
    scored = near.select("query_id", "vec_id").join(corpus.select("vec_id", "embedding"), "vec_id").join(queries, "query_id").select("query_id", "vec_id", V.cosine(F.col("embedding"), F.col("query")).alias("similarity"))
    return I.recall(K.top_per_query(scored, DEPTH), K.knn_batch(corpus, queries, DEPTH), DEPTH)


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _embeddings(spark, sf).agg(F.count("*").alias("n_vectors"), F.countDistinct("vec_id").alias("n_ids"), F.countDistinct("label").alias("n_labels"), F.min(F.size("embedding")).alias("dimension"))


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_E = "embedding::DOUBLE[]"


def _sum(vector: str) -> str:
    return f"round(list_sum(list_transform({vector}, lambda x, i: x * i)), 6)"


_SQ = "list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_PARTS = f"""
    cent AS (SELECT vec_id::INT AS cluster_id, {_E} AS c FROM embeddings WHERE vec_id < {CLUSTERS}),
    book AS (SELECT m, vec_id::INT AS code, ({_E})[m * 8 + 1:m * 8 + 8] AS c FROM embeddings, range({SUBQUANTISERS}) r(m) WHERE vec_id < {CODES}),
    celld AS (SELECT e.vec_id, {_E} AS v, cluster_id, c, list_sum(list_transform(list_zip({_E}, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings e, cent),
    cells AS (SELECT vec_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, arg_min(v, (d, cluster_id)) AS v, arg_min(c, (d, cluster_id)) AS c FROM celld GROUP BY vec_id)"""


def _encoded(source: str) -> str:
    """Codes of the vectors v of a relation (vec_id, v)."""
    return f"""SELECT vec_id, m, arg_min(code, (d, code)) AS code, arg_min(c, (d, code)) AS c FROM (
        SELECT s.vec_id, m, code, c, list_sum(list_transform(list_zip(s.v[m * 8 + 1:m * 8 + 8], c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM {source} s, book) GROUP BY vec_id, m"""


QUERIES = {
    "vec_dot": vec_dot, "vec_cosine": vec_cosine, "vec_l2": vec_l2, "vec_ip_distance": vec_ip_distance, "vec_normalize": vec_normalize, "vec_arith": vec_arith,
    "knn_exact": knn_exact, "knn_batch": knn_batch, "knn_subset": knn_subset, "knn_threshold": knn_threshold, "knn_metric_l2": _metric("l2"), "knn_metric_ip": _metric("ip"), "knn_metric_cosine": _metric("cosine"),
    "kmeans_assign": kmeans_assign, "kmeans_step": kmeans_step, "ivf_probe": ivf_probe, "ivf_postings": ivf_postings, "pq_encode": pq_encode, "pq_decode": pq_decode, "pq_adc": pq_adc,
    "ivfpq_search": ivfpq_search, "ivf_stats": ivf_stats, "ann_config_table": ann_config_table, "ann_adaptive_config": ann_adaptive_config, "recall_at_k": recall_at_k, "trained_recall": trained_recall, "graph_recall": graph_recall,
    "upsert_latest": upsert_latest, "delete_anti": delete_anti, "incremental_diff": incremental_diff, "best_text_match": best_text_match, "corpus_stats": corpus_stats,
}


def _knn_sql(distance: str, name: str, order: str, k: int = 20, where: str = "true") -> str:
    return f"SELECT vec_id, round({distance}, 6) + 0.0::DOUBLE AS {name} FROM embeddings WHERE {where} ORDER BY {distance} {order}, vec_id LIMIT {k}"


_COS = f"list_cosine_similarity({_E}, {_Q})"
_IP = f"list_inner_product({_E}, {_Q})"
_L2 = f"list_distance({_E}, {_Q})"
_BATCH_SQL = f"""SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.{_E}, q.{_E}) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % {STEP} = 0"""

ORACLES = {
    "vec_dot": f"SELECT vec_id, round({_IP}, 6) AS value FROM embeddings",
    "vec_cosine": f"SELECT vec_id, round({_COS}, 6) AS value, 1.0::DOUBLE AS zero_distance FROM embeddings",
    "vec_l2": f"SELECT vec_id, round({_L2}, 6) AS value, round({_L2} * {_L2}, 6) AS squared FROM embeddings",
    "vec_ip_distance": f"SELECT vec_id, round(1 - {_IP}, 6) + 0.0::DOUBLE AS value, round(1 - {_L2} * {_L2} / 2, 6) AS similarity FROM embeddings",
    "vec_normalize": f"""SELECT vec_id, round(3 * n, 6) AS norm, abs(n - 1) < 0.001 AS is_normalised, {_sum("list_transform(v, lambda x: x / n)")} AS digest
        FROM (SELECT vec_id, {_E} AS v, sqrt(list_inner_product({_E}, {_E})) AS n FROM embeddings)""",
    "vec_arith": f"""SELECT vec_id, {_sum("list_transform(list_zip(v, q), lambda z: z[1] + 2 * z[2])")} AS sum_digest, {_sum("list_transform(list_zip(v, q), lambda z: z[1] - z[2])")} AS residual_digest,
        {_sum("v[25:32]")} AS part_digest, {_sum("list_transform(range(64), lambda x: x / 100.0::DOUBLE)")} AS ramp_digest FROM (SELECT vec_id, {_E} AS v, {_Q} AS q FROM embeddings)""",
    "knn_exact": _knn_sql(_COS, "similarity", "DESC"),
    "knn_batch": f"SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM ({_BATCH_SQL}) WHERE query_id <> vec_id) WHERE rank <= {DEPTH}",
    "knn_subset": _knn_sql(_COS, "similarity", "DESC", DEPTH, "label < 3"),
    "knn_threshold": f"SELECT * FROM ({_knn_sql(_COS, 'similarity', 'DESC', 50)}) WHERE similarity >= 0.2",
    "knn_metric_l2": _knn_sql(f"{_L2} * {_L2}", "distance", "ASC"),
    "knn_metric_ip": _knn_sql(f"1 - {_IP}", "distance", "ASC"),
    "knn_metric_cosine": _knn_sql(f"1 - {_COS}", "distance", "ASC"),
    "kmeans_assign": f"WITH {_PARTS} SELECT vec_id, cluster_id FROM cells",
    "kmeans_step": f"""WITH {_PARTS}, means AS (SELECT cluster_id, i, avg(x) AS x, count(*) AS n FROM (SELECT cluster_id, unnest(v) AS x, unnest(range(64)) AS i FROM cells) GROUP BY cluster_id, i)
        SELECT cluster_id, max(n) AS n, round(sum(x * (i + 1)), 6) AS digest FROM means GROUP BY cluster_id""",
    "ivf_probe": f"WITH {_PARTS} SELECT vec_id, place, cluster_id, round(d, 6) AS distance FROM (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) - 1)::INT AS place FROM celld) WHERE place < {PROBES}",
    "ivf_postings": f"""WITH {_PARTS}, res AS (SELECT vec_id, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS v FROM cells), enc AS ({_encoded("res")})
        SELECT vec_id, cluster_id, codes FROM cells JOIN (SELECT vec_id, string_agg(code::VARCHAR, ',' ORDER BY m) AS codes FROM enc GROUP BY vec_id) USING (vec_id)""",
    "pq_encode": f"WITH {_PARTS}, own AS (SELECT vec_id, {_E} AS v FROM embeddings), enc AS ({_encoded('own')}) SELECT vec_id, string_agg(code::VARCHAR, ',' ORDER BY m) AS codes FROM enc GROUP BY vec_id",
    "pq_decode": f"""WITH {_PARTS}, own AS (SELECT vec_id, {_E} AS v FROM embeddings), enc AS ({_encoded("own")}), decoded AS (SELECT vec_id, flatten(list(c ORDER BY m)) AS w FROM enc GROUP BY vec_id)
        SELECT vec_id, {_sum("w")} AS digest, round(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS error FROM decoded JOIN own USING (vec_id)""",
    "pq_adc": f"""WITH {_PARTS}, own AS (SELECT vec_id, {_E} AS v FROM embeddings), enc AS ({_encoded("own")})
        SELECT vec_id, round(sum(list_sum(list_transform(list_zip({_Q}[m * 8 + 1:m * 8 + 8], c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM enc GROUP BY vec_id""",
    "ivfpq_search": f"""WITH {_PARTS}, res AS (SELECT vec_id, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS v FROM cells), enc AS ({_encoded("res")}),
        probes AS (SELECT vec_id AS query_id, cluster_id, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS r FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) AS place FROM celld WHERE vec_id % {STEP} = 0) WHERE place <= {PROBES}),
        scored AS (SELECT query_id, cells.vec_id, sum(list_sum(list_transform(list_zip(r[m * 8 + 1:m * 8 + 8], enc.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
            FROM probes JOIN cells USING (cluster_id) JOIN enc ON enc.vec_id = cells.vec_id GROUP BY query_id, cells.vec_id)
        SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM scored) WHERE rank <= {DEPTH}""",
    "ivf_stats": f"WITH {_PARTS}, sizes AS (SELECT cluster_id, count(*) AS n FROM cells GROUP BY 1) SELECT sum(n)::BIGINT AS total, {CLUSTERS} AS clusters, count(*) AS non_empty, avg(n) AS avg_size, max(n) AS max_size, min(n) AS min_size, {CONFIG.compression}::DOUBLE AS compression FROM sizes",
    "ann_config_table": """WITH sizes(n) AS (VALUES (100), (1000), (50000), (10000000)),
        priorities(priority, share, low, high, iterations, links, build_width, search_width) AS (VALUES ('speed', 0.01, 1, 8, 25, 8, 100, 20), ('balanced', 0.03, 4, 16, 25, 16, 200, 50), ('quality', 0.10, 8, 64, 50, 32, 400, 100)),
        c AS (SELECT n, least(4096, greatest(16, pow(2, ceil(log2(sqrt(n)) - 1e-9))))::INT AS clusters FROM sizes)
        SELECT n::BIGINT AS n, priority, clusters, 96 AS subquantisers, least(high, greatest(low, round_even(clusters * share, 0)))::INT AS probes, iterations, links, build_width, search_width FROM c, priorities""",
    "ann_adaptive_config": "SELECT n, least(256, greatest(8, n // 10))::INT AS codes, c AS clusters, 64 AS subquantisers, c AS probes FROM (SELECT count(*) AS n, least(256, greatest(2, floor(sqrt(count(*)) + 0.5)))::INT AS c FROM embeddings)",
    "recall_at_k": f"""WITH {_PARTS}, exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM ({_BATCH_SQL})),
        probes AS (SELECT vec_id AS query_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) AS place FROM celld WHERE vec_id % {STEP} = 0) WHERE place <= {PROBES}),
        found AS (SELECT p.query_id, b.vec_id, row_number() OVER (PARTITION BY p.query_id ORDER BY similarity DESC, b.vec_id) AS rank FROM ({_BATCH_SQL}) b JOIN cells USING (vec_id) JOIN probes p ON p.query_id = b.query_id AND p.cluster_id = cells.cluster_id)
        SELECT e.query_id, count(f.vec_id) AS correct, count(f.vec_id) / {DEPTH}.0::DOUBLE AS recall FROM exact e LEFT JOIN found f ON f.query_id = e.query_id AND f.vec_id = e.vec_id AND f.rank <= {DEPTH} WHERE e.rank <= {DEPTH} GROUP BY e.query_id""",
    "upsert_latest": "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0",
    "delete_anti": "SELECT vec_id, label FROM embeddings WHERE label <> 1",
    "incremental_diff": "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'keep' ELSE 'add' END AS state FROM embeddings WHERE vec_id % 5 <> 0",
    "best_text_match": f"SELECT vec_id, arg_max(query_id, (similarity, -query_id)) AS candidate, round(max(similarity), 6) AS similarity FROM ({_BATCH_SQL}) GROUP BY vec_id",
    "corpus_stats": "SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids, count(DISTINCT label) AS n_labels, min(len(embedding))::INT AS dimension FROM embeddings",
}
