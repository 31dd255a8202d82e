"""Inverted file with product-quantised residuals as relational tables.

An index is three DataFrames: coarse centroids (cluster_id, centroid), codebooks (m, code,
centroid) and postings (cluster_id, vec_id, codes). Centroids and codebooks have a size set by
the parameters (``Config``), so they travel inside expressions as literal arrays, or with the
function that encodes whole batches: assignment, encoding and search need no join with them. Ties go to the lowest number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import knn as K
from sextant.operators.sampling import bounded_sample
from sextant.session import spread

# Bounds of the configuration.
LARGEST_DIMENSION = 4096
LARGEST_CODEBOOK = 256
BRUTE_FORCE_UP_TO = 100
TRAIN_FROM = 50

#: Points that an index is trained on, at most about; postings that a task looks at together.
FIT_ROWS = 20_000
CHUNK_ROWS = 65_536


@dataclass(frozen=True)
class Config:
    """Index parameters; raises ValueError where they do not fit together."""

    dimension: int
    clusters: int
    subquantisers: int
    codes: int = 256
    probes: int = 8
    iterations: int = 25

    def __post_init__(self) -> None:
        if not 1 <= self.dimension <= LARGEST_DIMENSION:
            raise ValueError(f"dimension {self.dimension} is not in 1..{LARGEST_DIMENSION}")
        if self.subquantisers < 1 or self.dimension % self.subquantisers:
            raise ValueError(f"{self.subquantisers} sub-vectors do not divide dimension {self.dimension}")
        if not 1 <= self.codes <= LARGEST_CODEBOOK:
            raise ValueError(f"codes {self.codes} is not in 1..{LARGEST_CODEBOOK}")
        if self.clusters < 1 or not 1 <= self.probes <= self.clusters:
            raise ValueError("probes must be in 1..clusters")

    @property
    def width(self) -> int:
        return self.dimension // self.subquantisers

    @property
    def compression(self) -> float:
        """Bytes of a float vector over bytes of its codes."""
        return self.dimension * 4 / self.subquantisers


def recommended(n: int, dimension: int, priority: str = "balanced") -> dict[str, int]:
    """Parameters by corpus size and priority (speed, balanced or quality)."""
    # Share of clusters probed, its bounds and training rounds; graph settings (links, build and search width).
    probing = {"speed": (0.01, 1, 8), "balanced": (0.03, 4, 16), "quality": (0.10, 8, 64)}
    graph = {"speed": (8, 100, 20), "balanced": (16, 200, 50), "quality": (32, 400, 100)}
    if priority not in probing:
        raise ValueError(f"priority is one of {sorted(probing)}")
    clusters = 1
    while clusters * clusters < n:  # the power of two at or above the square root
        clusters *= 2
    clusters = min(4096, max(16, clusters))
    share, low, high = probing[priority]
    links, build, search = graph[priority]
    subquantisers = 96 if dimension % 96 == 0 else max(1, min(96, dimension // 8))
    return {"clusters": clusters, "subquantisers": subquantisers, "probes": min(high, max(low, round(clusters * share))), "iterations": 50 if priority == "quality" else 25, "links": links, "build_width": build, "search_width": search}


def adaptive(n: int, dimension: int = 768) -> dict[str, int]:
    """Parameters that follow a small corpus: codes n/10 in 8..256, clusters near the square root in 2..256, all probed."""
    clusters = min(256, max(2, int(n**0.5 + 0.5)))
    subquantisers = next(m for m in range(min(64, dimension), 0, -1) if dimension % m == 0)
    return {"codes": min(256, max(8, n // 10)), "clusters": clusters, "subquantisers": subquantisers, "probes": clusters, "iterations": 50}


def access_path(n: int, forced_exact: bool = False, preferred_ready: bool = False, trained: bool = False) -> str:
    """Which search answers a query: exact for small corpora or on request, else a ready index, else exact."""
    if forced_exact or n <= BRUTE_FORCE_UP_TO:
        return "exact"
    return "preferred" if preferred_ready else "ivfpq" if trained else "exact"


literal_table = K.literal_table


def distances(vector: Column, centroids: Column) -> Column:
    """Squared distances of a vector to each of an array of centroids."""
    return F.transform(centroids, lambda c: V.squared_l2(vector, c))


def nearest(vector: Column, centroids: Column) -> Column:
    """Number of the nearest centroid, from 0."""
    own = F.transform(centroids, lambda c, i: F.struct(V.squared_l2(vector, c).alias("d"), i.alias("i")))
    return F.array_min(own)["i"]


def nearest_several(vector: Column, centroids: Column, count: int) -> Column:
    """The ``count`` nearest centroids as an array of (d, i), nearest first; fewer if there are fewer."""
    own = F.transform(centroids, lambda c, i: F.struct(V.squared_l2(vector, c).alias("d"), i.alias("i")))
    return F.slice(F.array_sort(own), 1, count)


def kmeans_step(points: DataFrame, centroids: Sequence[Sequence[float]], vector_col: str = "embedding") -> DataFrame:
    """One Lloyd step: (cluster_id, n, centroid) of the clusters that have points. Means are combined before the shuffle."""
    assigned = points.select(nearest(F.col(vector_col), literal_table(centroids)).alias("cluster_id"), V.as_double(F.col(vector_col)).alias("v"))
    owned = assigned.select("cluster_id", F.posexplode("v").alias("pos", "x"))
    means = owned.groupBy("cluster_id", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("cluster_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select("cluster_id", "n", F.col("c.x").alias("centroid"))


def train_kmeans(points: DataFrame, clusters: int, iterations: int = 25, tolerance: float = 1e-4, seed: int = 42, vector_col: str = "embedding") -> list[list[float]]:
    """k-means centroids by the distributed trainer (parallel k-means++ start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if points.limit(clusters).count() < clusters:
        raise ValueError(f"fewer points than {clusters} centroids")
    data = points.select(array_to_vector(V.as_double(F.col(vector_col))).alias("features"))
    model = KMeans(k=clusters, maxIter=iterations, tol=tolerance, seed=seed).fit(data)
    return [list(map(float, c)) for c in model.clusterCenters()]


def lloyd(x: np.ndarray, clusters: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centroids of a sample that fits in memory; empty clusters start again at a point."""
    if len(x) < clusters:
        raise ValueError(f"fewer points than {clusters} centroids")
    centroids = x[rng.choice(len(x), clusters, replace=False)].copy()
    for _ in range(iterations):
        own = _nearest_rows(x, centroids)
        counts = np.bincount(own, minlength=clusters)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), clusters)])
        if np.abs(new - centroids).max() < 1e-6:
            break
        centroids = new
    return centroids


def train(points: DataFrame, config: Config, seed: int = 42, vector_col: str = "embedding", fit_rows: int = FIT_ROWS) -> tuple[list, list]:
    """Coarse centroids and, on residuals, one codebook for each sub-vector, from a sample of about ``fit_rows`` points at most.

    One pass brings the sample; nothing is trained by a job for each codebook.
    """
    rows = points.select(V.as_double(F.col(vector_col)).alias("v")).filter(F.size("v") == config.dimension)
    sample = bounded_sample(rows, F.xxhash64("v"), fit_rows, seed).toArrow()["v"].combine_chunks()
    x = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, config.dimension)
    x = x[np.lexsort(x.T[::-1])]  # in whatever order the rows came
    rng = np.random.default_rng(seed)
    centroids = lloyd(x, config.clusters, config.iterations, rng)
    residuals = x - centroids[_nearest_rows(x, centroids)]
    books = [lloyd(residuals[:, m * config.width : (m + 1) * config.width], config.codes, config.iterations, rng) for m in range(config.subquantisers)]
    return centroids.tolist(), [b.tolist() for b in books]


def residual(vector: Column, centroids: Column) -> Column:
    return V.subtract(vector, F.get(centroids, nearest(vector, centroids)))


def encode(vector: Column, codebooks: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Codes of a vector: for each sub-vector its nearest codebook entry."""
    width = len(codebooks[0][0])
    return F.array(*[nearest(V.subvector(vector, m, width), literal_table(book)) for m, book in enumerate(codebooks)])


def decode(codes: Column, codebooks: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Vector that a code stands for."""
    return F.flatten(F.array(*[F.get(literal_table(book), F.get(codes, F.lit(m))) for m, book in enumerate(codebooks)]))


def distance_table(query: Column, codebooks: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Squared distance of each of a query's sub-vectors to each codebook entry: array by sub-vector of arrays by code."""
    width = len(codebooks[0][0])
    return F.array(*[distances(V.subvector(query, m, width), literal_table(book)) for m, book in enumerate(codebooks)])


def table_distance(table: Column, codes: Column) -> Column:
    """Asymmetric distance: one table entry for each code."""
    picked = F.zip_with(table, codes, lambda row, code: F.get(row, code))
    return F.aggregate(picked, F.lit(0.0), lambda total, x: total + x)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the first axis, added in order of the components as ``V.squared_l2`` and SQL add them.

    numpy's own sum takes another order, whose last bits send ties elsewhere.
    """
    total = np.zeros(np.broadcast_shapes(x.shape, y.shape)[1:])
    for a, b in zip(x, y, strict=True):
        total += (a - b) ** 2
    return total


def _nearest_rows(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row; the lowest wins ties."""
    step = max(1, (1 << 16) // max(1, len(centroids)))
    parts = [np.ascontiguousarray(x[at : at + step].T) for at in range(0, len(x), step)]
    return np.concatenate([_squares(part[:, None], centroids.T[..., None]).argmin(0) for part in parts]) if len(x) else np.empty(0, dtype=np.int64)


def postings(points: DataFrame, centroids: Sequence[Sequence[float]], codebooks, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(cluster_id, id, codes) of every vector: its cell, and the codes of its residual.

    The same values as ``nearest`` and ``encode`` give, computed for whole Arrow batches. Vectors that are null or of
    another dimension than the centroids are left out.
    """
    coarse, books = np.array(centroids, dtype=float), [np.array(b, dtype=float) for b in codebooks]
    width = books[0].shape[1]
    kind = points.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, coarse.shape[1])
            cells = _nearest_rows(x, coarse)
            residuals = x - coarse[cells]
            codes = np.stack([_nearest_rows(residuals[:, m * width : (m + 1) * width], book) for m, book in enumerate(books)], axis=1)
            offsets = np.arange(0, codes.size + 1, len(books), dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), batch.column("id"), listed], names=["cluster_id", "id", "codes"])

    rows = spread(points.select(F.col(id_col).alias("id"), V.as_double(F.col(vector_col)).alias("v")).filter(F.size("v") == coarse.shape[1]))
    return rows.mapInArrow(run, f"cluster_id int, id {kind}, codes array<int>").withColumnRenamed("id", id_col)


def search(queries: DataFrame, index: DataFrame, centroids, codebooks, probes: int, k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest among the probed cells.

    ``queries`` (query_id, query), whose size is checked, are broadcast with the cells that each probes. Tasks go through their
    postings a cell at a time, sum table entries for all queries of the cell at once and keep k candidates a query: postings stay where
    they are, no cell meets in one task, and no pair rows arise. Sums run over components and sub-vectors in order, so equal codes tie.
    """
    query_ids, matrix = K.query_matrix(queries)
    coarse, books = np.array(centroids, dtype=float), np.array(codebooks, dtype=float)
    width = books.shape[2]
    places = np.argsort(_squares(matrix.T[..., None], coarse.T[:, None]), axis=1, kind="stable")[:, :probes] if len(query_ids) else np.empty((0, 0), dtype=np.int64)
    asking = {cell: np.flatnonzero((places == cell).any(1)) for cell in np.unique(places).tolist()}
    shared = index.sparkSession.sparkContext.broadcast((query_ids, matrix, asking))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, cells_of = shared.value
        best = K.Best(k)
        for rows in _in_chunks(batches, CHUNK_ROWS):
            cells, ids = rows["cluster_id"].to_numpy(), rows["id"].to_numpy()
            codes = rows["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.argsort(cells, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                asked = cells_of.get(int(cells[part[0]])) if len(part) else None
                for at in range(0, len(asked) if asked is not None else 0, K.QUERY_BLOCK):
                    block = asked[at : at + K.QUERY_BLOCK]
                    left = (own[block] - coarse[cells[part[0]]]).reshape(len(block), len(books), 1, width)
                    tables = _squares(np.moveaxis(left, 3, 0), np.moveaxis(books, 2, 0)[:, None])  # query x sub-vector x code
                    values = np.zeros((len(block), len(part)))
                    for m in range(len(books)):
                        values += tables[:, m][:, codes[part, m]]
                    best.add(block, ids[part], values)
            best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(names[best.query]), pa.array(best.ids), pa.array(best.values)], names=["query_id", id_col, "distance"])

    rows = index.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col(id_col).cast("long").alias("id"), F.col("codes").cast("array<int>").alias("codes")).filter(F.col("cluster_id").isin([int(c) for c in asking]))
    return K.top_per_query(rows.mapInArrow(run, f"query_id long, {id_col} long, distance double"), k, "distance", descending=False, id_col=id_col)


def _in_chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def statistics(index: DataFrame, config: Config) -> DataFrame:
    """One row: entries, cells, non-empty cells, their mean, largest and smallest size, compression."""
    sizes = index.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.lit(config.clusters).alias("clusters"), F.count("*").alias("non_empty"),
        F.avg("n").alias("avg_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"), F.lit(config.compression).alias("compression"),
    )


def write_parts(spark: SparkSession, path: str, centroids, codebooks) -> None:
    """Stores the trained parts. The codebooks are written last: where they are, the parts are whole."""
    spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    rows = [(m, code, list(map(float, c))) for m, book in enumerate(codebooks) for code, c in enumerate(book)]
    spark.createDataFrame(rows, "m int, code int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/codebooks")


def read_parts(spark: SparkSession, path: str) -> tuple[list, list]:
    """(centroids, codebooks); their size is set by the parameters."""
    books: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/codebooks").orderBy("m", "code").collect():
        books.setdefault(r["m"], []).append(r["centroid"])
    centroids = [r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").collect()]
    return centroids, [books[m] for m in sorted(books)]


def write(index: DataFrame, spark: SparkSession, path: str, centroids, codebooks) -> None:
    """Stores the three index tables; postings lie in a folder for each cell."""
    index.write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/postings")
    write_parts(spark, path, centroids, codebooks)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, list, list]:
    """(postings, centroids, codebooks) as ``write`` stored them."""
    return spark.read.parquet(f"{path}/postings"), *read_parts(spark, path)


def upsert(store: DataFrame, changes: DataFrame, id_col: str = "vec_id", order_col: str = "version") -> DataFrame:
    """Latest row of every id over both tables; among equally late ones that of the changes, then the one with the least hash."""
    store, changes = store.withColumn("side_", F.lit(0)), changes.withColumn("side_", F.lit(1))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order_col), F.desc("side_"), F.xxhash64(*[F.col(c) for c in store.columns])))
    return store.unionByName(changes).withColumn("rank_", rank).filter("rank_ = 1").drop("rank_", "side_")


def delete(store: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return store.join(ids.select(id_col).distinct(), id_col, "left_anti")


def recall(found: DataFrame, exact: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, correct, recall): share of k that both results hold; always over k."""
    both = exact.select("query_id", id_col, F.lit(1).alias("hit"))
    joined = both.join(found.select("query_id", id_col, F.lit(1).alias("found")), ["query_id", id_col], "left")
    return joined.groupBy("query_id").agg(F.count("found").alias("correct")).withColumn("recall", F.col("correct") / F.lit(float(k)))
