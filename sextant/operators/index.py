"""One interface over exact and indexed search, and the choice between them.

An index takes vectors in batches, answers batches of queries with a DataFrame (query_id, id,
distance, rank), and is stored as Parquet tables with a metadata file beside them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import graph_index as G
from sextant.operators import ivfpq as I
from sextant.operators import knn as K
from sextant.operators import ranking
from sextant.session import checkpointed
from sextant.sources import metadata

# The range of k.
LEAST_K, MOST_K = 1, 10_000


def checked_k(k: int) -> int:
    if not LEAST_K <= k <= MOST_K:
        raise ValueError(f"k is in {LEAST_K}..{MOST_K}")
    return k


class VectorIndex(Protocol):
    """What search code needs of an index."""

    requires_training: bool

    def add(self, points: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int, effort: int | None = None) -> DataFrame: ...

    def save(self, path: str) -> None: ...

    def count(self) -> int: ...


@dataclass
class ExactIndex:
    """Keeps the vectors and compares all of them. Later vectors replace earlier ones of the same id."""

    spark: SparkSession
    dimension: int
    metric: str = "cosine"
    points: DataFrame | None = None
    requires_training = False

    def add(self, points: DataFrame) -> None:
        own = points.select("vec_id", V.as_double(F.col("embedding")).alias("embedding"))
        # Kept, so that later batches do not stack their plans on this one.
        self.points = checkpointed(own if self.points is None else I.upsert(self.points.withColumn("version", F.lit(0)), own.withColumn("version", F.lit(1))).drop("version"))

    def count(self) -> int:
        return 0 if self.points is None else self.points.count()

    def search(self, queries: DataFrame, k: int, effort: int | None = None) -> DataFrame:
        points = self.points if self.points is not None else self.spark.createDataFrame([], "vec_id long, embedding array<double>")
        return K.batch_distances(points, queries, self.metric, checked_k(k))

    def save(self, path: str) -> None:
        if self.points is not None:
            self.points.write.mode("overwrite").parquet(f"{path}/points")
        metadata.write(self.spark, path, metadata.Metadata(self.dimension, metadata.SPACES[self.metric], self.count(), algorithm="exact"))


@dataclass
class IvfPqIndex:
    """Inverted file with product quantisation; distances are squared L2. Vectors wait until there are enough to train on."""

    spark: SparkSession
    config: I.Config
    seed: int = 42
    centroids: list | None = None
    codebooks: list | None = None
    postings: DataFrame | None = None
    waiting: list[DataFrame] = field(default_factory=list)
    requires_training = True

    def train(self, points: DataFrame) -> None:
        self.centroids, self.codebooks = I.train(points, self.config, self.seed)

    def add(self, points: DataFrame) -> None:
        if self.centroids is None:
            self.waiting.append(points.select("vec_id", "embedding"))
            pending = self._pending()
            if pending.count() < max(I.TRAIN_FROM, self.config.clusters, self.config.codes):
                return
            self.train(pending)
            points, self.waiting = pending, []
        own = I.postings(points, self.centroids, self.codebooks)
        known = own if self.postings is None else self.postings.join(own.select("vec_id"), "vec_id", "left_anti").select(own.columns).unionByName(own)
        self.postings = checkpointed(known)

    def _pending(self) -> DataFrame:
        found = self.waiting[0]
        for more in self.waiting[1:]:
            found = found.unionByName(more)
        return found

    def count(self) -> int:
        return 0 if self.postings is None else self.postings.count()

    def search(self, queries: DataFrame, k: int, effort: int | None = None) -> DataFrame:
        """``effort``: probed cells, at most all."""
        if self.postings is None:
            raise ValueError("the index is not trained")
        probes = max(1, min(effort or self.config.probes, self.config.clusters))
        return I.search(queries, self.postings, self.centroids, self.codebooks, probes, checked_k(k))

    def save(self, path: str) -> None:
        if self.postings is None:
            raise ValueError("the index is not trained")
        I.write(self.postings, self.spark, path, self.centroids, self.codebooks)
        metadata.write(self.spark, path, metadata.Metadata(self.config.dimension, metadata.SPACES["l2"], self.count(), algorithm="ivfpq", description=f"{self.config.subquantisers} sub-vectors"))


@dataclass
class GraphIndex:
    """Neighbour graphs over shards. Ids that are there already are left as they are."""

    spark: SparkSession
    config: G.Config
    graphs: DataFrame | None = None
    requires_training = False

    def add(self, points: DataFrame) -> None:
        """The graphs are built again with the new vectors."""
        own = points.select("vec_id", V.as_double(F.col("embedding")).alias("embedding")).dropDuplicates(["vec_id"])
        if self.graphs is not None:
            known = self.graphs.select("vec_id", "embedding")
            own = known.unionByName(own.join(known.select("vec_id"), "vec_id", "left_anti"))
        self.graphs = checkpointed(G.graphs(own, self.config))

    def count(self) -> int:
        return 0 if self.graphs is None else self.graphs.count()

    def search(self, queries: DataFrame, k: int, effort: int | None = None) -> DataFrame:
        """``effort``: vectors kept while walking."""
        if self.graphs is None:
            return self.spark.createDataFrame([], "query_id long, vec_id long, distance double, rank int")
        return G.search(self.graphs, queries, checked_k(k), self.config, effort or G.SEARCH_WIDTH)

    def save(self, path: str) -> None:
        if self.graphs is not None:
            self.graphs.write.mode("overwrite").parquet(f"{path}/graphs")
        metadata.write(self.spark, path, metadata.Metadata(self.config.dimension, metadata.SPACES[self.config.metric], self.count(), "graph", self.config.links, self.config.build_width))


def create(spark: SparkSession, algorithm: str, dimension: int, **options) -> VectorIndex:
    """An empty index: ``exact`` (metric=...), ``ivfpq`` or ``graph`` (the options of their ``Config``)."""
    if algorithm == "exact":
        return ExactIndex(spark, dimension, **options)
    if algorithm == "ivfpq":
        return IvfPqIndex(spark, I.Config(dimension=dimension, **options))
    if algorithm == "graph":
        return GraphIndex(spark, G.Config(dimension, **options))
    raise ValueError(f"unknown algorithm {algorithm!r}")


def load(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index of any kind."""
    own = metadata.read(spark, path)
    metric = next(m for m, s in metadata.SPACES.items() if s == own.space_type)
    if own.algorithm == "graph":
        return GraphIndex(spark, G.Config(own.dimension, metric, own.links, own.build_width), spark.read.parquet(f"{path}/graphs") if own.item_count else None)
    if own.algorithm == "exact":
        return ExactIndex(spark, own.dimension, metric, spark.read.parquet(f"{path}/points") if own.item_count else None)
    postings, centroids, books = I.read(spark, path)
    config = I.Config(own.dimension, len(centroids), len(books), len(books[0]), min(8, len(centroids)))
    return IvfPqIndex(spark, config, centroids=centroids, codebooks=books, postings=postings)


def search(corpus: DataFrame, queries: DataFrame, k: int, index: VectorIndex | None = None, forced_exact: bool = False) -> DataFrame:
    """Cosine search by the path that fits: exact for small corpora, on request, or where no index is ready.

    The index is asked for ``OVERFETCH`` times k and cut, so that post-filters have something to choose from.
    """
    ready = index is not None and index.count() > 0
    path = I.access_path(corpus.limit(I.BRUTE_FORCE_UP_TO + 1).count(), forced_exact, trained=ready)
    if path == "exact":
        return K.knn_batch(corpus, queries, checked_k(k))
    found = index.search(queries, min(MOST_K, ranking.OVERFETCH * k)).filter(F.col("rank") <= k)
    metric = getattr(getattr(index, "config", index), "metric", "l2")
    return found.select("query_id", "vec_id", V.similarity_from_distance(metric, F.col("distance")).alias("similarity"), "rank")
