"""Exact nearest neighbours.

One query is a projection with a top-k (TakeOrderedAndProject); a batch is a broadcast matrix of
checked size that tasks multiply with their Arrow batches. Order is always score descending, then
id ascending.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.session import spread

#: Largest query matrix that is broadcast.
BROADCAST_BYTES = 256 << 20
QUERY_BLOCK = 256


def literal_vector(values: Sequence[float]) -> Column:
    """A vector as one constant: parsed as a whole, since a call for each component is slow to plan."""
    return _constant([float(x) for x in values], "array<double>")


def literal_table(rows: Sequence[Sequence[float]]) -> Column:
    """Vectors as one constant array of arrays."""
    return _constant([[float(x) for x in row] for row in rows], "array<array<double>>")


def _constant(values: list, kind: str) -> Column:
    text = json.dumps(values)
    if "N" in text or "I" in text:
        raise ValueError("constants hold finite numbers")
    return F.from_json(F.lit(text), kind)


def knn(corpus: DataFrame, query: Column, k: int = 20, threshold: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cosine top-k of one query vector; a threshold >= 0 drops lower similarities before the cut."""
    scored = corpus.select(F.col(id_col), V.cosine(F.col(vector_col), query).alias("similarity"))
    if threshold >= 0:
        scored = scored.filter(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


def top_per_query(pairs: DataFrame, k: int, score: str = "similarity", descending: bool = True, query_col: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    order = F.desc(score) if descending else F.asc(score)
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(order, F.asc(id_col)))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def query_matrix(queries: DataFrame, most_bytes: int = BROADCAST_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a query set (query_id, query) whose size is checked first; null vectors take no part.

    Beyond ``most_bytes`` the caller has to ask in several batches or use an index.
    """
    own = queries.select(F.col("query_id").cast("long"), V.as_double(F.col("query")).alias("query")).filter("query IS NOT NULL")
    shape = own.agg(F.count("*").alias("n"), F.min(F.size("query")).alias("low"), F.max(F.size("query")).alias("high")).first()
    if not shape["n"]:
        return np.empty(0, dtype=np.int64), np.empty((0, 0))
    if shape["low"] != shape["high"]:
        raise ValueError("query vectors differ in dimension")
    if 8 * shape["n"] * shape["high"] > most_bytes:
        raise ValueError(f"query vectors of more than {most_bytes} bytes; ask in batches")
    rows = own.toArrow()
    return rows["query_id"].to_numpy(), rows["query"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, shape["high"])


@dataclass
class Best:
    """The k best of every query so far; lower is better, ties by smaller id."""

    k: int
    query: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    values: np.ndarray = field(default_factory=lambda: np.empty(0))

    def add(self, queries: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """Values of rows ``ids`` (columns) for the queries of these numbers (rows); infinite ones take no part."""
        if values.shape[1] > self.k:
            level = np.partition(values, self.k - 1, axis=1)[:, self.k - 1]
            query, row = np.nonzero((values <= level[:, None]) & (values < np.inf))
        else:
            query, row = np.nonzero(values < np.inf)
        self.query, self.ids, self.values = np.append(self.query, queries[query]), np.append(self.ids, ids[row]), np.append(self.values, values[query, row])

    def cut(self) -> None:
        order = np.lexsort((self.ids, self.values, self.query))
        query = self.query[order]
        kept = order[np.arange(len(query)) - np.searchsorted(query, query) < self.k]
        self.query, self.ids, self.values = self.query[kept], self.ids[kept], self.values[kept]


def distances(metric: str, queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Query x row. Cosine vectors have length one already."""
    if metric == "l2":
        return np.maximum((queries**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (queries @ x.T), 0.0)
    return 1.0 - queries @ x.T


def batch_distances(corpus: DataFrame, queries: DataFrame, metric: str = "cosine", k: int = 20, most: float = np.inf, exclude_self: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank) of every query's k nearest within ``most`` under a metric of ``vectors.distance``.

    The query matrix, whose size is checked, is broadcast once; each task multiplies it with its Arrow batches
    and keeps k candidates a query, so no pair rows arise and the shuffle carries k rows a query and task.
    Vectors that are null, or of another dimension than the queries, take no part.
    """
    if metric not in V.METRICS:
        raise ValueError(f"metric is one of {V.METRICS}")
    query_ids, matrix = query_matrix(queries)
    shared = corpus.sparkSession.sparkContext.broadcast((query_ids, unit(matrix) if metric == "cosine" else matrix))
    dimension = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = shared.value
        best = Best(k)
        for batch in batches:
            if not batch.num_rows or not len(asked):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            x = unit(x) if metric == "cosine" else x
            for at in range(0, len(asked), QUERY_BLOCK):
                values = distances(metric, own[at : at + QUERY_BLOCK], x)
                values[values > most] = np.inf
                if exclude_self:
                    values[asked[at : at + QUERY_BLOCK, None] == ids[None, :]] = np.inf
                best.add(np.arange(at, at + len(values)), ids, values)
            best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(asked[best.query]), pa.array(best.ids), pa.array(best.values)], names=["query_id", id_col, "distance"])

    rows = spread(corpus.select(F.col(id_col).cast("long").alias("id"), V.as_double(F.col(vector_col)).alias("v")).filter(F.size("v") == dimension))
    return top_per_query(rows.mapInArrow(run, f"query_id long, {id_col} long, distance double"), k, "distance", descending=False, id_col=id_col)


def knn_batch(corpus: DataFrame, queries: DataFrame, k: int = 20, threshold: float = -1.0, exclude_self: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cosine top-k of every query vector: (query_id, id, similarity, rank). A threshold >= 0 drops lower similarities before the cut."""
    found = batch_distances(corpus, queries, "cosine", k, 1.0 - threshold if threshold >= 0 else np.inf, exclude_self, id_col, vector_col)
    return found.select("query_id", id_col, (1.0 - F.col("distance")).alias("similarity"), "rank")


def best_match(vectors: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, candidate, similarity): the most similar of a bounded set (query_id, query) for every vector; the smallest id wins ties."""
    ids, matrix = query_matrix(candidates)
    order = np.argsort(ids, kind="stable")
    shared = vectors.sparkSession.sparkContext.broadcast((ids[order], unit(matrix[order])))
    dimension = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = shared.value
        for batch in batches:
            scores = unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)) @ own.T
            best = scores.argmax(1) if batch.num_rows else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[best]), pa.array(scores[np.arange(len(best)), best])], names=[id_col, "candidate", "similarity"])

    rows = spread(vectors.select(F.col(id_col).cast("long").alias("id"), V.as_double(F.col(vector_col)).alias("v")).filter(F.size("v") == dimension))
    return rows.mapInArrow(run, f"{id_col} long, candidate long, similarity double")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay, so their similarity is 0."""
    lengths = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(lengths == 0, 1.0, lengths)


def knn_subset(corpus: DataFrame, ids: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Top-k among the rows whose id is in ``ids``."""
    return knn(corpus.join(ids.select(id_col).distinct(), id_col, "left_semi"), query, k, id_col=id_col, vector_col=vector_col)


def knn_then_threshold(corpus: DataFrame, query: Column, k: int, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Top-k first, threshold afterwards: may return fewer than k rows."""
    return knn(corpus, query, k, id_col=id_col, vector_col=vector_col).filter(F.col("similarity") >= threshold)


def knn_metric(corpus: DataFrame, query: Column, metric: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Top-k by ascending distance under the named metric."""
    return corpus.select(F.col(id_col), V.distance(metric, F.col(vector_col), query).alias("distance")).orderBy("distance", id_col).limit(k)
