"""Approximate nearest neighbours by inner product: inverted file with product-quantised residuals.

The coarse quantiser has two levels: centroids and, beyond ``FIRST_LEVEL`` of them, centroids of what remains, so that a cell is
a pair of both and the number of cells follows the square root of the rows without a larger sample. Both, and per group of
dimensions codebooks of residuals, are trained on a bounded sample of at most about ``FIT_ROWS`` vectors; every vector is
indexed. A query's score of a vector in cell c is approximated as q.c plus one table entry a code (asymmetric distance: the query is
not quantised). In each shard the best ``RERANK`` are scored exactly in double precision, and then every
candidate whose approximate score, raised by ``ERROR_MARGIN`` deviations of its own quantisation error, reaches the k-th
best of those; there is no cap, so a crowd of near-equal vectors is scored whole.

How many cells a query probes is measured on the sample: the fewest that hold ``COVERAGE`` of the
true neighbours of sampled queries. Vectors without cluster structure need many, clustered ones few.

Cells are put into shards of at most about ``SHARD_ROWS`` vectors; a larger cell, such as one with a
vector that a third of all rows repeat, is dealt over several shards by hash. Every posting is sent once, to its shard; queries
go to the shards that hold a cell they probe and stream past its postings in blocks, whose scores are
summed as matrices. Each shard returns at most k rows a query, and these meet in a per-query top k.

Defined results: vectors that are null, zero, of another dimension than most, or that hold null or non-finite
components take no part. A null id takes no part. Rows with the query's id are not candidates; a
repeated query id is one query. Equal scores rank by id. Fewer candidates than k: all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.sampling import in_fraction
from sextant.session import checkpointed

FIT_ROWS = 20_000
CODEBOOK_ROWS = 8_000
#: Centroids of the first level, at most.
FIRST_LEVEL = 1_024
GROUPS = 16
CODES = 256
COVERAGE = 0.96
CALIBRATION_QUERIES = 256
RERANK = 40
#: Standard deviations of the approximation error that a candidate may lack to be scored exactly.
ERROR_MARGIN = 2.0
SHARD_ROWS = 8_192
#: Small inputs are cut into about this many shards, so that every core has some.
SHARDS = 32
LEAST_SHARD_ROWS = 256
QUERY_BLOCK = 256
#: Candidates scored exactly at a time.
PAIRS_AT_ONCE = 1 << 15
SEED = 7


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(steps):
        own = nearest(x, centroids)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=k)
        filled = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[filled])[:-1]])
        # Empty cells start again at a vector.
        centroids = x[rng.choice(len(x), size=k)].copy()
        centroids[filled] = np.add.reduceat(x[order], starts, axis=0) / counts[filled][:, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = 0.5 * (centroids**2).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ centroids.T - half).argmax(1)
    return out


@dataclass
class Index:
    """Trained parts of the index; their size depends on the parameters, not on the data."""

    first: np.ndarray
    second: np.ndarray  # of what remains; one row of zeros where there is one level
    codebooks: np.ndarray  # groups x codes x width
    probes: int = 1
    sizes: np.ndarray | None = None  # rows of each cell

    @property
    def dimension(self) -> int:
        return self.first.shape[1]

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    @classmethod
    def train(cls, sample: np.ndarray, count: int, k: int, cells: int | None = None, groups: int = GROUPS, coverage: float = COVERAGE, seed: int = SEED) -> Index:
        """``cells``: the square root of ``count`` unless given."""
        rng = np.random.default_rng(seed)
        wanted = cells or max(1, round(math.sqrt(count)))
        first = kmeans(sample, min(FIRST_LEVEL, wanted, len(sample)), 8, rng)
        residuals = sample - first[nearest(sample, first)]
        more = min(-(-wanted // len(first)), len(sample)) if wanted > FIRST_LEVEL else 1
        second = kmeans(residuals, more, 8, rng) if more > 1 else np.zeros((1, sample.shape[1]))
        part = residuals[rng.choice(len(sample), size=min(CODEBOOK_ROWS, len(sample)), replace=False)]
        part = part - second[nearest(part, second)]
        groups = next(g for g in range(min(groups, sample.shape[1]), 0, -1) if sample.shape[1] % g == 0)
        width = sample.shape[1] // groups
        books = np.stack([kmeans(part[:, m * width : (m + 1) * width], min(CODES, len(part)), 6, rng) for m in range(groups)])
        found = cls(first, second, books)
        found.probes = found._probes(sample, k, coverage, rng)
        return found

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and residual of each vector."""
        a = nearest(x, self.first)
        left = x - self.first[a]
        if len(self.second) == 1:
            return a, left
        b = nearest(left, self.second)
        return a * len(self.second) + b, left - self.second[b]

    def coarse(self, queries: np.ndarray) -> np.ndarray:
        """Inner product of each query with each cell's centroid."""
        return ((queries @ self.first.T)[:, :, None] + (queries @ self.second.T)[:, None, :]).reshape(len(queries), -1)

    def _probes(self, sample: np.ndarray, k: int, coverage: float, rng: np.random.Generator) -> int:
        """Fewest probed cells that hold ``coverage`` of the exact neighbours of sampled queries."""
        cells = self.assign(sample)[0]
        at = rng.choice(len(sample), size=min(CALIBRATION_QUERIES, len(sample)), replace=False)
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        k = min(k, max(1, len(sample) - 1))
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        needed = []
        for q, own in zip(sample[at], top, strict=True):
            values = self.coarse(q[None])[0]
            needed.append((values[None, :] > values[cells[own]][:, None]).sum(1))
        ranks = np.sort(np.concatenate(needed))
        return int(ranks[min(len(ranks) - 1, math.ceil(coverage * len(ranks)))]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and norm of the quantisation error of each vector."""
        cells, residuals = self.assign(x)
        width = self.codebooks.shape[2]
        codes = np.stack([nearest(residuals[:, m * width : (m + 1) * width], book) for m, book in enumerate(self.codebooks)], axis=1)
        decoded = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebooks)], axis=1)
        return cells, codes.astype(np.uint8), np.sqrt(((residuals - decoded) ** 2).sum(1))

    def probed(self, queries: np.ndarray, need: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Query x cell: whether the cell is among the query's probes, which go on by rank until they hold ``need`` rows; and the least score of these."""
        scores = self.coarse(queries)
        mask = np.zeros(scores.shape, dtype=bool)
        if self.probes >= scores.shape[1]:
            mask[:] = True
        else:
            np.put_along_axis(mask, np.argpartition(-scores, self.probes - 1, axis=1)[:, : self.probes], True, axis=1)
            if need is not None:
                for i in np.flatnonzero(mask @ self.sizes < need):
                    order = np.argsort(-scores[i], kind="stable")
                    mask[i, order[: max(self.probes, int(np.searchsorted(np.cumsum(self.sizes[order]), need[i])) + 1)]] = True
        return mask, np.where(mask, scores, np.inf).min(1)


class Shard:
    """Postings of one shard, ready for blocks of queries."""

    def __init__(self, index: Index, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, codes: np.ndarray, errors: np.ndarray) -> None:
        order = np.lexsort((ids, cells))
        self.index, self.ids, self.vectors, self.codes = index, ids[order], vectors[order], codes[order].astype(np.intp)
        # Quantised vectors are shorter by their error, and products with near queries shrink with them.
        squares = (self.vectors**2).sum(1)
        self.scale = squares / np.maximum(squares - errors[order] ** 2, squares / 4)
        # The error's other part along a query has about this deviation for a query of length one.
        self.slack = (ERROR_MARGIN * self.scale * errors[order] / math.sqrt(index.dimension)).astype(np.float32)
        self.scale = self.scale.astype(np.float32)[:, None]
        self.cells, starts = np.unique(cells[order], return_index=True)
        self.bounds = np.append(starts, len(ids))

    def approximate(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Row x query: asymmetric scores, minus infinity where the query does not probe the row's cell. ``least``: coarse score of each query's last probe."""
        index, n = self.index, len(self.index.codebooks)
        width = index.codebooks.shape[2]
        tables = [np.ascontiguousarray((book @ queries[:, m * width : (m + 1) * width].T).astype(np.float32)) for m, book in enumerate(index.codebooks)]
        a, b = np.divmod(self.cells, len(index.second))
        coarse = (index.first[a] + index.second[b]) @ queries.T
        # Sums of other shapes may round otherwise.
        probed = (coarse >= (least - 1e-9 * (1 + np.abs(least)))[None, :]).T
        coarse = coarse.astype(np.float32)
        coarse[~probed.T] = -np.inf
        out = np.empty((len(self.ids), len(queries)), dtype=np.float32)
        for c, (low, high) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            asked = np.flatnonzero(probed[:, c])
            if not len(asked):
                out[low:high] = -np.inf
                continue
            own = tables if 2 * len(asked) > len(queries) or high - low < 64 else [t[:, asked] for t in tables]
            part = own[0][self.codes[low:high, 0]]
            for m in range(1, n):
                part += own[m][self.codes[low:high, m]]
            if own is tables:
                out[low:high] = part + coarse[c]
            else:
                out[low:high] = -np.inf
                out[low:high, asked] = part + coarse[c, asked]
        return np.multiply(out, self.scale, out=out)

    def exact(self, queries: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", queries[query[i : i + PAIRS_AT_ONCE]], self.vectors[row[i : i + PAIRS_AT_ONCE]]) for i in range(0, len(query), PAIRS_AT_ONCE)]
        return np.concatenate(parts) if parts else np.empty(0)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query numbers, ids, exact scores) of each query's best k among these rows."""
        scores = np.ascontiguousarray(self.approximate(queries, least).T)
        scores[query_ids[:, None] == self.ids[None, :]] = -np.inf
        depth = max(rerank, 2 * k)
        open_ = scores > -np.inf
        if scores.shape[1] > depth:
            first = np.argpartition(-scores, depth - 1, axis=1)[:, :depth]
            query = np.repeat(np.arange(len(queries)), depth)
            best = self.exact(queries, query, first.ravel()).reshape(len(queries), depth)
            best[~np.take_along_axis(open_, first, axis=1)] = -np.inf
            level = np.partition(best, depth - k, axis=1)[:, depth - k]
            reach = scores + np.linalg.norm(queries, axis=1)[:, None].astype(np.float32) * self.slack
            open_ &= reach >= level[:, None].astype(np.float32)
        query, row = np.nonzero(open_)
        values = self.exact(queries, query, row)
        order = np.lexsort((self.ids[row], -values, query))
        query, row, values = query[order], row[order], values[order]
        starts = np.searchsorted(query, np.arange(len(queries)))
        kept = np.arange(len(query)) - starts[query] < k
        return query[kept], self.ids[row[kept]], values[kept]


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


@dataclass
class Layout:
    """Where the cells' rows lie: shards from ``first`` on, ``parts`` of them; 0 parts: an empty cell."""

    first: np.ndarray
    parts: np.ndarray
    shards: int

    @classmethod
    def of(cls, sizes: np.ndarray, shard_rows: int) -> Layout:
        first, parts = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        shards, room = 0, 0
        for cell in np.flatnonzero(sizes):
            n = int(sizes[cell])
            if n > shard_rows:
                first[cell], parts[cell] = shards + (room > 0), -(-n // shard_rows)
                shards, room = int(first[cell] + parts[cell]), 0
            else:
                if room + n > shard_rows:
                    shards, room = shards + 1, 0
                first[cell], parts[cell] = shards, 1
                room += n
        return cls(first, parts, shards + (room > 0))

    def place(self, cells: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Shard of each posting; a split cell's rows are dealt by their number, so no common id or vector keeps them together."""
        return self.first[cells] + numbers % np.maximum(self.parts[cells], 1)

    def shards_of(self, probed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) of the shards that hold probed cells, each once."""
        query, cell = np.nonzero(probed & (self.parts > 0))
        n = self.parts[cell]
        shard = np.repeat(self.first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(np.repeat(query, n) * max(1, self.shards) + shard)
        return np.divmod(pairs, max(1, self.shards))


POSTING, QUERY = 0, 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, rerank: int = RERANK, cells: int | None = None) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for every query row (id, vector)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if common is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    dimension, count = common["size"], common["n"]
    rows = rows.filter(F.size("v") == dimension)
    drawn = (rows if count <= fit_rows else rows.filter(in_fraction(F.xxhash64("id", "v"), fit_rows / count))).toPandas().sort_values("id", kind="stable")
    sample = np.stack((drawn if len(drawn) else rows.limit(1).toPandas())["v"].to_list()).astype(float)
    index = Index.train(sample, count, k, cells)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, codes, errors = index.encode(_vectors(batch.column("v"), dimension))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], names=["id", "v", "cell", "codes", "error"])

    postings = checkpointed(rows.mapInArrow(encode, "id long, v array<double>, cell int, codes binary, error double"))
    # A row for each cell: the square root of the rows.
    index.sizes = np.zeros(index.cells, dtype=np.int64)
    for r in postings.groupBy("cell").agg(F.count("*").alias("n")).collect():
        index.sizes[r["cell"]] = r["n"]
    layout = Layout.of(index.sizes, min(SHARD_ROWS, max(LEAST_SHARD_ROWS, count // SHARDS)))

    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == dimension))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    # A query's own rows are no results: probes hold k rows beside them.
    own = postings.select("id").join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own")).filter("own > 1")
    asked = checkpointed(asked.join(own, "id", "left").select("id", "v", (F.coalesce("own", F.lit(1)) + k).alias("need")))
    ddl = "shard int, kind int, id long, v array<double>, cell int, codes binary, error double"

    def dispatch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                probed, least = index.probed(_vectors(part.column("v"), dimension), part.column("need").to_numpy(zero_copy_only=False))
                query, shard = layout.shards_of(probed)
                taken, n = pa.array(query), len(query)
                columns = [pa.array(shard.astype(np.int32)), pa.array(np.full(n, QUERY, dtype=np.int32)), part.column("id").take(taken), part.column("v").take(taken), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(least[query])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ddl.split(", ")])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 7_919 * TaskContext.get().partitionId()  # checkpointed rows keep their order
        for batch in batches:
            shard = layout.place(batch.column("cell").to_numpy(), number + np.arange(batch.num_rows))
            number += batch.num_rows
            columns = [pa.array(shard.astype(np.int32)), pa.array(np.full(batch.num_rows, POSTING, dtype=np.int32)), *(batch.column(c) for c in ("id", "v", "cell", "codes", "error"))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ddl.split(", ")])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, its postings first: they are held while its queries stream past."""
        held: list[pa.RecordBatch] = []
        key, shard = None, None
        for batch in batches:
            keys, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1), len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high <= low:
                    continue
                if keys[low] != key:
                    key, held, shard = keys[low], [], None
                part = batch.slice(low, high - low)
                if kinds[low] == POSTING:
                    held.append(part)
                    continue
                if shard is None and held:
                    whole = pa.Table.from_batches(held)
                    codes = np.frombuffer(b"".join(whole["codes"].to_pylist()), dtype=np.uint8).reshape(whole.num_rows, -1)
                    shard = Shard(index, whole["id"].to_numpy(), _vectors(whole["v"].combine_chunks(), dimension), whole["cell"].to_numpy(), codes, whole["error"].to_numpy())
                    held = []
                for at in range(0, part.num_rows if shard else 0, QUERY_BLOCK):
                    block = part.slice(at, QUERY_BLOCK)
                    own, ids = _vectors(block.column("v"), dimension), block.column("id").to_numpy()
                    query, found, scores = shard.search(own, ids, block.column("error").to_numpy(), k, rerank)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found), pa.array(scores)], names=["query_id", id_col, "score"])

    both = postings.mapInArrow(placed, ddl).unionByName(asked.mapInArrow(dispatch, ddl))
    # Whole shards of bounded size; no more partitions than tasks of a few shards each.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * layout.shards, 1_024), layout.shards // 16)
    found = both.repartition(partitions, "shard").sortWithinPartitions("shard", "kind").mapInArrow(within, f"query_id long, {id_col} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
