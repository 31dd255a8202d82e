"""Neighbour graphs, one a shard: approximate search by walking from near to nearer vectors.

Walking one graph is a chain of lookups that does not distribute, so the vectors are dealt over shards of bounded size by a
hash of their id, each with a layered graph of its own, and the shards' results meet in a per-query top k. Inside a shard distances come from
matrix products: the members of a layer (all at the bottom, each next one a random share of those below) are linked to the
nearest of their layer that are not closer to a neighbour chosen before, so links point in different directions; links go both ways, and
what exceeds the layer's number of links is cut by the same rule. A search goes down from the top layer's first member
and, at the bottom, keeps the ``effort`` best seen.

An id that is there already is left as it is. Null vectors and those of another dimension take no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import knn as K

# Bounds of the number of links, and defaults of links and of the widths of building and searching.
LEAST_LINKS, MOST_LINKS = 2, 100
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 200, 10

SHARD_ROWS = 8_192
SEED = 100


@dataclass(frozen=True)
class Config:
    """Graph parameters; raises ValueError where they do not fit together."""

    dimension: int
    metric: str = "l2"
    links: int = LINKS
    build_width: int = BUILD_WIDTH

    def __post_init__(self) -> None:
        if self.metric not in V.METRICS:
            raise ValueError(f"metric is one of {sorted(V.METRICS)}")
        if not LEAST_LINKS <= self.links <= MOST_LINKS:
            raise ValueError(f"links {self.links} are not in {LEAST_LINKS}..{MOST_LINKS}")
        if self.build_width < self.links:
            raise ValueError("the width of building is below the number of links")


def _diverse(candidates: np.ndarray, distance: np.ndarray, between, most: int) -> list[int]:
    """Of candidates in order of distance those that are nearer to the vector than to any chosen before, up to ``most``."""
    chosen: list[int] = []
    for c, d in zip(candidates.tolist(), distance.tolist(), strict=True):
        if len(chosen) == most:
            break
        if not chosen or (between(c, chosen) >= d).all():
            chosen.append(c)
    return chosen


def build(x: np.ndarray, config: Config, seed: int = SEED) -> list[list[list[int]]]:
    """For every row its links in each layer it belongs to, from the bottom."""
    rng = np.random.default_rng(seed)
    heights = np.floor(-np.log(rng.uniform(1e-12, 1.0, len(x))) / math.log(config.links)).astype(int)
    links: list[list[list[int]]] = [[] for _ in range(len(x))]
    own = K.unit(x) if config.metric == "cosine" else x
    for layer in range(int(heights.max(initial=-1)) + 1):
        members = np.flatnonzero(heights >= layer)
        most = 2 * config.links if layer == 0 else config.links
        width = min(config.build_width, len(members) - 1)
        between = lambda c, chosen: K.distances(config.metric, own[c][None], own[chosen])[0]
        linked: dict[int, set[int]] = {m: set() for m in members.tolist()}
        for at in range(0, len(members) if width > 0 else 0, 512):
            block = members[at : at + 512]
            d = K.distances(config.metric, own[block], own[members])
            d[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf
            near = np.argpartition(d, width - 1, axis=1)[:, :width]
            for i, m in enumerate(block.tolist()):
                order = near[i][np.lexsort((near[i], d[i, near[i]]))]
                for c in _diverse(members[order], d[i, order], between, config.links):
                    linked[m].add(c)
                    linked[c].add(m)
        for m, found in linked.items():
            candidates = np.array(sorted(found), dtype=np.int64)
            if len(candidates) > most:
                d = K.distances(config.metric, own[m][None], own[candidates])[0]
                order = np.argsort(d, kind="stable")
                kept = _diverse(candidates[order], d[order], between, most)
                # Room that the rule leaves goes to the nearest of the rest.
                kept += [c for c in candidates[order].tolist() if c not in set(kept)][: most - len(kept)]
                candidates = np.array(kept, dtype=np.int64)
            links[m].append(candidates.tolist())
    return links


def walk(x: np.ndarray, links: list, query: np.ndarray, k: int, effort: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest found. Cosine: ``x`` and ``query`` have length one."""
    far = lambda rows: K.distances(metric, query[None], x[rows])[0]
    top = max(len(own) for own in links)
    at = next(i for i, own in enumerate(links) if len(own) == top)
    best = float(far([at])[0])
    for layer in range(top - 1, 0, -1):
        while near := links[at][layer]:
            d = far(near)
            i = int(d.argmin())
            if d[i] >= best:
                break
            at, best = near[i], float(d[i])
    effort = max(effort, k)
    seen = {at}
    open_, kept = [(best, at)], [(-best, -at)]
    while open_:
        d, at = heapq.heappop(open_)
        if len(kept) >= effort and d > -kept[0][0]:
            break
        if fresh := [n for n in links[at][0] if n not in seen]:
            seen.update(fresh)
            for n, own in zip(fresh, far(fresh).tolist(), strict=True):
                if len(kept) < effort or own < -kept[0][0]:
                    heapq.heappush(open_, (own, n))
                    heapq.heappush(kept, (-own, -n))
                    if len(kept) > effort:
                        heapq.heappop(kept)
    found = sorted((-d, -n) for d, n in kept)[:k]
    return np.array([n for _, n in found], dtype=np.int64), np.array([d for d, _ in found])


def graphs(points: DataFrame, config: Config, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, place, vec_id, embedding, links) of the graphs over (vec_id, embedding)."""
    rows = points.select(F.col("vec_id").cast("long").alias("vec_id"), V.as_double(F.col("embedding")).alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") == config.dimension))
    shards = max(1, -(-rows.count() // shard_rows))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, config.dimension)
        linked = build(x, config)
        columns = {"shard": pa.array(np.full(len(x), key[0].as_py()), pa.int32()), "place": pa.array(np.arange(len(x)), pa.int32()), "vec_id": table["vec_id"], "embedding": table["embedding"], "links": pa.array(linked, pa.list_(pa.list_(pa.int32())))}
        return pa.table(columns)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, "shard int, place int, vec_id long, embedding array<double>, links array<array<int>>")


def search(index: DataFrame, queries: DataFrame, k: int, config: Config, effort: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, vec_id, distance, rank). The query set's size is checked; ``effort``: vectors kept while walking, k at least."""
    query_ids, matrix = K.query_matrix(queries)
    unit = K.unit if config.metric == "cosine" else lambda x: x
    shared = index.sparkSession.sparkContext.broadcast((query_ids, unit(matrix)))

    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        names, own = shared.value
        table = table.sort_by("place")
        x = unit(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, config.dimension))
        ids, links = table["vec_id"].to_numpy(), table["links"].to_pylist()
        found = [walk(x, links, q, k, effort, config.metric) for q in own]
        counts = [len(rows) for rows, _ in found]
        empty = [(np.empty(0, dtype=np.int64), np.empty(0))]
        return pa.table({"query_id": np.repeat(names, counts), "vec_id": ids[np.concatenate([r for r, _ in found or empty])], "distance": np.concatenate([d for _, d in found or empty])})

    near = index.groupBy("shard").applyInArrow(run, "query_id long, vec_id long, distance double")
    return K.top_per_query(near, k, "distance", descending=False)
