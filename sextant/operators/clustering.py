"""Density clustering, centroids and entities over embeddings.

Vectors within a distance are found by block pairs: rows are dealt to hash blocks of bounded size, and every
pair of blocks is one task of matrix products. Clustering goes over the block pairs twice. The first time they give every point's number of
neighbours, which tells the core points; the second time links that span what core points connect, and for a border point one link to
each group of connected core points it touches. So a dense cluster of n points gives about n links a block pair, not n^2 pairs. The
rest is relational: connected components of core points, border assignment. ``eps_join`` gives the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators.graph import components
from sextant.session import checkpointed

# Neighbourhood of the clustering, entity threshold and first id of single entities.
EPS = 0.45
MIN_POINTS = 2
SAME_ENTITY_BELOW = 0.45
FIRST_NOISE_ENTITY = 10_000

BLOCK_ROWS = 4_096
NOISE = -1


def _in_block_pairs(rows: DataFrame, run: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.Table]], ddl: str) -> DataFrame:
    """``run`` on every pair of hash blocks of the rows (id, v, ...): its rows, and the places of the left and the right block (the same twice where a block meets itself)."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")
    empty = pa.table({name: pa.array([], kind) for name, kind in ((part.split()[0], _TYPES[part.split()[1]]) for part in ddl.split(", "))})

    def of_pair(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (k.as_py() for k in key)
        block = table["own"].to_numpy()
        left, right = (np.flatnonzero(block == low), np.flatnonzero(block == high))
        return pa.concat_tables([empty, *run(table, left, right)])

    return dealt.groupBy("low", "high").applyInArrow(of_pair, ddl)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def _near(table: pa.Table, left: np.ndarray, right: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left places, distances to the right places, whether they are within ``eps``) a few rows at a time; a row is not near its own id."""
    ids, x = table["id"].to_numpy(), np.array(table["v"].to_pylist(), dtype=float)
    for at in range(0, len(left) if len(right) else 0, 512):
        part = left[at : at + 512]
        d = 1.0 - x[part] @ x[right].T
        yield part, d, (d <= eps) & (ids[part, None] != ids[right][None, :])


def _vectors(points: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return points.select(F.col(id_col).cast("long").alias("id"), V.as_double(F.col(vector_col)).alias("v")).filter(F.col("v").isNotNull())


def eps_join(points: DataFrame, eps: float = EPS, id_col: str = "face_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, distance) with a < b of all pairs whose 1 - inner product is at most ``eps``."""

    def run(table: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[pa.Table]:
        ids = table["id"].to_numpy()
        same = len(left) and len(right) and left[0] == right[0]
        for part, d, near in _near(table, left, right, eps):
            i, j = np.nonzero(near & (ids[part, None] < ids[right][None, :]) if same else near)
            a, b = ids[part[i]], ids[right[j]]
            yield pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": d[i, j]})

    return _in_block_pairs(_vectors(points, id_col, vector_col), run, "a long, b long, distance double")


def neighbour_counts(points: DataFrame, eps: float = EPS, id_col: str = "face_id", vector_col: str = "embedding") -> DataFrame:
    """(id, neighbours) of the points with others in reach; no pairs arise."""

    def run(table: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[pa.Table]:
        ids, n = table["id"].to_numpy(), np.zeros(table.num_rows, dtype=np.int64)
        same = len(left) and len(right) and left[0] == right[0]
        for part, _, near in _near(table, left, right, eps):
            n[part] += near.sum(1)
            if not same:
                n[right] += near.sum(0)
        yield pa.table({"id": ids[n > 0], "n": n[n > 0]})

    return _in_block_pairs(_vectors(points, id_col, vector_col), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("neighbours"))


def spanning_links(points: DataFrame, core: DataFrame, eps: float = EPS, id_col: str = "face_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, border): links that connect all core points (id) that pairs within ``eps`` connect (border 0), and from border points a to core points b (border 1)."""

    def run(table: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[pa.Table]:
        ids, is_core = table["id"].to_numpy(), table["core"].to_numpy() == 1
        nodes = np.unique(np.concatenate([left, right]))
        place = np.full(table.num_rows, -1)
        place[nodes] = np.arange(len(nodes))
        # Whether two of the pair's rows are near, as bits: a few MB.
        adjacent = np.zeros((len(nodes), len(nodes)), dtype=bool)
        for part, _, near in _near(table, left, right, eps):
            adjacent[np.ix_(place[part], place[right])] |= near
        adjacent |= adjacent.T
        own_core = is_core[nodes]
        group = np.full(len(nodes), -1)
        unseen, links = own_core.copy(), []
        for start in np.flatnonzero(own_core):
            if not unseen[start]:
                continue
            unseen[start], group[start] = False, start
            todo = [start]
            while todo:
                at = todo.pop()
                fresh = np.flatnonzero(adjacent[at] & unseen)
                unseen[fresh], group[fresh] = False, start
                links += [(at, n) for n in fresh.tolist()]
                todo += fresh.tolist()
        if links:
            pairs = ids[nodes[np.array(links)]]
            yield pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "border": pa.array(np.zeros(len(pairs), dtype=np.int32))})
        border, cores = np.flatnonzero(~own_core), np.flatnonzero(own_core)
        for at in range(0, len(border) if len(cores) else 0, 512):
            i, j = np.nonzero(adjacent[np.ix_(border[at : at + 512], cores)])
            touched = np.unique(np.column_stack([border[at + i], group[cores[j]]]), axis=0)
            yield pa.table({"a": ids[nodes[touched[:, 0]]], "b": ids[nodes[touched[:, 1]]], "border": pa.array(np.ones(len(touched), dtype=np.int32))})

    rows = _vectors(points, id_col, vector_col).join(core.select("id", F.lit(1).alias("core")), "id", "left").withColumn("core", F.coalesce("core", F.lit(0)))
    return _in_block_pairs(rows, run, "a long, b long, border int")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def core_points(pairs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(id, neighbours) of the points with at least ``min_points`` others in reach; the point itself does not count."""
    return both_ways(pairs).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("neighbours")).filter(F.col("neighbours") >= min_points)


def dbscan(points: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS, id_col: str = "face_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster_id): clusters numbered from 0 by their first core point in id order, noise -1.

    A border point goes to the lowest numbered cluster with a core point in reach.
    """
    core = checkpointed(neighbour_counts(points, eps, id_col, vector_col).filter(F.col("neighbours") >= min_points).select("id"))
    links = checkpointed(spanning_links(points, core, eps, id_col, vector_col))
    roots = core.join(components(links.filter("border = 0")), F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    # One row for each cluster; its number is its place among the roots, which are the clusters' first core points.
    numbers = roots.select("root").distinct().withColumn("cluster_id", F.row_number().over(Window.orderBy("root")) - 1)
    clustered = checkpointed(roots.join(numbers, "root").select("id", "cluster_id"))
    border = links.filter("border = 1").join(clustered.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    found = clustered.unionByName(border)
    return points.select(F.col(id_col)).join(found.withColumnRenamed("id", "id_"), F.col(id_col) == F.col("id_"), "left").select(id_col, F.coalesce("cluster_id", F.lit(NOISE)).cast("int").alias("cluster_id"))


def centroids(members: DataFrame, key: str = "cluster_id", vector_col: str = "embedding") -> DataFrame:
    """(key, n, centroid): mean of the vectors scaled to length one; a single vector as it is. Means are combined before the shuffle."""
    values = members.select(F.col(key), F.posexplode(V.as_double(F.col(vector_col))).alias("pos", "x"))
    means = values.groupBy(key, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    vectors = means.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return vectors.select(key, "n", F.when(F.col("n") == 1, F.col("c.x")).otherwise(V.normalise(F.col("c.x"))).alias("centroid"))


def entities(faces: DataFrame) -> DataFrame:
    """Persons of clustered faces (face_id, image_id, embedding, confidence, cluster_id, person_label, thumbnail).

    One row for each cluster, and one for each noise face with ids from ``FIRST_NOISE_ENTITY`` in face order: person_id, label (first
    non-empty in face order), face_count, cover_face (most confident with a thumbnail), centroid.
    Faces are not collected: ``members`` lists them.
    """
    named = members(faces)
    label = F.min(F.when(F.trim("person_label") != "", F.struct("face_id", "person_label")))["person_label"]
    cover = F.max(F.when(F.col("thumbnail").isNotNull(), F.struct("confidence", (-F.col("face_id")).alias("back"))))["back"]
    summary = named.groupBy("person_id").agg(label.alias("label"), F.count("*").alias("face_count"), (-cover).alias("cover_face"))
    return summary.join(centroids(named, "person_id").select("person_id", "centroid"), "person_id")


def members(faces: DataFrame) -> DataFrame:
    """Faces with their person_id."""
    # Noise numbers follow face order over all noise faces: per-bucket counts give offsets, rows are ranked inside a bucket.
    noise = faces.filter(F.col("cluster_id") == NOISE).withColumn("bucket", F.floor(F.col("face_id") / BLOCK_ROWS))
    counts = noise.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = noise.join(counts.withColumn("before", before).drop("n"), "bucket").withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("face_id")))
    single = ranked.withColumn("person_id", FIRST_NOISE_ENTITY + F.col("before") + F.col("rank") - 1).drop("bucket", "before", "rank")
    return faces.filter(F.col("cluster_id") != NOISE).withColumn("person_id", F.col("cluster_id").cast("long")).unionByName(single)


def label_faces(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Faces whose person has a new label (person_id, label) take it over."""
    joined = faces.join(labels.withColumnRenamed("label", "new_label"), "person_id", "left")
    return joined.withColumn("person_label", F.coalesce("new_label", "person_label")).drop("new_label")


def merge_entities(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Faces of persons merged by (from_id, to_id)."""
    joined = faces.join(mapping, F.col("person_id") == F.col("from_id"), "left")
    return joined.withColumn("person_id", F.coalesce("to_id", "person_id")).drop("from_id", "to_id")


def nearest_centroid(vectors: DataFrame, centroid_rows: DataFrame, threshold: float = SAME_ENTITY_BELOW, id_col: str = "face_id", key: str = "cluster_id", vector_col: str = "embedding", most: int = 10_000) -> DataFrame:
    """(id, key, distance) of the nearest centroid strictly below the threshold; null key and distance if there is none.

    The centroid side is counted before it is broadcast.
    """
    if centroid_rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centroids; use the inverted-file index")
    # One bounded array of centroids beside each vector: no pair rows arise.
    packed = centroid_rows.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("centroid").alias("c")))).alias("all_"))
    distance = F.transform("all_", lambda s: F.struct(V.ip_distance(F.col(vector_col), s["c"]).alias("d"), s["k"].alias("k")))
    best = vectors.join(F.broadcast(packed)).select(id_col, F.array_min(distance).alias("best"))
    near = F.col("best.d") < threshold
    return best.select(id_col, F.when(near, F.col("best.k")).alias(key), F.when(near, F.col("best.d")).alias("distance"))


def search_by_label(faces: DataFrame, part: str) -> DataFrame:
    """Distinct images of persons whose label contains a text in any case; each scores 1."""
    found = faces.filter(F.contains(F.lower("person_label"), F.lit(part.lower())))
    return found.select("image_id").distinct().withColumn("similarity", F.lit(1.0))


def images_of(faces: DataFrame) -> DataFrame:
    """(person_id, image_id) distinct, with the first face, whose order the images follow."""
    return faces.groupBy("person_id", "image_id").agg(F.min("face_id").alias("first_face"))


def by_face_count(persons: DataFrame) -> DataFrame:
    return persons.orderBy(F.desc("face_count"), "person_id")


def display_name(label, cluster):
    """Label, else a numbered name, else none."""
    return F.when(F.trim(label) != "", label).when(cluster.isNotNull() & (cluster >= 0), F.concat(F.lit("Person "), cluster.cast("string")))
