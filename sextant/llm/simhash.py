"""SimHash near-duplicates by a forest of vantage-point trees over Hamming distance.

Fingerprints of whole texts are 64 bits from 3-word shingles; documents link at two or fewer
differing bits, and linked documents form classes. Only distinct fingerprints are searched, so
exact copies never meet each other.

Two fingerprints within two bits are within one bit in at least one of their 32-bit halves. Each
half has a vantage-point tree: an inner node holds a vantage point v and a radius r, and sends a
fingerprint x inside if d(x, v) <= r, else outside. By the triangle inequality a partner at distance
one on the other side exists only if d(x, v) is r or r + 1, so all other branches are pruned; an inside
fingerprint at exactly r is also sent outside, so that both sides of such a pair share a shard. Leaves are the shards. As a fingerprint
has 8 bytes, a shard may hold hundreds of thousands: inside its task it grows trees of its own, first over the same half, then, where that
half tells its members no further apart, over the other one at distance two, down to groups that are compared exactly (on
all 64 bits). It returns a spanning forest of the links instead of all pairs. The shards' trees are grown on a sample of
``SAMPLED_PER_LEAF`` fingerprints a leaf, and leaves follow the number of rows; every fingerprint is routed.

Classes come from alternating star contractions over the links, checkpointed every round; no link or
fingerprint table is collected.

Defined results: null and empty texts have fingerprint zero and link like any other. Rows of equal
id are one document. A row with a null id belongs to its class without naming it. No rows: no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import quoted
from sextant.operators.graph import components
from sextant.operators.sampling import bounded_sample
from sextant.session import checkpointed, spread

SHINGLE = 3
MOST_BITS = 2
SEED = 42
#: Aimed-at fingerprints of a shard and of a group inside it, and sampled fingerprints a leaf.
SHARD_ROWS = 32_768
GROUP_ROWS = 1_000
SAMPLED_PER_LEAF = 64
#: Sampled fingerprints a leaf of a tree inside a task, which costs no transport.
SAMPLED_INSIDE = 256
_CHUNK = 1 << 16
_HALF = np.uint64(0xFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """SimHash of a text as an unsigned 64-bit number: bit set if set in over half the shingle hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six white space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[: -SHINGLE]]).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fingerprints as signed longs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.view(np.int64))], names=["id", "fp"])

    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, fp long")


@dataclass
class Tree:
    """A vantage-point tree over one half of the bits. Children: a node's number, or -1 - leaf."""

    shift: int
    points: list[int] = field(default_factory=list)
    radii: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    leaves: int = 0

    def half(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.shift)) & _HALF

    @classmethod
    def grow(cls, sample: np.ndarray, shift: int, leaf_rows: int, rng: np.random.Generator) -> Tree:
        tree = cls(shift)
        todo = [(tree.half(sample), None, False)]
        while todo:
            own, parent, is_inside = todo.pop()
            number = None
            if len(own) > leaf_rows:
                # Of a few candidates, the point and radius that split evenly with the fewest values at the border.
                best = None
                for point in rng.choice(own, size=min(6, len(own)), replace=False):
                    counts = np.bincount(np.bitwise_count(own ^ point), minlength=33)[:33]
                    below = np.cumsum(counts)[:-1]
                    cost = np.maximum(below, len(own) - below) + counts[:-1]
                    r = int(cost.argmin())
                    if best is None or cost[r] < best[0]:
                        best = cost[r], int(point), r
                if best[0] < 0.95 * len(own):
                    number = len(tree.points)
                    tree.points.append(best[1])
                    tree.radii.append(best[2])
                    tree.inside.append(0)
                    tree.outside.append(0)
                    d = np.bitwise_count(own ^ np.uint64(best[1]))
                    todo += [(own[d >= best[2] + 1], number, False), (own[d <= best[2]], number, True)]
            if number is None:
                number = -1 - tree.leaves
                tree.leaves += 1
            if parent is not None:
                (tree.inside if is_inside else tree.outside)[parent] = number
        return tree

    def route(self, fps: np.ndarray, most_bits: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a fingerprint belongs to, for partners within ``most_bits`` of this half."""
        if not self.points:
            return np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        half = self.half(fps)
        points, radii = np.array(self.points, dtype=np.uint64), np.array(self.radii)
        inside, outside = np.array(self.inside), np.array(self.outside)
        rows, at = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        done_rows, done_leaves = [], []
        while len(rows):
            d = np.bitwise_count(half[rows] ^ points[at]).astype(np.int64)
            r = radii[at]
            into, out = d <= r, d > r - most_bits  # at the border: both
            rows, at = np.concatenate([rows[into], rows[out]]), np.concatenate([inside[at[into]], outside[at[out]]])
            leaf = at < 0
            done_rows.append(rows[leaf])
            done_leaves.append(-1 - at[leaf])
            rows, at = rows[~leaf], at[~leaf]
        return np.concatenate(done_rows), np.concatenate(done_leaves)


def spanning_links(fps: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links between distinct fingerprints that connect all that pairs of at most ``most_bits`` connect.

    The search first leaves out what has no partner at all, then spreads from fingerprint to fingerprint, so its output is below
    the number of fingerprints even where all of them are alike.
    """
    has = np.zeros(len(fps), dtype=bool)
    step = max(1, 2_000_000 // max(1, len(fps)))
    for at in range(0, len(fps), step):
        near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= most_bits
        near[np.arange(near.shape[0]), at + np.arange(near.shape[0])] = False
        has[at : at + step] = near.any(1)
    links: list[tuple[int, int]] = []
    unseen = fps[has]
    while len(unseen):
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            x = queue.pop()
            near = np.bitwise_count(unseen ^ x) <= most_bits
            links += [(int(x), int(y)) for y in unseen[near]]
            queue += list(unseen[near])
            unseen = unseen[~near]
    return links


def group_links(fps: np.ndarray, shift: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Links of a shard of the half at ``shift``: spanning what pairs within one bit of that half, two in all, connect."""
    found: list[tuple[int, int]] = []
    todo = [(fps, True)]
    while todo:
        own, same_half = todo.pop()
        if len(own) <= GROUP_ROWS:
            found += spanning_links(own)
            continue
        leaves = -(-len(own) // GROUP_ROWS)
        sample = own if len(own) <= SAMPLED_INSIDE * leaves else rng.choice(own, size=SAMPLED_INSIDE * leaves, replace=False)
        tree = Tree.grow(sample, shift if same_half else 32 - shift, max(1, len(sample) // leaves), rng)
        if not tree.points:
            if same_half:
                todo.append((own, False))
            else:
                found += spanning_links(own)
            continue
        rows, leaf = tree.route(own, 1 if same_half else 2)
        order = np.argsort(leaf, kind="stable")
        rows, cuts = rows[order], np.flatnonzero(np.diff(leaf[order])) + 1
        for part in np.split(own[rows], cuts):
            if len(part) <= GROUP_ROWS:
                found += spanning_links(part)
            elif len(part) <= 0.95 * len(own):
                todo.append((part, same_half))
            elif same_half:
                todo.append((part, False))
            else:
                found += spanning_links(part)
    return found


def forest(distinct: DataFrame, count: int) -> list[Tree]:
    """One tree for each half of the bits, grown on a sample of the fingerprints: a few for each shard."""
    leaves = max(1, count // SHARD_ROWS)
    if leaves == 1:
        return [Tree(shift, leaves=1) for shift in (0, 32)]
    sampled = bounded_sample(distinct.select("fp"), F.col("fp"), SAMPLED_PER_LEAF * leaves)
    sample = np.sort(sampled.toArrow()["fp"].to_numpy()).view(np.uint64)
    rng = np.random.default_rng(SEED)
    return [Tree.grow(sample, shift, max(1, len(sample) // leaves), rng) for shift in (0, 32)]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a > b: links that span the classes of the distinct fingerprints ``fp``."""
    spark = distinct.sparkSession
    count = distinct.count()
    trees = forest(distinct, count)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for number, tree in enumerate(trees):
                rows, leaf = tree.route(fps)
                yield pa.RecordBatch.from_arrays([pa.array(fps[rows].view(np.int64)), pa.array(leaf * len(trees) + number)], names=["fp", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: a shard is complete when the next one begins."""
        held: list[np.ndarray] = []
        key = None

        def found() -> pa.RecordBatch:
            out = group_links(np.concatenate(held), trees[key % len(trees)].shift, np.random.default_rng(SEED))
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.max(1)), pa.array(pairs.min(1))], names=["a", "b"])

        for batch in batches:
            fps, shard = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("shard").to_numpy(zero_copy_only=False)
            for a, b in itertools.pairwise([0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(fps)]):
                if b <= a:
                    continue
                if key is not None and key != shard[a]:
                    yield found()
                    held.clear()
                key = int(shard[a])
                held.append(fps[a:b])
        if held:
            yield found()

    # More partitions than the session's if shards are many: each holds whole shards.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // (4 * SHARD_ROWS))
    ordered = distinct.select("fp").mapInArrow(route, "fp long, shard long").repartition(partitions, "shard").sortWithinPartitions("shard")
    return ordered.mapInArrow(search, "a long, b long").distinct()


def _classes(own: DataFrame) -> DataFrame:
    """(fp, component_id, root) of the distinct fingerprints of (id, fp) rows."""
    distinct = checkpointed(own.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(names, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; the class is named by its smallest id."""
    own = checkpointed(fingerprints(docs, id_col, text_col))
    return own.join(_classes(own), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, one with its smallest id, with the columns of ``docs``.

    Every class keeps one row: of several rows of its smallest id, which may differ in text, that with the least hash of the text; a class
    of null ids alone keeps such a row too.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    # Fingerprints travel with the text's hash, so a repeated id with different texts stays apart.
    marked = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")).alias("key"), F.col(text_col).alias("text"))
    keyed = checkpointed(fingerprints(marked, "key", "text").select("id.id", "id.hash", "fp"))
    counted = keyed.groupBy("fp", "id", "hash").agg(F.count("*").alias("rows"))
    best = counted.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "rows")).alias("best"))
    kept = best.join(_classes(keyed.select("id", "fp")), "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.id").alias("own_id"), F.col("best.hash").alias("own_hash"), "best.rows")
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")))
    # Only rows that repeat id and text meet in the second part.
    return found.filter("rows = 1").select("row").unionByName(found.filter("rows > 1").dropDuplicates(["own_id", "own_hash"]).select("row")).select("row.*")
