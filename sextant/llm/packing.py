"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Linear grouping: the lengths of large pieces are sorted and cut into groups of equal cardinality,
each rounded up to its largest length; with so few sizes the cutting-stock program over
configurations is solved by column generation, whole multiples of its configurations are laid out,
and actual pieces take the slots of their group. What is left over, and all small pieces, go in by
best fit, longest first.

Everything is planned on the histogram of lengths, which has at most ``capacity`` rows whatever the
input holds: a plan says that the pieces of a length with ranks from a to b go to the sequences
from s on, at one offset. Ranks within a length come from hash buckets
(``bucket_count``), so a length that a third of all pieces share is ranked by many tasks.

Defined results: null or empty text is one piece, the end token alone. Documents longer than the
capacity are cut from their end into full pieces, the first piece may be shorter. Repeated rows are
packed once each. No rows: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import ROWS_PER_BUCKET, bucket_count
from sextant.llm.tokens import encoder
from sextant.session import checkpointed, spread

CAPACITY = 2048
END_TOKEN = 0
GROUPS = 192
#: Pieces of more than capacity / SMALL_PART are grouped; smaller ones are best-fitted.
SMALL_PART = 3
COLUMN_STEPS = 3_000
_TOLERANCE = 1e-9


def piece_bounds(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: (id, piece, start, length, ids_crc32), with their ids if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_TOKEN], dtype="<u4")
                for number, (begin, size) in enumerate(piece_bounds(len(ids), capacity)):
                    own = ids[begin : begin + size]
                    at.append(i)
                    piece.append(number)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        kept.append(own)
            columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([k.astype(np.int64) for k in kept], pa.list_(pa.int32())) if kept else pa.array([], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, ddl)


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Multiset of sizes within the capacity whose values sum highest: layered knapsack, an item a layer."""
    room = np.arange(capacity + 1)
    source = room[None, :] - sizes[:, None]
    open_ = source >= 0
    source = np.where(open_, source, 0)
    best, choices = np.zeros(capacity + 1), []
    while True:
        gain = np.where(open_, best[source] + values[:, None], -1.0)
        pick = gain.argmax(0)
        top = gain[pick, room]
        better = top > best + 1e-12
        if not better.any():
            break
        choices.append((np.where(better, pick, -1)))
        best = np.where(better, top, best)
    count, at = np.zeros(len(sizes), dtype=np.int64), capacity
    for pick in reversed(choices):
        if pick[at] >= 0:
            count[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(count @ values), count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = COLUMN_STEPS) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of the configurations of a basic solution of the cutting-stock program."""
    basis = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(basis)
    for _ in range(steps):
        values = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = _best_configuration(sizes, np.maximum(values, 0.0), capacity)
        if worth <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(direction > _TOLERANCE, x / np.maximum(direction, _TOLERANCE), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * direction, 0.0)
        x[out] = step
        basis[:, out] = column
    return [(basis[:, i].round().astype(np.int64), int(np.floor(x[i] + 1e-6))) for i in np.argsort(-x, kind="stable")]


@dataclass
class Bins:
    """``count`` alike sequences that hold pieces of these lengths."""

    lengths: tuple[int, ...]
    count: int


class Queue:
    """Lengths of a group, longest first, as runs; taken from either end."""

    def __init__(self, runs: list[list[int]]) -> None:
        self.runs = runs

    def take(self, count: int, from_back: bool) -> list[tuple[int, int]]:
        found = []
        while count and self.runs:
            run = self.runs[-1 if from_back else 0]
            n = min(count, run[1])
            found.append((run[0], n))
            run[1] -= n
            count -= n
            if not run[1]:
                self.runs.pop(-1 if from_back else 0)
        return found

    def size(self) -> int:
        return sum(n for _, n in self.runs)


def _merge(slots: list[list[tuple[int, int]]]) -> list[Bins]:
    """Side by side runs of like total count to blocks of alike bins."""
    found, at, left = [], [0] * len(slots), [runs[0][1] for runs in slots]
    while True:
        n = min(left)
        found.append(Bins(tuple(runs[i][0] for runs, i in zip(slots, at, strict=True)), n))
        for k, runs in enumerate(slots):
            left[k] -= n
            if not left[k]:
                at[k] += 1
                if at[k] == len(runs):
                    return found
                left[k] = runs[at[k]][1]


def lay_out(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Bins]:
    """All pieces of the histogram in blocks of alike sequences."""
    bins = [Bins((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    large = [[n, histogram[n]] for n in sorted(histogram, reverse=True) if capacity // SMALL_PART < n < capacity and histogram[n] > 0]
    rest = {n: c for n, c in histogram.items() if n <= capacity // SMALL_PART and c > 0}
    total = sum(c for _, c in large)
    queues: list[Queue] = []
    if total >= 2 * groups:
        share, filled = total / groups, 0.0
        for n, c in large:  # a run of one length may lie in several groups
            while c:
                if not queues or filled >= share - 1e-6:
                    queues.append(Queue([]))
                    filled = 0.0
                part = min(c, max(1, int(round(share - filled))))
                queues[-1].runs.append([n, part])
                filled += part
                c -= part
        sizes: dict[int, list[Queue]] = {}
        for q in queues:
            sizes.setdefault(q.runs[0][0], []).append(q)
        rounded = np.array(list(sizes))
        merged = [Queue([run for q in own for run in q.runs]) for own in sizes.values()]
        for column, count in configurations(rounded, np.array([q.size() for q in merged], dtype=float), capacity):
            chosen = [i for i, n in enumerate(column) for _ in range(n)]
            # Rounded demand is met exactly or overshot: no more of a configuration than its groups still hold.
            count = min([count, *(merged[i].size() // int(column[i]) for i in set(chosen))])
            if count and chosen:
                bins += _merge([merged[i].take(count, k % 2 == 1) for k, i in enumerate(chosen)])
        for q in merged:
            for n, c in q.runs:
                rest[n] = rest.get(n, 0) + c
    else:
        for n, c in large:
            rest[n] = rest.get(n, 0) + c
    return best_fit(bins, rest, capacity)


def best_fit(bins: list[Bins], rest: dict[int, int], capacity: int) -> list[Bins]:
    """Adds the pieces of ``rest``, longest first, each to the fullest sequence that has room."""
    by_room: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for b in bins:
        by_room[capacity - sum(b.lengths)].append(b)
    open_ = np.array([bool(own) for own in by_room])
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            room = length + int(open_[length:].argmax()) if open_[length:].any() else 0
            if room:
                b = by_room[room].pop()
                open_[room] = bool(by_room[room])
                # The same sequence stays the fullest that has room, until it has none.
                each = min(room // length, left)
                n = min(b.count, left // each)
                if n < b.count:
                    by_room[room].append(Bins(b.lengths, b.count - n))
                    open_[room] = True
            else:
                each = min(capacity // length, left)
                n, room, b = left // each, capacity, Bins((), 0)
            new = room - each * length
            by_room[new].append(Bins(b.lengths + (length,) * each, n))
            open_[new] = True
            left -= n * each
    return [b for own in by_room for b in own]


def plan(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Slots by length: pieces with ranks from ``start`` go to sequences from ``sequence`` on, at ``offset``."""
    rows, sequence, used = [], 0, {}
    for b in bins:
        offset = 0
        for n in b.lengths:
            start = used.get(n, 0)
            rows.append((n, start, sequence, offset))
            used[n] = start + b.count
            offset += n
        sequence += b.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "start": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def ranked(pieces: DataFrame, histogram: DataFrame) -> DataFrame:
    """Adds each piece's rank among the pieces of its length, from 0."""
    # At most `capacity` rows, so the broadcast is bounded.
    counts = F.broadcast(histogram.withColumnRenamed("length", "own_length"))
    spread = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), bucket_count(F.col("n"), ROWS_PER_BUCKET))
    bucketed = pieces.join(counts, F.col("length") == F.col("own_length")).drop("own_length").withColumn("bucket", spread).drop("n")
    sums = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("length").alias("own_length"), F.col("bucket").alias("own_bucket"), before.alias("before"))
    joined = bucketed.join(offsets, (F.col("length") == F.col("own_length")) & (F.col("bucket") == F.col("own_bucket"))).drop("own_length", "own_bucket")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32"))
    return joined.withColumn("rank", F.col("before") + rank - 1).drop("before", "bucket")


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces with their place: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    pieces = checkpointed(tokenise(docs, capacity, id_col, text_col, tokenizer, with_ids))
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in histogram.collect()}
    table = plan(lay_out(counts, capacity, groups))
    rank_range = max(1, max(counts.values(), default=0))
    keys = table["length"] * rank_range + table["start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * rank_range + rank, "right") - 1
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns["sequence_id"] = pa.array(table["sequence"][at] + rank - table["start"][at])
            columns["offset"] = pa.array(table["offset"][at])
            yield pa.RecordBatch.from_pydict(columns)

    found = ranked(pieces, histogram)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "rank"] + ["sequence_id long", "offset long"])
    return found.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
