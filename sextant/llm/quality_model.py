"""Quality classifier: random Fourier features of document statistics, ridge and isotonic calibration.

``z(x) = sqrt(2/D) cos(Wx + b)`` with Gaussian W approximates a Gaussian kernel over standardised
statistics of the whole text. Each partition of the labelled rows sums its part of the normal
equations (one D x D matrix), the sums meet in one ridge solution, and an isotonic fit on rows that
the ridge did not see turns raw scores into probabilities of label 1, interpolated between steps.

Fitting uses at most about ``FIT_ROWS`` labelled rows, chosen by a hash of the id; scoring streams
over every row and the whole text, without a shuffle. Scores depend on the text alone.

Defined results: null and empty texts are scored from their (zero) statistics. Repeated rows keep
their rows. With no labelled rows of both classes every score is the share of label 1 among them
(0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import quoted
from sextant.llm.textstats import FIELDS, feature_matrix, stats_columns, with_stats
from sextant.operators.sampling import bounded_sample
from sextant.session import checkpointed, spread

FIT_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-3
SEED = 20240131
#: The labelled rows' normal equations are summed in this many partitions.
FIT_PARTITIONS = 8
KEEP_FROM = 0.7


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows of fold 2 are held out."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


@dataclass
class Projection:
    """Standardisation and random Fourier features."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, seed: int = SEED) -> Projection:
        rng = np.random.default_rng(seed)
        width = len(mean) ** 0.5
        return cls(mean, np.where(std > 1e-9, std, 1.0), rng.normal(size=(len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.std, -8, 8)
        z = np.cos(scaled @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        # The statistics themselves join the random features, so that the far tails keep a direction.
        return np.hstack([z, scaled / 8, np.ones((len(x), 1))])


@dataclass
class Isotonic:
    """Non-decreasing fit. Each step rises by half of the gap to its nearer neighbour (0 and 1 beside the last), so that rows of a step keep their order."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, label: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for x, y in zip(raw[order].tolist(), label[order].tolist(), strict=True):
            if blocks and blocks[-1][3] == x:
                blocks[-1][0] += y
                blocks[-1][1] += 1
            else:
                blocks.append([y, 1.0, x, x])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                y1, n1, _, high = blocks.pop()
                blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + n1, blocks[-1][2], high]
        # (total + 1/2) / (n + 1): no step is certain on few rows. A step that this puts under the one before joins it.
        merged: list[tuple[float, float, float]] = []
        for total, n, low, high in blocks:
            level = (total + 0.5) / (n + 1)
            if merged and level <= merged[-1][0]:
                merged[-1] = merged[-1][0], merged[-1][1], high
            else:
                merged.append((level, low, high))
        steps = np.array([m[0] for m in merged])
        around = np.concatenate([[0.0], steps, [1.0]])
        rise = np.minimum(steps - around[:-2], around[2:] - steps) / 4
        at, value = [], []
        for (middle, low, high), up in zip(merged, rise, strict=True):
            at += [low, high] if high > low else [low]
            value += [middle - up, middle + up] if high > low else [middle]
        return cls(np.array(at), np.array(value))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.value)


@dataclass
class QualityModel:
    projection: Projection | None
    ridge: np.ndarray | None
    calibration: Isotonic | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.projection is None:
            return np.full(len(x), self.constant)
        return np.clip(self.calibration(self.projection(x) @ self.ridge), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return feature_matrix({n: batch.column(n).to_numpy(zero_copy_only=False) for n in FIELDS})


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, q = 0, 0.0, 0.0
    for batch in batches:
        x = _matrix(batch)
        n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "q": [q.tolist()]})


def _normal_equations(projection: Projection):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = moment = None
        for batch in batches:
            z, y = projection(_matrix(batch)), batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            gram = z.T @ z + (0 if gram is None else gram)
            moment = z.T @ y + (0 if moment is None else moment)
        if gram is not None:
            yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "moment": [moment.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> QualityModel:
    """Fits on labelled rows outside fold 2: the ridge on folds 0 and 3, the calibration on fold 1."""
    clean = labels.select(F.col("doc_id").alias(id_col), "quality").dropna().filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 2))
    chosen = bounded_sample(clean.groupBy(id_col).agg(F.min("quality").alias("quality")), F.col(id_col), fit_rows, seed=1)
    stats = checkpointed(with_stats(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)).withColumn("fold", fold(F.col(id_col))))
    # Few partitions, so that few matrices come to the driver however many files the sample was read from.
    ridge_rows, calibration_rows = stats.filter("fold != 1").coalesce(FIT_PARTITIONS), stats.filter("fold = 1").coalesce(FIT_PARTITIONS)
    counts = {r["quality"]: r["n"] for r in stats.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    held = {r["quality"] for r in ridge_rows.select("quality").distinct().collect()} & {r["quality"] for r in calibration_rows.select("quality").distinct().collect()}
    if held != {0, 1}:
        return QualityModel(None, None, None, counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    parts = ridge_rows.mapInArrow(_moments, "n long, s array<double>, q array<double>").collect()
    n, s, q = sum(p.n for p in parts), sum(np.array(p.s) for p in parts), sum(np.array(p.q) for p in parts)
    projection = Projection.draw(s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)), seed=seed)
    sums = ridge_rows.mapInArrow(_normal_equations(projection), "gram binary, moment binary").collect()
    moment = sum(np.frombuffer(p.moment) for p in sums)
    gram = sum(np.frombuffer(p.gram) for p in sums).reshape(len(moment), -1)
    ridge = np.linalg.solve(gram + RIDGE * n * np.eye(len(moment)) / len(moment), moment)
    got = calibration_rows.select("quality", *FIELDS).toPandas()
    raw = projection(feature_matrix({k: got[k].to_numpy() for k in FIELDS})) @ ridge
    return QualityModel(projection, ridge, Isotonic.fit(raw, got["quality"].to_numpy(dtype=float)))


def _scored(docs: DataFrame, model: QualityModel, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as k0, k1, ..., then score and predicted."""
    fields = [docs.schema[c] for c in keep]
    names = [f"k{i}" for i in range(len(keep))]
    own = names[keep.index(text_col)] if text_col in keep else "text"
    chosen = docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, names, strict=True)], *([] if own != "text" else [F.col(quoted(text_col)).alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(FIELDS, stats_columns(batch.column(own)), strict=True))
            x = feature_matrix({k: v.to_numpy(zero_copy_only=False) for k, v in columns.items()})
            p = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(p), pa.array((p >= KEEP_FROM).astype(np.int32))], names=[*names, "score", "predicted"])

    ddl = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True)] + ["score double", "predicted int"])
    return spread(chosen).mapInArrow(run, ddl)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the id) of every row, with score and predicted."""
    keep = keep or [id_col]
    return _scored(docs, model, text_col, keep).toDF(*keep, "score", "predicted")


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that the model takes for label 1."""
    names = docs.columns
    kept = _scored(docs, model, text_col, names).filter("predicted = 1").drop("score", "predicted")
    return kept.toDF(*names)
