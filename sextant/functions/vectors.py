"""Vector arithmetic as Column expressions.

Components are widened to DOUBLE before any arithmetic; every function is null if an input is null.
All of them stay in the JVM: ``zip_with`` and ``aggregate`` over array columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALISED_TOLERANCE = 0.001


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in dimension")))


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of unequal dimension raise an error."""
    return _checked(a, b, _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(as_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def squared_l2(a: Column, b: Column) -> Column:
    return _checked(a, b, _total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def ip_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 1 where either vector is zero."""
    return F.lit(1.0) - cosine(a, b)


def is_normalised(a: Column) -> Column:
    return F.abs(norm(a) - 1) < NORMALISED_TOLERANCE


def normalise(a: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length == 0, as_double(a)).otherwise(F.transform(as_double(a), lambda x: x / length))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    """Difference, as for the residual of a vector against its centroid."""
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def scale(a: Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(as_double(a), lambda x: x * factor)


def zeros(dimension: int) -> Column:
    return F.array_repeat(F.lit(0.0), dimension)


def random_unit(dimension: int, seed: int) -> Column:
    """A random direction; repeatable for a seed and a row order."""
    return normalise(F.array(*[F.randn(seed + i) for i in range(dimension)]))


def ramp(dimension: int = 768) -> Column:
    """Deterministic test vector: component i is (i mod 100) / 100."""
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (i % 100) / F.lit(100.0))


def subvector(a: Column, index: int, width: int) -> Column:
    return F.slice(a, index * width + 1, width)


METRICS = {"l2": squared_l2, "ip": ip_distance, "cosine": cosine_distance}


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance by metric name: squared L2, 1 - inner product, or 1 - cosine."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    return METRICS[metric](a, b)


def similarity_from_distance(metric: str, value: Column) -> Column:
    """1 - d for inner product and cosine; 1 - d/2 for squared L2 of unit vectors."""
    return 1 - value / 2 if metric == "l2" else 1 - value
