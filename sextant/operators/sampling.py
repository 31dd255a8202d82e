"""Repeatable samples of bounded size, chosen by a hash of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Range of the non-negative hash that ``in_fraction`` compares.
FRACTION_RANGE = 1 << 30


def in_fraction(key: Column, fraction: float, seed: int = 0) -> Column:
    """A repeatable choice of about this fraction of the keys."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(FRACTION_RANGE)) < int(min(1.0, fraction) * FRACTION_RANGE)


def bounded_sample(df: DataFrame, key: Column, most: int, seed: int = 0) -> DataFrame:
    """Rows whose key's hash falls under most / count: about ``most`` rows at any input size, without a sort."""
    count = df.count()
    return df if count <= most else df.filter(in_fraction(key, most / count, seed))
