"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word definition: a word is a run of other characters.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Least rows of a hash bucket; beyond its square a group has as many buckets as a bucket has rows.
ROWS_PER_BUCKET = 200


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def quoted(name: str) -> str:
    """A column's name as one part, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bucket_count(rows: Column, least: int | None = None) -> Column:
    """Buckets for a group of so many rows.

    Both the rows of a bucket and the number of buckets, over which offsets are summed in order, stay
    near the square root of the group's rows.
    """
    each = F.greatest(F.lit(float(least or ROWS_PER_BUCKET)), F.sqrt(rows))
    return F.greatest(F.lit(1), F.floor(rows / each)).cast("long")
