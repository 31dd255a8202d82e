"""Scans in time order, date groups, progressive batches and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cumulative sizes of the first progressive batches, then the step.
FIRST_BATCHES = (50, 100, 200)
BATCH_STEP = 200
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "heic", "heif")


def newest_first(items: DataFrame, date_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """Newest first, undated last, ties by id."""
    return items.orderBy(F.desc_nulls_last(date_col), id_col)


def in_album(items: DataFrame, album: str, name_col: str = "album", path_col: str = "path") -> DataFrame:
    """Items of the album of that name; if there is none, of albums whose name contains it; if none, whose path does."""
    name, wanted = F.lower(name_col), F.lit(album.lower())
    level = F.when(name == wanted, 1).when(F.contains(name, wanted), 2).when(F.contains(F.lower(path_col), wanted), 3)
    levelled = items.withColumn("level_", level)
    best = levelled.agg(F.min("level_").alias("best_"))
    return levelled.join(F.broadcast(best), F.col("level_") == F.col("best_")).drop("level_", "best_")


def batch_number(position: Column) -> Column:
    """Batch of an item by its position from 1: up to 50, up to 100, up to 200, then 200 each."""
    first, second, third = FIRST_BATCHES
    return F.when(position <= first, 1).when(position <= second, 2).when(position <= third, 3).otherwise(3 + F.ceil((position - third) / BATCH_STEP)).cast("int")


def positions(items: DataFrame, date_col: str, id_col: str) -> DataFrame:
    """Adds each item's place in newest-first order.

    Days get offsets from their counts; rows are ranked inside a day, so no task sorts the corpus.
    """
    dated = items.withColumn("day_", F.to_date(date_col))
    counts = dated.groupBy("day_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy(F.desc_nulls_last("day_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("day_").alias("own_"), before.alias("before_"))
    joined = dated.join(offsets, F.col("day_").eqNullSafe(F.col("own_"))).drop("own_")
    rank = F.row_number().over(Window.partitionBy("day_").orderBy(F.desc_nulls_last(date_col), id_col))
    return joined.withColumn("position", F.col("before_") + rank).drop("day_", "before_")


def progressive_batches(items: DataFrame, date_col: str = "created_at", id_col: str = "id") -> DataFrame:
    return positions(items, date_col, id_col).withColumn("batch", batch_number(F.col("position")))


def date_group(created: Column, modified: Column, now: Column) -> Column:
    """(order, label): Today, This week, This month, months descending, Earlier for undated."""
    at = F.coalesce(created, modified)
    today = F.date_trunc("day", now)
    label = F.when(at.isNull(), "Earlier").when(at >= today, "Today").when(at >= today - F.expr("INTERVAL 6 DAYS"), "This week").when(at >= F.date_trunc("month", now), "This month").otherwise(F.date_format(at, "MMMM yyyy"))
    order = F.when(at.isNull(), 1 << 30).when(at >= today, 0).when(at >= today - F.expr("INTERVAL 6 DAYS"), 1).when(at >= F.date_trunc("month", now), 2).otherwise(3 + F.lit(12 * 10_000) - (F.year(at) * 12 + F.month(at)))
    return F.struct(order.cast("int").alias("order"), label.alias("label"))


def date_buckets(items: DataFrame, now: Column, created_col: str = "created_at", modified_col: str = "modified_at") -> DataFrame:
    """Items with group_order and group_label; newest first inside a group is a matter of sorting by date."""
    return items.withColumn("group_", date_group(F.col(created_col), F.col(modified_col), now)).withColumns({"group_order": F.col("group_.order"), "group_label": F.col("group_.label")}).drop("group_")


def incremental_diff(cache: DataFrame, corpus: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, state): ``keep`` if cached and still there, ``add`` if new; cached rows that are gone are left out."""
    keep = corpus.join(cache.select(id_col).distinct(), id_col, "left_semi").select(id_col, F.lit("keep").alias("state"))
    add = corpus.join(cache.select(id_col).distinct(), id_col, "left_anti").select(id_col, F.lit("add").alias("state"))
    return keep.unionByName(add)


def resolve(items: DataFrame, path_col: str = "path", extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Items with an id and a path of a supported extension."""
    return items.dropna(subset=[path_col]).filter(F.rlike(F.col(path_col), F.lit(r"(?i)\.(" + "|".join(extensions) + r")$")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
