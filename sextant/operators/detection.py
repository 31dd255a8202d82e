"""Boxes of detections: decoding, overlap, suppression, cropping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Detection thresholds, input size, strides, and thumbnail margin.
LEAST_CONFIDENCE = 0.3
SUPPRESS_ABOVE = 0.4
MOST_FACES = 10
INPUT_SIZE = 640
STRIDES = (8, 16, 32)
ANCHORS_PER_CELL = 2
MARGIN = 0.15


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("double").alias("l"), top.cast("double").alias("t"), right.cast("double").alias("r"), bottom.cast("double").alias("b"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    width, height = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    common = F.when((width > 0) & (height > 0), width * height).otherwise(F.lit(0.0))
    union = (a["r"] - a["l"]) * (a["b"] - a["t"]) + (b["r"] - b["l"]) * (b["b"] - b["t"]) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def decode_anchors(rows: DataFrame) -> DataFrame:
    """Detector output rows (image_id, stride, anchor, score, d_l, d_t, d_r, d_b, scale, pad_x, pad_y) to boxes.

    Distances are in strides from the anchor's cell corner; boxes return to the image by undoing
    padding and scale and are clamped at 0. Scores outside 0..1 are logits. Low scores are dropped.
    """
    cells = F.lit(INPUT_SIZE) / F.col("stride")
    cell = F.floor(F.col("anchor") / ANCHORS_PER_CELL)
    x, y = (cell % cells) * F.col("stride"), F.floor(cell / cells) * F.col("stride")
    score = F.when((F.col("score") < 0) | (F.col("score") > 1), 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("score"))
    back = lambda value, pad: F.greatest(F.lit(0.0), (value - F.col(pad)) / F.col("scale"))
    decoded = rows.select(
        "image_id", "stride", "anchor", score.alias("confidence"),
        back(x - F.col("d_l") * F.col("stride"), "pad_x").alias("l"), back(y - F.col("d_t") * F.col("stride"), "pad_y").alias("t"),
        back(x + F.col("d_r") * F.col("stride"), "pad_x").alias("r"), back(y + F.col("d_b") * F.col("stride"), "pad_y").alias("b"),
    )
    return decoded.filter(F.col("confidence") >= LEAST_CONFIDENCE)


def top_per_image(boxes: DataFrame, most: int = MOST_FACES) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("confidence"), "box_id"))
    return boxes.withColumn("rank", rank).filter(F.col("rank") <= most)


def suppress(boxes: DataFrame, above: float = SUPPRESS_ABOVE) -> DataFrame:
    """Greedy non-maximum suppression for each image: (image_id, box_id, confidence) of the kept boxes.

    In descending confidence a box is kept unless a kept one overlaps it by more than the threshold.
    A fold over the image's boxes, which are as many as one picture's detections.
    """
    own = F.struct((-F.col("confidence")).alias("key"), "box_id", "confidence", box(F.col("l"), F.col("t"), F.col("r"), F.col("b")).alias("box"))
    grouped = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(own)).alias("all_"))
    nothing = F.filter("all_", lambda b: F.lit(False))
    kept = F.aggregate("all_", nothing, lambda so_far, b: F.when(F.exists(so_far, lambda k: iou(k["box"], b["box"]) > above), so_far).otherwise(F.array_append(so_far, b)))
    return grouped.select("image_id", F.inline(kept)).select("image_id", "box_id", "confidence")


def expand(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column, margin: float = MARGIN) -> Column:  # noqa: E741
    """Box grown by a margin on each side, made square around its centre, clamped to the picture."""
    side = F.greatest((r - l) * (1 + 2 * margin), (b - t) * (1 + 2 * margin))
    x, y = (l + r) / 2, (t + b) / 2
    inside = lambda value, limit: F.least(F.greatest(value, F.lit(0.0)), limit)
    return box(inside(x - side / 2, width), inside(y - side / 2, height), inside(x + side / 2, width), inside(y + side / 2, height))


def rows_of_floats(values: Column, width: int) -> Column:
    """Flat detector output as an array of (confidence, box): rows of 15 (box, points, score) or 5 (box, score) numbers."""
    if width not in (5, 15):
        raise ValueError("rows hold 5 or 15 numbers")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(width)), lambda s: s + width - 1 <= F.size(values))
    row = lambda s: F.slice(values, s, width)
    return F.transform(starts, lambda s: F.struct(F.get(row(s), F.lit(width - 1)).alias("confidence"), box(*(F.get(row(s), F.lit(i)) for i in range(4))).alias("box")))
