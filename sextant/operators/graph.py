"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the roots themselves; root is the smallest node reachable.

    Large-star and small-star contractions in turn, until the edges stay as they are. Degrees are
    reduced by aggregation before any shuffle; joins on a star's centre are left to skew handling.
    Every round is checkpointed, so the lineage stays short and survives lost executors.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = checkpointed(pairs)
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
        small = large.join(smallest, "a").select(F.explode(F.array(pair("a", "m"), pair("b", "m"))).alias("e")).select("e.a", "e.b").filter("a > b").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (now["n"], now["h"])
