"""Command line: builds a stored index from Parquet embeddings.

spark-submit -m sextant.plans.build_index INPUT OUTPUT [--priority balanced]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sextant.operators import index, ivfpq


def build(spark: SparkSession, source: str, target: str, priority: str = "balanced", codes: int = 256, algorithm: str = "ivfpq") -> index.VectorIndex:
    """Reads (vec_id, embedding), trains by corpus size and stores the index. Vectors of other dimensions are refused."""
    points = spark.read.parquet(source).select("vec_id", "embedding").filter(F.col("embedding").isNotNull())
    count, low, high = points.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not count or low != high:
        raise ValueError(f"{count} vectors of dimensions {low} to {high}")
    own = ivfpq.recommended(count, low, priority)
    if algorithm == "graph":
        built = index.create(spark, "graph", low, links=own["links"], build_width=own["build_width"])
        built.add(points)
        built.save(target)
        return built
    subquantisers = next(m for m in range(min(own["subquantisers"], low), 0, -1) if low % m == 0)
    built = index.create(spark, "ivfpq", low, clusters=min(own["clusters"], count), subquantisers=subquantisers, codes=min(codes, count), probes=min(own["probes"], count), iterations=own["iterations"])
    built.add(points)
    built.save(target)
    return built


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--priority", default="balanced", choices=["speed", "balanced", "quality"])
    parser.add_argument("--algorithm", default="ivfpq", choices=["ivfpq", "graph"])
    options = parser.parse_args()
    built = build(SparkSession.builder.appName("build index").getOrCreate(), options.source, options.target, options.priority, algorithm=options.algorithm)
    print(f"{built.count()} vectors")


if __name__ == "__main__":
    main()
