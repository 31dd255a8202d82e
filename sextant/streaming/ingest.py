"""Incremental indexing as a stream: new embedding files are upserted into a store.

A file source feeds micro-batches; each batch is deduplicated and appended with its batch number as
version. The current state is the latest row of each id, so a repeated batch after a failure changes
nothing, and no batch rewrites the store.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sextant.operators import ivfpq
from sextant.operators.ivfpq import upsert


def append_batch(batch: DataFrame, number: int, store: str, id_col: str) -> None:
    own = batch.dropna(subset=[id_col]).dropDuplicates([id_col])
    own.write.mode("overwrite").parquet(f"{store}/version={number}")


def start(spark: SparkSession, source: str, store: str, checkpoint: str, schema: StructType | str, id_col: str = "vec_id", files_per_batch: int = 1000) -> StreamingQuery:
    """Processes all files that are there in batches, then ends; run it again for later ones."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = rows.writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, store, id_col))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str, id_col: str = "vec_id") -> DataFrame:
    """Latest row of every id in the store."""
    rows = spark.read.parquet(store)
    return upsert(rows, rows.limit(0), id_col, "version").drop("version")


def index_batch(batch: DataFrame, number: int, path: str, config: ivfpq.Config, seed: int = 42) -> None:
    """Adds a micro-batch (vec_id, embedding) to the compressed index at ``path``.

    Until there are enough vectors to train on, batches wait in the store beside it; the batch that makes them enough trains the index on all of
    them. Later batches only add their postings, under their number, so a batch that is tried again replaces itself and nothing is indexed twice.
    """
    spark = batch.sparkSession
    append_batch(batch.select("vec_id", "embedding"), number, f"{path}/vectors", "vec_id")
    parts = _trained(spark, path)
    if parts is None:
        waiting = current(spark, f"{path}/vectors")
        if waiting.count() < max(ivfpq.TRAIN_FROM, config.clusters, config.codes):
            return
        centroids, books = ivfpq.train(waiting, config, seed)
        ivfpq.write_parts(spark, path, centroids, books)
        own = waiting
    else:
        centroids, books = parts
        own = spark.read.parquet(f"{path}/vectors/version={number}")
    ivfpq.postings(own, centroids, books).write.mode("overwrite").parquet(f"{path}/entries/version={number}")


def _trained(spark: SparkSession, path: str) -> tuple[list, list] | None:
    try:
        return ivfpq.read_parts(spark, path)
    except AnalysisException:  # nothing there yet
        return None


def start_index(spark: SparkSession, source: str, path: str, checkpoint: str, schema: StructType | str, config: ivfpq.Config, files_per_batch: int = 1000) -> StreamingQuery:
    """Indexes all files that are there in batches, then ends; run it again for later ones. Another encoder: another path."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = rows.writeStream.foreachBatch(lambda batch, number: index_batch(batch, number, path, config))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, path: str) -> tuple[DataFrame, list, list]:
    """(postings, centroids, codebooks) of a streamed index: each id's latest posting."""
    centroids, books = ivfpq.read_parts(spark, path)
    return current(spark, f"{path}/entries"), centroids, books


def only_new(batch: DataFrame, store: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows of a batch that the store lacks: what still has to be embedded."""
    return batch.join(store.select(F.col(id_col)).distinct(), id_col, "left_anti")


def progress(query: StreamingQuery) -> dict[str, int]:
    """Batches and rows that a query has processed so far, from its recent progress reports."""
    reports = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    return {"batches": len(reports), "rows": sum(p["numInputRows"] for p in reports)}


def split_failures(batch: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """(good, failed) rows by a condition; a condition that is null counts as failed. Failed rows can be kept for a retry."""
    good = F.coalesce(valid, F.lit(False))
    return batch.filter(good), batch.filter(~good)
