"""File scans and stored embeddings.

Embeddings are Parquet partitioned by encoder; a compact binary cache file (magic, version,
dimension, count, encoder id, then records) can be read and written for exchange.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.timeline import IMAGE_EXTENSIONS

# The cache file's magic number and versions.
CACHE_MAGIC = b"KEMB"
CACHE_VERSIONS = (1, 2)


def scan_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Files under a folder with one of the extensions: (id, path, modified_at, size_bytes), one row a file. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    wanted = files.filter(F.rlike(F.col("path"), F.lit(r"(?i)\.(" + "|".join(extensions) + r")$")))
    return wanted.select(F.concat(F.lit("dir_"), F.hex(F.xxhash64("path"))).alias("id"), "path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes")).dropDuplicates(["id"])


def write_embeddings(rows: DataFrame, path: str) -> None:
    """Stores (encoder_id, id, embedding); replaces only the encoders that occur. No rows: nothing changes."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("encoder_id").parquet(path)


def embedding_summary(spark: SparkSession, path: str) -> DataFrame:
    """(encoder_id, count, dimension) of the encoders in a store."""
    return spark.read.parquet(path).groupBy("encoder_id").agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dimension"))


def read_embeddings(spark: SparkSession, path: str, encoder_id: str) -> DataFrame:
    """One encoder's embeddings; other encoders' folders are pruned."""
    return spark.read.parquet(path).filter(F.col("encoder_id") == encoder_id)


def clear_embeddings(spark: SparkSession, path: str, encoder_id: str | None = None) -> bool:
    """Deletes one encoder's folder, or all; false if it was not there."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path if encoder_id is None else f"{path}/encoder_id={encoder_id}")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def pack_cache(encoder_id: str, rows: list[tuple[str, list[float]]], version: int = 2) -> bytes:
    """Cache file of (id, vector) rows, little-endian."""
    dimension = len(rows[0][1]) if rows else 0
    name = encoder_id.encode()
    parts = [CACHE_MAGIC, struct.pack("<III", version, dimension, len(rows)), struct.pack("<I", len(name)), name]
    for key, vector in rows:
        if len(vector) != dimension:
            raise ValueError("vectors differ in dimension")
        raw = key.encode()
        parts += [struct.pack("<I", len(raw)), raw, np.asarray(vector, dtype="<f4").tobytes()]
    return b"".join(parts)


def unpack_cache(content: bytes, encoder_id: str | None = None) -> list[tuple[str, list[float]]] | None:
    """Rows of a cache file; None if magic, version or encoder differ, or the file is cut short."""
    try:
        version, dimension, count, length = struct.unpack_from("<IIII", content, 4)
        if content[:4] != CACHE_MAGIC or version not in CACHE_VERSIONS:
            return None
        at = 20 + length
        if encoder_id is not None and content[20:at].decode() != encoder_id:
            return None
        rows = []
        for _ in range(count):
            (length,) = struct.unpack_from("<I", content, at)
            key = content[at + 4 : at + 4 + length].decode()
            at += 4 + length
            rows.append((key, np.frombuffer(content, dtype="<f4", count=dimension, offset=at).tolist()))
            at += 4 * dimension
        return rows
    except (struct.error, ValueError):
        return None


def read_caches(spark: SparkSession, path: str, encoder_id: str | None = None) -> DataFrame:
    """(id, embedding) of all cache files under a path; unreadable files give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = unpack_cache(content.as_py(), encoder_id) or []
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id string, embedding array<float>")
