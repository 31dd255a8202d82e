"""A corpus pipeline: classify, filter, deduplicate, mix and pack the documents of a data folder.

Every stage takes all that its predecessor kept, and all but the last return the columns of
``documents``. Between stages the rows are written as Parquet and read again; a stage's table goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import mixing, packing, quality_model, quality_rules, simhash
from sextant.session import remove, scratch_path, table

#: SQL cannot express the learned and iterative stages; tests run them against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1."""
    return quality_model.accepted(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    return quality_rules.passed(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their place in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    found, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, found, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        found, before = spark.read.parquet(path), path
    return found
