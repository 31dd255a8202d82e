"""The normaliser over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.plans import texts
from sextant.plans.texts import LEXICON
from sextant.session import spread, table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _stage(number: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        column = F.col("text")
        for step in T.stages(LEXICON)[: number + 1]:
            column = T.let(column, step)
        return _documents(spark, sf).select("doc_id", column.alias("text"))

    return run


def normalize_full_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", T.normalise(F.col("text"), LEXICON).alias("text"))


def rule_firing_rates_documents(spark: SparkSession, sf: str) -> DataFrame:
    traced = T.trace(_documents(spark, sf), "text", LEXICON)
    return traced.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("fired").cast("long")).alias("fired"), F.round(F.avg(F.col("fired").cast("double")), 6).alias("rate"))


def normalize_trace_documents(spark: SparkSession, sf: str) -> DataFrame:
    traced = T.trace(_documents(spark, sf), "text", LEXICON)
    return traced.select("doc_id", "step", "rule", "fired", texts.affected(F.col("before"), F.col("after")).alias("affected"))


_STAGES = list(texts.QUERIES)[:7]
_STAGES_SQL = texts._STAGES_SQL.replace(texts._CHATS_SQL, "SELECT doc_id, text AS t0 FROM documents")

QUERIES = {f"{name}_documents": _stage(i) for i, name in enumerate(_STAGES)} | {
    f.__name__: f for f in (normalize_full_documents, rule_firing_rates_documents, normalize_trace_documents)
}

ORACLES = {f"{name}_documents": f"WITH {_STAGES_SQL} SELECT doc_id, t{i + 1} AS text FROM s{i + 1}" for i, name in enumerate(_STAGES)}
ORACLES["normalize_full_documents"] = f"WITH {_STAGES_SQL} SELECT doc_id, t7 AS text FROM s7"
ORACLES["rule_firing_rates_documents"] = texts.ORACLES["rule_firing_rates"].replace(texts._CHATS_SQL, "SELECT doc_id, text AS t0 FROM documents WHERE length(text) > 0")
