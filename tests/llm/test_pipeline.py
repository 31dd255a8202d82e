"""The pipeline's stages against what each may keep, and the operators' SQL."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from sextant.llm import packing, registry
from sextant.session import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        own = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert own and set(own) <= before, name
        assert set(own.values()) <= ({1, 2} if name == "mixing" else {1}), name
        before = set(own)
        if name == "quality_rules":
            assert sum(labels.get(i) == 0 for i in own) <= 0.1 * sum(v == 0 for v in labels.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == before
    used = Counter()
    for r in packed.collect():
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.CAPACITY


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and "sequence_id" in rows.columns


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    own = registry.queries()[name](spark, sf).toPandas()
    other = con.execute(registry.oracle_sql()[name]).df()[list(own.columns)]
    key = lambda df: sorted(map(repr, df.itertuples(index=False, name=None)))
    assert key(own) == key(other)
