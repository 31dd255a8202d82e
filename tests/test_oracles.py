"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from sextant.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    rows = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted((tuple(repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in row) for row in rows.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    own = registry.queries()[name](spark, sf).toPandas()
    other = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert canonical(own) == canonical(other)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only_queries_run(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
