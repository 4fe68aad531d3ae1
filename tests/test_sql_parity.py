"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from docweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def clean(v):
        if pd.isna(v):
            return None
        return round(float(v), 9) if isinstance(v, float) else str(v)

    return sorted((tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    from docweave.plans.retrieval import records

    streamed = registry.QUERIES["stream_ingest"](spark, SF)
    assert {r[0] for r in streamed.select("chunk_id").collect()} == {r[0] for r in records(spark, SF).select("chunk_id").collect()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
