"""Queries that SQL can express, on the smallest tables."""

import math

import duckdb
import pytest

from docweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda v: None if v is None or v is math.nan or v != v else round(v, 9) if isinstance(v, float) else v
    rows = lambda df: sorted((tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
