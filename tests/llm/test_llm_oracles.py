"""Queries with oracle SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidespan.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal_rows(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect())
    got = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert ours == sorted(tuple(str(r[i]) for i in at) for r in got.fetchall()) and len(at) == len(got.description)
