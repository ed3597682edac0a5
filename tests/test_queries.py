"""Every registered query with SQL gives the rows that DuckDB gives on the small tables."""

import math
import os

import duckdb
import pytest

from eventloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = registry.queries()[name](spark, DATA)
    want = db.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    have = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert have == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
