"""Each query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tallyforge.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df, rel = QUERIES[name](spark, SF), db.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
