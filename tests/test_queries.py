"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from docweave.queries import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    out = QUERIES[name](spark, DIR)
    columns = sorted(out.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    want = oracle.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert found == sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


@pytest.mark.parametrize(("name", "key", "among"), [("join_not_in", "p_partkey", "part"), ("join_range", "s_suppkey", "nation JOIN supplier ON n_nationkey < s_suppkey"), ("join_metadata", "c_custkey", "customer JOIN orders ON c_custkey = o_custkey")])
def test_whole_tables(spark, name, key, among):
    """On tables larger than the smallest, every id that has a partner is there, and the pairs are those of the SQL."""
    large, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("part", "supplier", "customer", "orders", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{large}/{t}.parquet'")
    out = QUERIES[name](spark, large)
    found = sorted(tuple(r) for r in out.collect())
    assert {r[out.columns.index(key)] for r in found} == {k for (k,) in con.sql(f"SELECT {key} FROM {among}").fetchall()}
    assert found == sorted(con.sql(f"SELECT {', '.join(out.columns)} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
