"""Every registered query of the core with SQL of its own gives the same rows as the SQL does."""

from __future__ import annotations

import math

import duckdb
import pytest

from rangeloom.plans import data_queries, range_queries

QUERIES = range_queries.QUERIES | data_queries.QUERIES
SQL = range_queries.ORACLE_SQL | data_queries.ORACLE_SQL


def connection(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in data.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v) for v in row)


def compare(spark, data, query, sql):
    df = query(spark, str(data))
    columns = sorted(df.columns)
    got = sorted(plain(r[c] for c in columns) for r in df.collect())
    found = connection(data).sql(sql)
    at = [list(found.columns).index(c) for c in columns]
    assert sorted(found.columns) == columns
    want = sorted(plain(r[i] for i in at) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, data, name):
    compare(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, str(data))
    assert df.columns and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
