"""The registered queries of this subpackage: those with SQL like it, the others by what must hold."""

from __future__ import annotations

import math

import duckdb
import pytest

from rangeloom.llm import queries as Q

EMPTY_HERE = {"p6_found"}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_like_sql(spark, data, name):
    con = duckdb.connect()
    for f in data.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = Q.QUERIES[name](spark, str(data))
    columns = sorted(df.columns)
    found = con.sql(Q.ORACLE_SQL[name])
    at = [list(found.columns).index(c) for c in columns]
    plain = lambda row: tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v) for v in row)
    assert sorted(plain(r[c] for c in columns) for r in df.collect()) == sorted(plain(r[i] for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(spark, data, name):
    df = Q.QUERIES[name](spark, str(data))
    assert df.columns and (df.count() > 0 or name in EMPTY_HERE)


def test_found_columns(spark, data):
    assert Q.p6_found(spark, str(data)).dtypes == [("doc_id", "bigint")]
    assert Q.p8_found(spark, str(data)).dtypes == [("doc_id", "bigint")]


def test_merged_bounds_hold_the_exact_percentiles(spark, data):
    exact = {(r["field"], r["p"]): r["low"] for r in Q.p2_percentiles(spark, str(data)).filter("grouping = 'run'").collect()}
    merged = Q.p2_merged(spark, str(data)).collect()
    assert len(merged) == len(exact)
    assert all(r["low"] <= exact[r["field"], r["p"]] <= r["high"] for r in merged)
