from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rangeloom.operators import skewed_keys as sk

SCHEMA = "epoch int, src_rank int, seq int, fname string, indexed_prop float, buf_sz int, shuffle_dest int, arrived_ts timestamp"


def brute(rows, share=0.05):
    total: dict = {}
    counts: dict = {}
    for r in rows:
        total[r[0]] = total.get(r[0], 0) + 1
        for field, v in (("shuffle_dest", r[6]), ("indexed_prop", r[4])):
            if v is None or (field == "indexed_prop" and not math.isfinite(v)):
                continue
            key = v if field == "shuffle_dest" else float(np.float32(v)) + 0.0
            counts[r[0], field, key] = counts.get((r[0], field, key), 0) + 1
    out = [(e, f, k if f == "shuffle_dest" else min(round(k * 1e6), 2**63 - 1024)) for (e, f, k), n in counts.items() if n >= share * total[e]]
    return sorted(out, key=str)


def rows_of(n, rng):
    out = []
    for i in range(n):
        prop = rng.choice([0.0, -0.0, 0.5, 0.5, float("nan"), float("inf"), -float("inf"), None, -2.25, rng.random(), 3e38, 1e-40])
        out.append((rng.choice([1, 2, 2, None]), i % 7, i, None, prop, rng.choice([None, 40, 48]), rng.choice([None, -1, 5, 5, 5, 37, rng.randint(0, 511)]), None))
    return out


def test_heavy_keys_like_counting(spark):
    rows = rows_of(2000, random.Random(5))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted([tuple(r) for r in sk.heavy_particles(df).collect()], key=str)
    assert got == brute(rows)


def test_one_value_holds_all_rows(spark):
    df = spark.createDataFrame([(1, 0, i, None, 1.5, 1, 7, None) for i in range(500)], SCHEMA)
    assert sorted(tuple(r) for r in sk.heavy_particles(df).collect()) == [(1, "indexed_prop", 1_500_000), (1, "shuffle_dest", 7)]


def test_nothing_heavy_and_nothing_at_all(spark):
    df = spark.createDataFrame([(1, 0, i, None, float(i), 1, i, None) for i in range(100)], SCHEMA)
    assert sk.heavy_particles(df).count() == 0
    assert sk.heavy_particles(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, 0, i, None, None, None, None, None) for i in range(10)], SCHEMA)
    assert sk.heavy_particles(nulls).count() == 0


def test_ties_at_the_share(spark):
    # 20 rows: one row is 5 %
    df = spark.createDataFrame([(1, 0, i, None, None, 1, i, None) for i in range(20)], SCHEMA)
    assert sk.heavy_particles(df).count() == 20


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, 0, i, None, 1.5, 1, 7, None) for i in range(50)], SCHEMA).selectExpr("*", "1 AS grp", "2 AS n", "3 AS code", "'x' AS field", "9 AS total")
    assert sk.heavy_particles(df).count() == 2
    assert sk.key_totals(df, "epoch", "shuffle_dest", "buf_sz").first()["total"] == 50


def test_many_arrays_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(sk, "MAX_BYTES", 8192)
    rows = [(e, 0, i, None, 0.25 * e, 1, e, None) for e in range(9) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sk.heavy_particles(df).count() == 18


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_key_totals(spark, monkeypatch, limit):
    monkeypatch.setattr(sk, "THIN", limit)
    rows = rows_of(1500, random.Random(8))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["grp"], r["key"]): (r["n"], r["total"]) for r in sk.key_totals(df, "epoch", "shuffle_dest", "buf_sz").collect()}
    want: dict = {}
    for r in rows:
        n, t = want.get((r[0], r[6]), (0, 0))
        want[r[0], r[6]] = (n + 1, t + (r[5] or 0))
    assert got == want
    assert sk.key_totals(df.limit(0), "epoch", "shuffle_dest", "buf_sz").count() == 0


def test_codes_keep_the_order():
    x = np.array([-np.inf, -3e38, -1.5, -1e-40, -0.0, 0.0, 1e-40, 2.0, 3e38, np.inf], np.float32)
    code = sk.float_code(x)
    assert (np.diff(code.astype(np.int64)) >= 0).all()
    assert code[4] == code[5]
    assert np.array_equal(sk.float_of(code), x + np.float32(0))
    ints = np.array([-(2**31), -1, 0, 511, 2**31 - 1])
    assert np.array_equal(sk.int_of(sk.int_code(ints)), ints)


def test_once_keeps_the_first_arrival(spark):
    rows = [(1, 0, 0, "b", 1.0, 2, 3, "2023-01-02"), (1, 0, 0, "a", 9.0, 9, 9, "2023-01-01"), (1, 0, 1, None, None, None, None, None), (1, 0, 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string"))
    got = {r["seq"]: r for r in sk.once(df).collect()}
    assert len(got) == 2 and got[0]["fname"] == "a" and got[1]["fname"] is None
