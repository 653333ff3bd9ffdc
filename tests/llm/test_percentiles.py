from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rangeloom.llm import percentiles as P
from rangeloom.operators import radix

PROBS = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


def coded(spark, rows, width):
    df = spark.createDataFrame(rows, f"g int, x {'float' if width == 32 else 'double'}")
    return df.select("g", radix.encode(df["x"], width).alias("code")).cache()


def exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1]


@pytest.mark.parametrize("width", [32, 64])
def test_like_sorting(spark, width):
    rng = random.Random(width)
    special = [0.0, -0.0, math.inf, -math.inf, 1e-40, -1e-40, 3e38, 1.5, 1.5, 1.5]
    rows = [(rng.choice([1, 2, 2, 3]), rng.choice(special) if rng.random() < 0.3 else rng.gauss(0, 100)) for _ in range(900)] + [(4, 7.0), (None, 1.0), (None, 2.0)]
    if width == 32:
        rows = [(g, float(np.float32(x))) for g, x in rows]
    got = {(r["g"], r["p"]): r for r in P.radix_percentiles(coded(spark, rows, width), ["g"], width, PROBS).collect()}
    for g in {g for g, _ in rows}:
        values = [x for h, x in rows if h == g]
        for p in PROBS:
            r = got[g, p]
            assert r["low"] == r["high"] == exact(values, p) and r["n"] == len(values), (g, p)


@pytest.mark.parametrize("bits", [12, 16, 24])
def test_merged_sketches_hold_the_answer(spark, bits):
    rng = random.Random(1)
    rows = [(i % 5, float(np.float32(rng.lognormvariate(0, 2)))) for i in range(2000)]
    parts = P.sketch(coded(spark, rows, 32), ["g"], 32, bits)
    whole = P.sketch_percentiles(P.merge(parts), [], 32, PROBS, bits).collect()
    assert len(whole) == len(PROBS)
    for r in whole:
        want = exact([x for _, x in rows], r["p"])
        assert r["low"] <= want <= r["high"] and r["n"] == 2000
        assert r["high"] - r["low"] <= abs(want) * P.relative_width(bits, 32) * 2
    again = P.radix_percentiles(coded(spark, rows, 32), [], 32, PROBS, first=P.merge(P.sketch(coded(spark, rows, 32), ["g"], 32)))
    assert {r["p"]: r["low"] for r in again.collect()} == {p: exact([x for _, x in rows], p) for p in PROBS}


def test_fewer_digits_bound_the_answer(spark):
    rows = [(1, i * 1.000001) for i in range(1, 500)]
    for r in P.radix_percentiles(coded(spark, rows, 64), ["g"], 64, PROBS, digits=2).collect():
        assert r["low"] <= exact([x for _, x in rows], r["p"]) <= r["high"] and r["high"] - r["low"] < 1e-3


def test_followed_digits_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(radix, "MAX_BROADCAST", 0)
    rows = [(i % 3, float(i)) for i in range(100)]
    got = {(r["g"], r["p"]): r["low"] for r in P.radix_percentiles(coded(spark, rows, 32), ["g"], 32, (0.5,)).collect()}
    assert got == {(g, 0.5): exact([x for h, x in rows if h == g], 0.5) for g in range(3)}


def test_one_value_over_and_over_and_nothing(spark):
    rows = [(1, 2.5)] * 300
    assert {r["low"] for r in P.radix_percentiles(coded(spark, rows, 32), ["g"], 32, PROBS).collect()} == {2.5}
    assert P.radix_percentiles(coded(spark, rows, 32).limit(0), ["g"], 32, PROBS).count() == 0


def test_tables_with_nulls_and_repeats(spark):
    mem = spark.createDataFrame(
        [(1, 0, 0, 1.0), (1, 0, 0, 1.0), (1, 0, 1, None), (1, 0, 2, float("nan")), (2, 1, 0, 5.0), (2, 1, 1, float("inf"))], "epoch int, src_rank int, seq int, indexed_prop float"
    ).selectExpr("*", "1 AS code", "2 AS digit", "3 AS p")
    bounds = spark.createDataFrame([], "epoch int, round_no int, stage int, node int, pbidx int, b_value double, b_far_end double, is_start boolean, received_ts timestamp")
    got = {(r["grouping"], r["group_id"], r["p"]): r for r in P.all_percentiles(mem, bounds, (0.5,)).collect()}
    assert {k: (r["low"], r["n"]) for k, r in got.items()} == {("epoch", 1, 0.5): (1.0, 1), ("epoch", 2, 0.5): (5.0, 2), ("src_rank", 0, 0.5): (1.0, 1), ("src_rank", 1, 0.5): (5.0, 2), ("run", None, 0.5): (5.0, 3)}


def test_unset_ends_are_no_values(spark):
    schema = "epoch int, round_no int, stage int, node int, pbidx int, b_value double, b_far_end double, is_start boolean, received_ts timestamp"
    rows = [(1, 1, 1, 0, i, v, 0.0, True, None) for i, v in enumerate([*P.UNSET, 1.0, None, float("nan"), 1.0])] + [(1, 1, 1, 0, 2, 1.0, 0.0, True, None)]
    assert P.bound_codes(spark.createDataFrame(rows, schema)).count() == 2
