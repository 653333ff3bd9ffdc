"""Edges, pivots, unions, trees and balance: golden values, properties and small brute-force models."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeloom.functions import edges as E
from rangeloom.functions import kernels as K
from rangeloom.operators import balance, pivots, placement

# Twelve known keys and their eight pivots.
TWELVE = [0.183005, 0.261744, 0.379052, 0.130448, 0.400778, 0.327600, 0.831964, 0.363970, 1.327184, 0.193020, 2.427586, 0.213298]
TWELVE_PIVOTS = [0.130448, 0.188728, 0.220219, 0.308784, 0.368279, 0.397674, 1.044201, 2.427586]


@pytest.mark.parametrize("edges", [[0.0, 1.0, 1.0, 2.0], [float(i) for i in range(200)]])
def test_bin_index(spark, edges):
    keys = [-1.0, 0.0, 0.5, 1.0, 1.5, 1.999, 2.0, 3.0, 250.0, float("nan"), None]
    df = spark.createDataFrame([(k,) for k in keys], "k double")
    n = len(edges) - 1
    rows = df.select("k", E.bin_index(F.col("k"), edges).alias("a"), E.bin_index(F.col("k"), edges, True).alias("b"), E.bin_index_of(F.col("k"), F.array(*[F.lit(e) for e in edges])).alias("c")).collect()
    for r in rows:
        if r["k"] is None:
            assert (r["a"], r["b"], r["c"]) == (None, None, None)
            continue
        want = -1 if math.isnan(r["k"]) else sum(e <= r["k"] for e in edges) - 1
        assert r["a"] == r["c"] == want
        assert r["b"] == min(max(want, 0), n - 1)


def test_range_predicates(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 0.0, 1.0), (-1.0, 0.0, 1.0), (0.5, 0.5, 0.5), (float("nan"), 0.0, 1.0), (0.5, None, None)], "x double, lo double, hi double")
    got = df.select(E.in_range(F.col("x"), F.col("lo"), F.col("hi")).alias("i"), E.relative_position(F.col("x"), F.col("lo"), F.col("hi")).alias("p")).collect()
    assert [(r["i"], r["p"]) for r in got] == [(False, 1), (True, 0), (False, -1), (False, 1), (False, -1), (False, -1)]


def test_golden_pivots():
    got, weight = K.combined_pivots(np.array(TWELVE, np.float32), None, None, 8)
    assert np.allclose(got, TWELVE_PIVOTS, atol=1e-3) and weight == 12 / 7


def test_golden_pivots_by_group(spark):
    df = spark.createDataFrame([(1, k) for k in TWELVE] + [(2, 5.0), (3, float("nan"))], "g int, k float")
    got = {r["g"]: r for r in pivots.pivots_from_keys(df, "k", 8, ["g"]).collect()}
    assert np.allclose(got[1]["pivots"], TWELVE_PIVOTS, atol=1e-3)
    assert got[2]["pivots"][0] == 5.0 and got[2]["pivots"][-1] > 5.0 and got[2]["weight"] == 1 / 7
    assert got[3]["pivots"] == [0.0] * 8 and got[3]["weight"] == 0


def test_dedup():
    # fixed values: nine keys of which four are kept
    nine = np.array([5, 5, 5, 5, 5, 6, 6, 7, 8], np.float32)
    assert len(K.dedup_sorted(nine)) == 4


def test_dedup_by_group(spark):
    rng = np.random.default_rng(4)
    near = np.concatenate([np.arange(0, 3e-6, 3e-8), rng.uniform(-1e-5, 1e-5, 200), rng.uniform(0.9, 0.90001, 300), [5, 5, 6, 0.0, -0.0, 7, np.inf]]).astype(np.float32)
    groups = {1: near, 2: np.array([2.0], np.float32), None: near[:50]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [(1, None), (1, float("nan")), (9, None)], "g int, k float")
    got: dict = {}
    for r in pivots.dedup_keys(df, "k", ["g"]).collect():
        got.setdefault(r["g"], []).append(r["key"])
    assert {g: sorted(xs) for g, xs in got.items()} == {g: K.dedup_sorted(xs + np.float32(0)).tolist() for g, xs in groups.items()}


@pytest.mark.parametrize("most", [0, 200_000])
def test_many_keys_outside_bins_like_the_kernel(spark, monkeypatch, most):
    """Keys on both sides, on one, and without bins, some within 1e-7 of each other."""
    monkeypatch.setattr(pivots, "MAX_KEYS", most)
    rng = np.random.default_rng(5)
    groups = {
        1: (rng.normal(0, 3, 900), [-1.0, 0.0, 2.0], [5.0, 7.0]), 2: (rng.uniform(3, 3.00001, 500), [-1.0, 0.0, 2.0], [0.0, 0.0]), 3: (rng.normal(0, 1, 50), None, None),
        4: (np.zeros(0), [0.0, 4.0], [3.0]), 5: (rng.uniform(-9, -8, 7), [0.0, 4.0, 5.0], [1.0, 2.0]),
    }
    keys = spark.createDataFrame([(g, float(np.float32(x))) for g, (xs, _, _) in groups.items() for x in xs], "g int, key float")
    bins = spark.createDataFrame([(g, e, w) for g, (_, e, w) in groups.items() if e is not None], "g int, edges array<double>, weights array<double>")
    got = {r["g"]: r for r in pivots.combined_pivots(bins, keys, 11, ["g"]).collect()}
    for g, (xs, e, w) in groups.items():
        want, weight = K.combined_pivots(xs.astype(np.float32), e, w, 11)
        assert np.allclose(got[g]["pivots"], want, atol=1e-9) and math.isclose(got[g]["weight"], weight), g


def test_quantile_edges_like_numpy(spark):
    rng = np.random.default_rng(6)
    xs = {1: rng.normal(0, 1e3, 1001), 2: np.array([4.0]), 3: np.repeat([1.5, -2.0, 7.0], 40)}
    for kind in ("float", "double"):
        cast = np.float32 if kind == "float" else np.float64
        df = spark.createDataFrame([(g, float(cast(x))) for g, v in xs.items() for x in v] + [(1, None), (1, float("nan"))], f"g int, k {kind}")
        got: dict = {}
        for r in pivots.quantile_edges(df, "k", 9, ["g"]).collect():
            got.setdefault(r["g"], {})[r["k"]] = r["pivot"]
        for g, v in xs.items():
            assert np.allclose([got[g][k] for k in range(9)], np.quantile(v.astype(cast).astype(float), np.arange(9) / 8), rtol=1e-12)
    assert pivots.quantile_edges(df.limit(0), "k", 3).count() == 0


def test_worked_example_of_all_sources():
    got, weight = K.combined_pivots(np.array([-1, -0.5, 12], np.float32), [0, 5, 10], [4, 1], 5)
    assert np.allclose(got, [-1, 0, 2.5, 5, np.nextafter(np.float32(12), np.float32(np.inf))]) and weight == 2


def test_keys_inside_the_bins_weigh_nothing():
    edges = [0.011929879, 0.203471959, 0.338690162, 0.500766993, 0.735446155, 1.01613414, 1.4439038, 2.18780971, 4.48976707]
    weights = [11, 10, 10, 6, 1, 3, 2, 1]
    got, weight = K.combined_pivots(np.linspace(0.1, 4, 25, dtype=np.float32), edges, weights, 8)
    assert np.allclose(got, [0.01193, 0.121382, 0.224721, 0.309715, 0.405836, 0.51753, 0.935938, 4.489767], atol=1e-5)
    assert weight == 44 / 7


def test_no_data_gives_zeros():
    assert K.combined_pivots(np.zeros(0, np.float32), None, None, 4)[0].tolist() == [0] * 4
    assert K.combined_pivots(np.zeros(0, np.float32), [0, 1], [0], 4)[1] == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, width=32), max_size=60), st.lists(st.integers(0, 9), min_size=1, max_size=9), st.integers(2, 40), st.booleans())
def test_pivots_never_fall(keys, weights, n, with_bins):
    edges = np.linspace(-10, 10, len(weights) + 1)
    got, _ = K.combined_pivots(np.array(keys, np.float32), edges if with_bins else None, weights if with_bins else None, n)
    assert len(got) == n and (np.diff(got) >= 0).all()


def test_worked_union(spark):
    sets = [(np.array([0.0, 2, 4]), 1.0), (np.array([1.0, 3, 9]), 2.0)]
    edges, w = K.union_histogram(sets)
    assert edges.tolist() == [0, 1, 2, 3, 4, 9]
    assert np.allclose(w, [0.5, 1.5, 1.5, 5 / 6, 5 / 3])
    df = spark.createDataFrame([(1, p.tolist(), x) for p, x in sets], "g int, pivots array<double>, weight double")
    rows = sorted((r["lo"], r["hi"], r["w"]) for r in pivots.pivot_union(pivots.chunks_of(df, ["g"]), ["g"]).collect())
    assert np.allclose(rows, [(a, b, x) for a, b, x in zip(edges, edges[1:], w, strict=False)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(-20, 20), min_size=2, max_size=8), st.floats(0.1, 9)), min_size=1, max_size=6))
def test_union_keeps_the_weight(sets):
    sets = [(np.sort(np.array(p, float)), w) for p, w in sets]
    edges, w = K.union_histogram(sets)
    solid = sum(x * len(np.unique(p)[1:]) for p, x in sets)
    assert math.isclose(w.sum(), solid, abs_tol=1e-9) and (w > -1e-9).all()


def test_gaps_weigh_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, 5.0, 6.0, 1.0), (1, 3.0, 3.0, 9.0)], "g int, lo double, hi double, w double")
    assert sorted(tuple(r)[1:] for r in pivots.pivot_union(df, ["g"]).collect()) == [(0.0, 1.0, 2.0), (1.0, 5.0, 0.0), (5.0, 6.0, 1.0)]


def test_histogram_quantiles_like_the_kernel(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(20):
        w = [float(rng.choice([0, 0, 1, 3, 7])) for _ in range(rng.randint(1, 9))]
        edges = np.cumsum([rng.random() for _ in range(len(w) + 1)])
        rows += [(g, float(a), float(b), x) for a, b, x in zip(edges, edges[1:], w, strict=False)]
        total = sum(w)
        want[g] = K.histogram_value(edges, np.array(w), total * np.arange(7) / 6) if total else np.zeros(7)
    df = spark.createDataFrame(rows, "g int, lo double, hi double, w double")
    got: dict = {}
    for r in pivots.histogram_quantiles(df, 7, ["g"]).collect():
        got.setdefault(r["g"], {})[r["k"]] = r["pivot"]
    for g, values in want.items():
        assert np.allclose([got[g][k] for k in range(7)], values, atol=1e-9), g


def test_right_edge_at_a_full_bin():
    assert K.histogram_value(np.array([0, 1, 5, 6.0]), np.array([2, 0, 2.0]), np.array([2.0])).tolist() == [1.0]


@pytest.mark.parametrize(("world", "fans"), [(4, (1, 2, 2)), (8, (2, 2, 2)), (12, (2, 2, 3)), (16, (2, 2, 4)), (32, (4, 2, 4)), (64, (4, 4, 4)), (128, (8, 4, 4)), (256, (8, 8, 4)), (512, (8, 8, 8)), (1024, (16, 8, 8))])
def test_tree_fanout(world, fans):
    assert K.tree_fanout(world) == fans


def test_tree_needs_a_multiple_of_four():
    with pytest.raises(ValueError):
        K.tree_fanout(6)


def test_tree_in_spark_like_the_kernel(spark):
    rng = np.random.default_rng(0)
    sets = [(np.sort(rng.normal(r, 2, 9)), float(1 + r)) for r in range(8)]
    want = K.tree_resample(sets, (12, 10), 8)[-1][0]
    df = spark.createDataFrame([(1, r, p.tolist(), w) for r, (p, w) in enumerate(sets)], "epoch int, rank int, pivots array<double>, weight double")
    got = pivots.tree_pivots(df, 8, (12, 10), ["epoch"]).first()
    assert np.allclose(got["pivots"], want[0]) and math.isclose(got["weight"], want[1])
    assert len(got["pivots"]) == 9 and math.isclose(want[1] * 8, sum(8 * w for _, w in sets))


def test_full_pivots_like_a_model(spark):
    rng = np.random.default_rng(3)
    rows = [(1, r, i, float(np.float32(x))) for r in range(4) for i, x in enumerate(rng.gamma(2, 3, 400))]
    df = spark.createDataFrame(rows, "epoch int, rank int, seq int, key float")
    got = {r["rank"]: r for r in pivots.full_pivots(df, "key", 8, 64, ["epoch", "rank"], ["seq"]).collect()}
    for rank in range(4):
        keys = np.array([k for _, r, _, k in rows if r == rank], np.float32)
        first, _ = K.combined_pivots(keys[:64], None, None, 9)
        edges = first.astype(np.float32)
        rest = keys[64:]
        at = np.searchsorted(edges, rest, side="right") - 1
        inside = (at >= 0) & (at < 8)
        want, weight = K.combined_pivots(rest[~inside], edges.astype(float).tolist(), np.bincount(at[inside], minlength=8).tolist(), 8)
        assert np.allclose(got[rank]["pivots"], want, atol=1e-5) and math.isclose(got[rank]["weight"], weight)


def test_every_key_gets_one_rank_and_partition(spark):
    df = spark.range(2000).select((F.rand(1) * 30 - 10).cast("float").alias("key"))
    edges = [0.0, 2.0, 4.0, 9.0, 15.0]
    placed = placement.place_by_range(df, "key", edges, purge=True).cache()
    assert placed.filter("dest IS NULL OR dest < 0 OR dest > 3").count() == 0
    moved = placement.to_destinations(placed, 4).withColumn("p", F.spark_partition_id())
    assert moved.filter("p <> dest").count() == 0 and moved.count() == 2000
    some = placement.place_by_range(df, "key", edges)
    assert some.filter("dest IS NULL").count() == df.filter("key < 0 OR key >= 15").count()
    kept, wait = placement.split_out_of_bounds(df, "key", edges)
    assert kept.count() + wait.count() == 2000


def test_records_without_destination_are_an_error(spark):
    df = spark.createDataFrame([(1, None)], "a int, dest int")
    with pytest.raises(Exception, match="no destination"):
        placement.to_destinations(df, 4).collect()


def test_ring_moves_few_keys(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    a = placement.place_by_ring(df, "k", 8, dest="a")
    both = placement.place_by_ring(a, "k", 9, dest="b")
    moved = both.filter("a <> b")
    assert moved.filter("b <> 8").count() == 0
    assert 150 < moved.count() < 900


def test_load_stddev_counts_empty_ranks(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (0,)], "dest int")
    got = balance.load_stddev(placement.destination_counts(df, 4)).first()["load_std"]
    assert math.isclose(got, np.std([4, 0, 0, 0]) / 1.0)


def test_suites_on_equal_epochs(spark):
    df = spark.range(8000).select((F.col("id") % 2 + 3).cast("int").alias("epoch"), (F.col("id") / 2 % 4).cast("int").alias("rank"), F.rand(5).cast("float").alias("key"), F.col("id").alias("seq"))
    rows = balance.load_suites(df, "key", 4, 16, 100, ["seq"]).collect()
    assert sorted((r["runtype"], r["epidx"]) for r in rows) == [("ep0pp", 0), ("ep0pp", 1), ("epxpp", 0), ("epxpp", 1), ("epxsub1pp", 1)]
    assert all(0 <= r["load_std"] < 0.2 for r in rows)


def test_approximate_edges_are_close(spark):
    df = spark.range(10000).select(F.col("id").cast("float").alias("key"))
    got = [r["pivot"] for r in pivots.approximate_edges(df, "key", 5).orderBy("k").collect()]
    assert np.allclose(got, [0, 2499, 4999, 7499, 9999], atol=2)


def test_calc_pivots(spark):
    df = spark.createDataFrame([(-1.0,), (-0.5,), (12.0,), (3.0,)], "key float")
    got = pivots.calc_pivots(df, "key", [0.0, 5.0, 10.0], [3.0, 1.0], 5).first()
    assert np.allclose(got["pivots"], [-1, 0, 2.5, 5, 12]) and got["weight"] == 2


def test_apportion():
    assert K.apportion([1, 2], 9) == [3, 6]
    assert sum(K.apportion([1, 1, 1], 10)) == 10
    assert K.apportion([0, 5], 4) == [0, 4]


@pytest.mark.parametrize(("bins", "n", "keys"), [(512, 64, 0), (512, 2048, 40), (512, 4096, 700), (8, 256, 512), (1, 16, 3)])
def test_pivots_of_large_states(bins, n, keys):
    """Many bins, most of them empty, beside keys on both sides: as many pivots as asked, never falling, and of equal weight."""
    rng = np.random.default_rng(bins + n)
    # no bin is without width: all weight of such a one lies at one value
    edges = np.cumsum(rng.gamma(2, 1, bins + 1)).astype(np.float32).astype(float)
    weights = np.where(rng.random(bins) < 0.8, 0, rng.integers(1, 3000, bins))
    weights[0] += 1
    outside = np.concatenate([edges[0] - rng.gamma(1, 1, keys // 2), edges[-1] + rng.gamma(1, 5, keys - keys // 2)]).astype(np.float32)
    got, weight = K.combined_pivots(outside, edges.tolist(), weights.tolist(), n)
    assert len(got) == n and (np.diff(got) >= 0).all()
    left, right = K.split_keys(outside, edges[0], edges[-1])
    assert math.isclose(weight * (n - 1), weights.sum() + len(left) + len(right))
    # as much weight below each pivot in the bins as its place says, to the width of what it lies in
    below = np.interp(got, edges, np.concatenate([[0], np.cumsum(weights)])) + np.searchsorted(left, got) + np.searchsorted(right, got)
    inside = (got > edges[0]) & (got < edges[-1])
    assert np.allclose(below[inside], (weight * np.arange(n))[inside], atol=1e-6 * weights.sum() + 1.01)
