"""Layouts, manifests, lookups, sampling and monitoring."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.config import RunConfig, clean, materialize, shared_dir
from rangeloom.functions import records
from rangeloom.functions import scalar as S
from rangeloom.operators import histograms, lookup, metrics, sampling, stores
from rangeloom.sources import generate, traces


@pytest.fixture(scope="module")
def particles(spark):
    rows = [(e, r, s, f"n{(s * 4 + r) % 37}", float((s * 7 + r * 3 + e) % 50), bytearray(f"<{e}.{r}.{s}>".encode())) for e in (1, 2, 3) for r in range(4) for s in range(25)]
    return spark.createDataFrame(rows, "epoch int, rank int, seq int, name string, key float, payload binary").cache()


def values(particles, names):
    out = {}
    for r in particles.collect():
        if r["name"] in names:
            out.setdefault(r["name"], []).append((r["epoch"], bytes(r["payload"])))
    return {n: b"".join(p for _, p in sorted(v)) for n, v in out.items()}


@pytest.mark.parametrize("radix", [0, 1])
@pytest.mark.parametrize("layout", ["inline", "kvsep", "filter"])
def test_layouts_give_back_what_was_written(spark, particles, tmp_path, layout, radix):
    path = f"{tmp_path}/{layout}"
    stores.write_store(particles, path, layout, 4, radix=radix)
    names = spark.createDataFrame([("n3",), ("n20",), ("none",), ("n3",)], "name string")
    data = lookup.read_store(spark, path)
    if layout == "inline":
        found = lookup.lookup(data, names, 4, radix)
    elif layout == "kvsep":
        found = lookup.dereference(lookup.lookup(data, names, 4, radix), lookup.read_log(spark, path))
    else:
        found = lookup.probe(names, lookup.read_filter(spark, path), data, 4, radix)
        assert found.filter("NOT found").count() == 0
    got = {r["name"]: bytes(r["value"]) for r in lookup.binary_values_of(found).collect()}
    assert got == values(particles, {"n3", "n20"})
    with pytest.raises(Exception, match="(?i)exist"):
        stores.write_store(particles, path, layout, 4, radix=radix)


def test_range_layout_reads_few_ranks(spark, particles, tmp_path):
    edges = [5.0, 15.0, 25.0, 30.0, 45.0]
    stores.write_store(particles, f"{tmp_path}/r", "range", 4, edges=edges)
    assert lookup.read_bounds(spark, f"{tmp_path}/r") == edges
    assert lookup.range_ranks(edges, 16.0, 26.0) == [1, 2] and lookup.range_ranks(edges, 0, 1) == [0] and lookup.range_ranks(edges, 99, 100) == [3] and lookup.range_ranks(edges, 3, 3) == []
    got = lookup.range_scan(lookup.read_store(spark, f"{tmp_path}/r"), "key", 16.0, 26.0, edges)
    assert got.count() == particles.filter("key >= 16 AND key < 26").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(key)" in plan


def test_one_name_reads_one_partition(spark, particles, tmp_path):
    stores.write_store(particles, f"{tmp_path}/i", "inline", 4)
    found = lookup.lookup_one(lookup.read_store(spark, f"{tmp_path}/i"), "n3", 4)
    assert found.count() == particles.filter("name = 'n3'").count()
    assert "rank#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]


def test_no_such_layout(particles, tmp_path):
    with pytest.raises(ValueError):
        stores.write_store(particles, f"{tmp_path}/x", "other", 4)
    with pytest.raises(ValueError):
        stores.write_store(particles, f"{tmp_path}/x", "range", 4)


def test_a_filter_may_be_wrong(spark, particles):
    wrong = stores.name_filter(particles, 4).withColumn("src_rank", F.lit(3)).distinct()
    found = lookup.probe(spark.createDataFrame([("n3",)], "name string"), wrong, particles.filter("rank <> 3"), 4).collect()
    assert found and all(not r["found"] and r["payload"] is None for r in found)


def test_limits(particles):
    assert stores.limit_writes(particles, 10, ["epoch", "rank"], ["seq"]).count() == 120
    assert stores.limit_writes(particles, 10, ["epoch", "rank"], ["seq"], legacy=True).count() == 36
    assert stores.limit_writes(particles, 0, ["epoch"], ["seq"]).count() == particles.count()


def test_manifest(spark, tmp_path):
    stores.manifest(spark, f"{tmp_path}/m", {"num_epochs": 3, "key_size": 8, "comm_sz": 4, "skip_checksums": True}, "wisc")
    got = stores.read_manifest(spark, f"{tmp_path}/m")
    assert got == {"num_epochs": "3", "key_size": "8", "comm_sz": "4", "skip_checksums": "1", "fmt": "wisc"}
    assert stores.parse_manifest(["key_size=8", "comm_sz=2", "odd=1", "no equals"]) == {"key_size": "8", "comm_sz": "2"}
    for bad in (["key_size=0", "comm_sz=2"], ["key_size=8"]):
        with pytest.raises(ValueError):
            stores.parse_manifest(bad)
    with pytest.raises(ValueError):
        stores.manifest(spark, f"{tmp_path}/m2", {"odd": 1})


def test_names(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "rank int, name string")
    stores.write_names(df, f"{tmp_path}/n")
    assert sorted(tuple(r) for r in stores.read_names(spark, f"{tmp_path}/n").collect()) == [(0, "a"), (1, "b"), (1, "c")]
    os.makedirs(f"{tmp_path}/f")
    for rank in (3, 12):
        with open(f"{tmp_path}/f/NAMES-{rank:07d}.txt", "w") as f:
            f.write(f"x{rank}\n")
    assert sorted(tuple(r) for r in stores.read_names(spark, f"{tmp_path}/f").collect()) == [(3, "x3"), (12, "x12")]


def test_extraction(spark, tmp_path):
    stores.extract_files(spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b""))], "name string, value binary"), f"{tmp_path}/e")
    assert {n: open(f"{tmp_path}/e/{n}", "rb").read() for n in os.listdir(f"{tmp_path}/e")} == {"a": b"12", "b": b""}
    with pytest.raises(Exception, match="not a file name"):
        stores.extract_files(spark.createDataFrame([("../a", bytearray(b"12"))], "name string, value binary"), f"{tmp_path}/e")


def test_sampled_lookups(particles, spark):
    picked = lookup.sample_names(particles.select("rank", "name").distinct(), 5, seed=1, ranks=[0, 2])
    assert {r["rank"]: r["count"] for r in picked.groupBy("rank").count().collect()} == {0: 5, 2: 5}
    every = lookup.lookup_everywhere(particles, particles.filter("rank = 0"), 4)
    assert every.count() == particles.filter("rank = 0").select("name").distinct().count() * 4
    assert every.agg(F.sum("hits")).first()[0] == particles.join(particles.filter("rank = 0").select("name").distinct(), "name", "left_semi").count()


def test_stable_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3), ("c", 2), ("c", 2), ("c", 3), ("d", 1), ("d", 2), ("d", 2)], "name string, epoch int")
    got = {r["name"]: (r["n"], r["valid"]) for r in sampling.stable_names(df, 3).collect()}
    # one more for each write, so two writes in an epoch make up for a gap
    assert got == {"a": (3, True), "b": (2, False), "d": (3, True)}
    assert sampling.valid_names(df, 3, threshold=0).count() == 0
    assert sampling.valid_names(df, 3, threshold=1_000_000).count() == 2


def test_log_histogram_like_counting(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(3, 3, 500), [0.0, 1.0, 2.0, 1e9, 9e9, 1e200]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    hist = histograms.log_histogram(df, "v").cache()
    limits = histograms.LIMITS
    assert len(limits) == 142 and limits == sorted(limits) and limits[9:12] == [10, 12, 14]
    want: dict = {}
    for v in x:
        b = next((i for i, e in enumerate(limits) if v < e), 141)
        want[b] = want.get(b, 0) + 1
    assert {r["bucket"]: r["n"] for r in hist.collect()} == want
    got = {r["p"]: r["value"] for r in histograms.histogram_percentile(hist, [0, 10, 50, 99, 100]).collect()}
    for p, value in got.items():
        total, upto, answer = len(x) * p / 100, 0, max(x)
        for b in sorted(want):
            upto += want[b]
            if upto >= total:
                left, right = (0 if b == 0 else limits[b - 1]), limits[b]
                answer = min(max(left + (right - left) * (total - upto + want[b]) / want[b], min(x)), max(x))
                break
        assert math.isclose(value, answer, rel_tol=1e-9), p
    halves = histograms.log_histogram(df.filter("v < 20"), "v").unionByName(histograms.log_histogram(df.filter("v >= 20"), "v"))
    assert sorted(map(tuple, histograms.add_histograms(halves).select("bucket", "n", "num").collect())) == sorted(map(tuple, hist.select("bucket", "n", "num").collect()))
    assert math.isclose(histograms.histogram_average(hist).first()["avg"], x.sum() / len(x), rel_tol=1e-9)


def test_monitoring(spark):
    df = spark.createDataFrame([(1, 0, "a", 5), (1, 0, "a", 7), (1, 0, "b", 1), (1, 1, "a", 2)], "epoch int, rank int, name string, v int")
    assert {r["rank"]: r["collisions"] for r in metrics.collisions(df).collect()} == {0: 1, 1: 0}
    got = metrics.latency_summary(df, "v", ["epoch"]).first()
    assert (got["n"], got["avg"], got["median"], got["min"], got["max"], got["total"]) == (4, 3.75, 2, 1, 7, 15)
    many = spark.range(20001).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 20001).alias("v"))
    for r in metrics.latency_summary(many, "v", ["g"]).collect():
        mine = sorted(x["v"] for x in many.filter(F.col("g") == r["g"]).collect())
        assert (r["median"], r["n"]) == (mine[(len(mine) - 1) // 2], len(mine))
    cum = spark.createDataFrame([(0, 1, 5), (0, 2, 9), (0, 3, 9)], "rank int, epoch int, w int")
    assert [r["d_w"] for r in metrics.epoch_deltas(cum, ["w"]).orderBy("epoch").collect()] == [5, 4, 0]
    checks = spark.createDataFrame([(1, 1, 2, 3, 3, 3, 3), (2, 1, 1, 3, 3, 3, 3), (3, 1, 2, 3, 3, 2, 3), (4, 1, 2, 3, 3, None, 3)], "epoch int, local int, foreign int, writes int, sent int, delivered int, received int")
    assert sorted(r["epoch"] for r in metrics.violations(checks).collect()) == [2, 3, 4]
    arrived = spark.createDataFrame([(1, 3, 10), (1, 2, 10), (1, 0, 15)], "epoch int, rank int, t int")
    assert tuple(metrics.first_to_arrive(arrived, "t", "rank", ["epoch"]).first()) == (1, 2, 10, 5)
    assert tuple(metrics.round_summary(spark.createDataFrame([(1,), (2,), (4,)], "us bigint"), "us").first())[:2] == (3, 2)


def test_ids_names_and_records(spark):
    import base64

    df = spark.createDataFrame([(0, 0), (5, 17), (200, 2**20)], "r int, i bigint")
    rows = df.select("r", "i", S.particle_name(S.particle_id(F.col("r"), F.col("i"))).alias("n"), S.particle_name(S.particle_id(F.col("r"), F.col("i"), 32), 8).alias("w")).collect()
    for r in rows:
        assert r["n"] == base64.b64encode(((r["r"] << 28) | r["i"]).to_bytes(8, "little")[:6]).decode()
        assert r["w"] == base64.b64encode(((r["r"] << 32) | r["i"]).to_bytes(8, "little")).decode().rstrip("=")
    odd = np.array([1.5, -1.5, 0.0, -0.0, 1e-45, -1e-40, 3.4e38, np.inf, -np.inf, np.nan, 0.1, 123456.789], np.float32)
    back = spark.createDataFrame([(i, bytearray(b"?" + x.tobytes())) for i, x in enumerate(odd)], "i int, d binary").select("i", records.key_at(F.col("d"), 1).alias("k")).orderBy("i").collect()
    assert np.array_equal(np.array([r["k"] for r in back], np.float32), odd, equal_nan=True)
    data = spark.createDataFrame([(bytearray(b"xx" + np.float32(1.5).tobytes() + b"y"),), (bytearray(b"xx"),), (None,)], "d binary")
    assert [r["k"] for r in data.select(records.key_at(F.col("d"), 2).alias("k")).collect()] == [1.5, None, None]
    packed = spark.createDataFrame([(bytearray(b"ab"), bytearray(b"\x80c"))], "k binary, v binary").select(records.pack_record(F.col("k"), F.col("v"), 6).alias("p")).first()["p"]
    assert bytes(packed) == b"ab\x80c\x00\x00"
    parts = spark.createDataFrame([([bytearray(b"a" * 200), bytearray(b"b" * 100)],)], "p array<binary>")
    assert bytes(parts.select(records.written(F.col("p")).alias("w")).first()["w"]) == b"a" * 200 + b"b" * 55


def test_units(spark):
    row = spark.range(1).select(S.pretty_size(F.lit(3 * 2**20)).alias("a"), S.pretty_size(F.lit(1500), binary=False).alias("b"), S.pretty_duration(F.lit(0.0025)).alias("c"), S.pretty_number(F.lit(12)).alias("d"), S.pretty_duration(F.lit(7200)).alias("e")).first()
    assert tuple(row) == ("3.00 MiB", "1.50 KB", "2.50 ms", "12.00", "2.00 hrs")


def test_traces(spark, tmp_path):
    keys = {(ts, r): np.arange(r + 2, dtype=np.float32) + ts for ts in (9, 100, 20) for r in range(3)}
    for (ts, r), k in keys.items():
        traces.write_trace(k, str(tmp_path), ts, r)
    rows = traces.with_epochs(traces.read_traces(spark, str(tmp_path))).cache()
    assert {r["ts"]: r["epoch"] for r in rows.collect()} == {9: 0, 20: 1, 100: 2}
    got: dict = {}
    for r in rows.collect():
        got.setdefault((r["ts"], r["rank"]), []).append((r["seq"], r["key"]))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: v.tolist() for k, v in keys.items()}
    assert {(r["ts"], r["rank"]): r["n"] for r in traces.trace_sizes(spark, str(tmp_path)).collect()} == {k: len(v) for k, v in keys.items()}
    assert {r["n_ranks"] for r in traces.rank_counts(rows).collect()} == {3}
    assert {r["rank"] for r in traces.scaled_ranks(rows, 7, 3).collect()} == set(range(7))
    assert traces.replayed(rows, "9:2,20:0").count() == 9 * 2 + 9
    with open(f"{tmp_path}/T.9/eparticle.9.3", "wb") as f:
        f.write(b"abc")
    with pytest.raises(Exception, match="not whole floats"):
        traces.read_traces(spark, str(tmp_path)).collect()


def test_state_dump():
    text = "pivot range: (0.5 2.5), particle_cnt: 44\nrbc: 1,2,\n3 (3)\nbin: 0.5, 1.5 (2)\n"
    assert traces.parse_state(text) == {"rmin": 0.5, "rmax": 2.5, "particle_cnt": 44.0, "rbc": [1, 2, 3], "bin": [0.5, 1.5]}
    with pytest.raises(ValueError):
        traces.parse_state("rbc: 1,2 (3)")


@pytest.mark.parametrize("pattern", generate.PATTERNS)
def test_generated_keys(spark, pattern):
    df = generate.generate_keys(spark, [1, 0, 3], 0.0, 30.0, 800, pattern, 4, 1).cache()
    assert df.count() == 800 and {r["count"] for r in df.groupBy("rank").count().collect()} == {200}
    by_bin = {r["bin"]: r["count"] for r in df.groupBy("bin").count().collect()}
    assert set(by_bin) == {0, 2}
    if pattern == "shuffle_skew":
        assert df.filter("key <> bin").count() == 0
    else:
        assert df.filter("key < bin * 10 OR key >= bin * 10 + 10").count() == 0
        assert by_bin == {0: 200, 2: 600} or pattern == "random"
    if pattern == "sequential":
        assert df.filter("bin = 0").agg(F.max("seq")).first()[0] == 49
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, generate.generate_keys(spark, [1, 0, 3], 0.0, 30.0, 800, pattern, 4, 1).collect()))


def test_generator_refuses(spark):
    with pytest.raises(NotImplementedError):
        generate.generate_keys(spark, [1], 0, 1, 4, "rank_sequential")
    with pytest.raises(ValueError):
        generate.generate_keys(spark, [1], 0, 1, 5, "random", 2)


def test_simulation(spark):
    df = generate.simulate(spark, 2, 4, 10).collect()
    assert len(df) == 80 and len({(r["epoch"], r["name"]) for r in df}) == 80
    assert {len(r["payload"]) for r in df} == {40} and {len(r["name"]) for r in df} == {8}
    assert {(r["epoch"], r["rank"], r["key"]) for r in df} == {(e, r, float(2 * (e - 1) + r)) for e in (1, 2) for r in range(4)}


def test_config(spark):
    got = RunConfig.from_env("X_", {"X_SKIP_SAMPLING": "1", "X_OOB_CAPACITY": "7", "X_PIVOTS_PER_STAGE": "4,5,6", "X_IGNORE_DIRS": "/a:/b", "X_ODD": "y", "OTHER": "1"})
    assert (got.skip_sampling, got.oob_capacity, got.pivots_per_stage, got.ignore_dirs, dict(got.extra)) == (True, 7, (4, 5, 6), ("/a", "/b"), {"odd": "y"})
    assert not S.env_truth("0") and not S.env_truth("") and not S.env_truth(None) and S.env_truth("no")
    for bad in ({"layout": "x"}, {"reneg_policy": "periodic"}, {"key_size": 8}, {"receiver_radix": 9}, {"filedata_size": 300}, {"pivots_per_stage": (1, 1, 9000)}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_written_tables_and_their_removal(spark):
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.filter("x = 8").first()["id"] == 4
    folder = shared_dir(spark).removeprefix("file://") + "/rangeloom"
    assert os.path.isdir(folder)
    clean(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("rows_a_batch", ["10000", "3"])
def test_running_sums_over_many_tasks(spark, rows_a_batch):
    """One group holds most rows, and its sums go on from task to task."""
    import random

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, rng.choice([0, 5, 7, None])) for i in range(700)] + [(3, 0, 4)]
    df = spark.createDataFrame(rows, "g int, i int, v int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = {(r["g"], r["i"]): r["s"] for r in stores.with_running_sum(df, F.col("v"), "s", ["g"], ["i"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, upto = {}, {}
    for g, i, v in rows:
        want[g, i] = upto.get(g, 0)
        upto[g] = upto.get(g, 0) + (v or 0)
    assert got == want
    assert stores.with_running_sum(df.limit(0), F.col("v"), "s", ["g"], ["i"]).count() == 0


def test_monitor_tables_and_appended_suites(spark, tmp_path):
    from rangeloom.operators import balance

    rows = [(1, 0, 5), (1, 1, None), (2, 0, 7)]
    df = spark.createDataFrame(rows, "epoch int, rank int, writes int")
    out = str(tmp_path / "monitor")
    metrics.write_monitor(df, out)
    metrics.write_monitor(df.filter("epoch = 2").withColumn("writes", F.lit(8)), out)
    back = spark.read.parquet(f"{out}/bin")
    assert sorted((r["epoch"], r["rank"], r["writes"]) for r in back.collect()) == [(1, 0, 5), (1, 1, None), (2, 0, 8)]
    assert sorted(r["value"] for r in spark.read.text(f"{out}/txt").collect()) == ["rank=0 writes=5", "rank=0 writes=8", "rank=1 writes="]
    suite = spark.createDataFrame([("epxpp", 8, 16, 0, 0.25)], "runtype string, nranks int, pvtcnt int, epidx int, load_std double")
    for _ in range(2):
        balance.append_suites(suite, str(tmp_path / "suites"))
    assert [tuple(r) for r in balance.read_suites(spark, str(tmp_path / "suites")).collect()] == [("epxpp", 8, 16, 0, 0.25)] * 2


def test_perf_log_by_intervals(spark):
    rows = [(5, "a", "1"), (99, "a", "2"), (100, "a", "3"), (50, "b", None), (None, "a", "9"), (7, None, "9")]
    df = spark.createDataFrame(rows, "ms bigint, stat string, v string")
    got = sorted(tuple(r) for r in metrics.perf_log(df, "ms", "stat", "v").collect())
    assert got == [(0, "a", "2"), (0, "b", None), (100, "a", "3")]
