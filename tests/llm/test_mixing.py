from __future__ import annotations

import random

import numpy as np
import pytest

from rangeloom.llm import mixing as M

TARGET = [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 2)]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "source string, target_share double, max_repeats int")


@pytest.fixture(scope="module")
def sizes(spark):
    rng = random.Random(6)
    rows = [(i, "big", rng.randint(1, 400)) for i in range(3000)]
    rows += [(10_000 + i, "small", rng.randint(1, 400)) for i in range(300)] + [(20_000 + i, "tiny", rng.randint(1, 400)) for i in range(500)]
    rows += [(30_000, None, 9), (30_001, "other", 9), (30_002, "big", 0), (None, "big", 5), (30_003, "tiny", 5), (30_003, "tiny", 5)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").cache()


def test_shares_limits_and_whole_rounds(sizes, target):
    rows = M.mix_documents(sizes, target, block_tokens=4_000, shard_tokens=20_000).collect()
    total = sum(r["tokens"] for r in rows)
    uses: dict = {}
    for r in rows:
        uses.setdefault(r["source"], {}).setdefault(r["doc_id"], []).append(r["copy_no"])
    held = {"big": 3000, "small": 300, "tiny": 501}
    for source, share, most in TARGET:
        tokens = sum(r["tokens"] for r in rows if r["source"] == source)
        assert abs(tokens - share * total) <= 2 * 400, source
        counts = [len(c) for c in uses[source].values()]
        assert max(counts) <= most
        # again only after all were used equally often
        least = min(counts) if len(counts) == held[source] else 0
        assert max(counts) - least <= 1
        assert all(sorted(c) == list(range(len(c))) for c in uses[source].values())
    assert not {30_000, 30_001, 30_002, None} & {r["doc_id"] for r in rows}
    # the largest total: one source is used up
    assert any(abs(sum(r["tokens"] for r in rows if r["source"] == s) - most * sum(x["tokens"] for x in {r["doc_id"]: r for r in rows if r["source"] == s}.values())) <= 400 for s, _, most in TARGET)


def test_shards_mix_all_sources_and_places_are_numbered(sizes, target):
    rows = M.mix_documents(sizes, target, block_tokens=2_000, shard_tokens=100_000).collect()
    shards: dict = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert len(shards) > 2
    for members in shards.values():
        assert sorted(r["place"] for r in members) == list(range(len(members)))
        assert {r["source"] for r in members} == {"big", "small", "tiny"}
    again = M.mix_documents(sizes.repartition(7), target, block_tokens=2_000, shard_tokens=100_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("top", [1, 4, 512])
def test_deal_is_exact_and_even(spark, monkeypatch, top):
    """The tree is the same however much of it is made on the driver, and each source's blocks are cut without gaps."""
    monkeypatch.setattr(M, "TOP_NODES", top)
    names, quotas = ["a", "b", "c", "d"], [500, 37, 0, 1]
    rows = M.deal(spark, names, quotas, 12, 1).collect()
    for name, quota in zip(names, quotas, strict=True):
        at = 0
        for r in sorted((r for r in rows if r["source"] == name), key=lambda r: r["shard"]):
            assert r["start"] == at
            at += r["n"]
        assert at == quota
    per = [sum(r["n"] for r in rows if r["shard"] == i) for i in range(12)]
    assert max(per) - min(per) <= 4
    assert sorted(map(tuple, rows)) == [(n[0], names[i], n[2][i], n[3][i]) for n in M.leaves((0, 12, (0,) * 4, tuple(quotas)), 1) for i in range(4) if n[3][i]]


def test_deal_is_fair():
    """On average a shard gets its share of each source."""
    mean = np.mean([[n[3] for n in M.leaves((0, 4, (0, 0), (60, 40)), seed)] for seed in range(400)], axis=0)
    assert np.allclose(mean, [[15, 10]] * 4, atol=0.6)


def test_permutations_are_bijections():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 1024):
        factor, shift = M._permutation(n, rng)
        assert sorted((factor * b + shift) % n for b in range(n)) == list(range(n))


def test_budgets():
    assert M.budgets({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)}) == {"a": 100, "b": 100}
    assert M.budgets({"a": 100}, {"a": (0.5, 1), "b": (0.5, 3)}) == {"a": 100, "b": 0}
    assert M.budgets({"a": 100, "c": 30}, {"a": (0.4, 1), "b": (0.4, 3), "c": (0.2, 1)}) == {"a": 60, "b": 0, "c": 30}
    assert M.budgets({"a": 100, "b": 7}, {"a": (1.0, 2), "b": (0.0, 3)}) == {"a": 200}
    assert M.budgets({}, {}) == {}


def test_no_faults_and_what_faults_are(spark, sizes, target):
    mixture = M.mix_documents(sizes, target, block_tokens=3_000, shard_tokens=30_000).cache()
    assert {r["fault"]: r["n"] for r in M.mixture_faults(mixture, sizes, target).collect()} == dict.fromkeys(("repeats", "uneven", "twice", "shares", "places", "foreign"), 0)
    broken = mixture.unionByName(mixture.filter("source = 'big'"))
    found = {r["fault"]: r["n"] for r in M.mixture_faults(broken, sizes, target).collect()}
    assert found["repeats"] > 0 and found["twice"] > 0 and found["shares"] == 3 and found["places"] > 0


@pytest.mark.parametrize("block_tokens", [20, 300, 100_000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_documents_do_not_end_a_source(spark, seed, block_tokens):
    """A document that doesn't fit into what may still be given is passed over, and the smaller ones after it fill that."""
    rows = [(i, "a", 500) for i in range(10)] + [(100 + i, "b", 900) for i in range(12)] + [(200 + i, "b", 10) for i in range(300)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    target = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixture = M.mix_documents(sizes, target, block_tokens=block_tokens, seed=seed).cache()
    assert mixture.filter("source = 'b'").agg({"tokens": "sum"}).first()[0] == 5000
    assert not any(r["n"] for r in M.mixture_faults(mixture, sizes, target).collect())


def test_the_smallest_left_fills_where_it_comes_closer(spark):
    rows = [(1, "a", 900), (2, "b", 100), (3, "b", 1000), (4, "c", 100), (5, "c", 5000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    target = spark.createDataFrame([(s, 1 / 3, 1) for s in "abc"], "source string, target_share double, max_repeats int")
    for seed in (1, 2, 3):
        mixture = M.mix_documents(sizes, target, block_tokens=50, seed=seed).collect()
        assert sorted(r["doc_id"] for r in mixture) == [1, 2, 3, 4]


def test_nothing_to_mix(spark, sizes, target):
    assert M.mix_documents(sizes.limit(0), target).count() == 0
    assert M.mix_documents(sizes, target.limit(0)).count() == 0
    lonely = spark.createDataFrame([("big", 0.5, 1), ("absent", 0.5, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    # a source without documents gives nothing, and the report says so
    report = {r["source"]: r["share"] for r in M.shares(M.mix_documents(sizes, lonely), lonely).collect()}
    assert report == {"big": 1.0, "absent": 0.0, None: 0.0}


def test_report(sizes, target):
    mixture = M.mix_documents(sizes, target, block_tokens=4_000)
    rows = {r["source"]: r for r in M.shares(mixture, target).collect()}
    assert abs(sum(r["share"] for r in rows.values()) - 1) < 1e-9
    for source, share, most in TARGET:
        assert abs(rows[source]["share"] - share) < 0.005 and rows[source]["most_uses"] <= most
