from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeloom.llm import packing as K
from rangeloom.llm.tokens import encoder, token_sizes


def best_sum(counts, room):
    items = [v for v, c in counts.items() for _ in range(c)]
    return max((s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room), default=0)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 60))
def test_best_fill_like_all_subsets(counts, room):
    chosen = K.best_fill(dict(counts), sorted(counts, reverse=True), room)
    assert all(n <= counts[v] for v, n in chosen)
    assert sum(v * n for v, n in chosen) == best_sum(counts, room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_containers_hold_all_and_no_more(lengths):
    lengths = np.array(lengths)
    container, offset = K.fill_containers(lengths, 64)
    assert sorted(set(container)) == list(range(container.max() + 1))
    for c in set(container):
        at = np.flatnonzero(container == c)
        order = at[np.argsort(offset[at], kind="stable")]
        assert offset[order].tolist() == [0, *np.cumsum(lengths[order])[:-1].tolist()]
        assert lengths[order].sum() <= 64


def test_little_room_is_left():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6.5, 0.8, 5000).astype(int), 1, 4096)
    container, _ = K.fill_containers(lengths)
    used = lengths.sum() / ((container.max() + 1) * 4096)
    assert used > 0.995


@pytest.fixture(scope="module")
def sizes(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 40, 900, 4096, 4097, 8192, 10_000, rng.randint(1, 4096)])) for i in range(400)]
    rows += [(400, 0), (None, 50), (401, 60), (401, 70)]
    return spark.createDataFrame(rows, "doc_id bigint, tokens bigint").cache()


@pytest.mark.parametrize("group", [20_000, 90])
def test_every_token_has_one_place(sizes, group):
    want = {r["doc_id"]: r["tokens"] for r in sizes.collect() if r["doc_id"] is not None and r["tokens"]} | {401: 60}
    rows = K.pack_documents(sizes, group_docs=group).collect()
    by_doc: dict = {}
    by_container: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_container.setdefault(r["container_id"], []).append((r["offset"], r["tokens"]))
    assert {d: sum(r["tokens"] for r in rs) for d, rs in by_doc.items()} == want
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r["part_no"])
        assert [r["part_no"] for r in rs] == list(range(rs[0]["n_parts"]))
        assert rs[0]["n_parts"] == -(-want[d] // 4096)
        assert all(r["tokens"] == 4096 for r in rs[:-1])
    for spans in by_container.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) <= 4096
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_report_and_empty(spark, sizes):
    report = K.fill_report(K.pack_documents(sizes)).collect()
    assert sum(r["tokens"] + r["slack"] for r in report) == 4096 * sum(r["n_containers"] for r in report)
    assert K.pack_documents(sizes.limit(0)).count() == 0


def test_documents(spark):
    words = "the valve seat engages the gas inlet "
    docs = spark.createDataFrame([(1, words * 10), (2, words * 2000), (3, ""), (4, None), (5, "你好 " * 5000)], "doc_id bigint, text string").selectExpr("*", "9 AS tokens", "8 AS `offset`")
    tokens = {r["doc_id"]: r["tokens"] for r in token_sizes(docs).collect()}
    assert tokens == {i: len(encoder().encode_ordinary(t)) if t else 0 for i, t in [(1, words * 10), (2, words * 2000), (3, ""), (4, None), (5, "你好 " * 5000)]}
    assert sorted(r["doc_id"] for r in K.split_documents(docs).collect()) == [d for d in (1, 2, 5) if tokens[d] > 4096]


def test_special_strings_are_text(spark):
    assert len(encoder().encode_ordinary("<|endoftext|>")) > 1


def test_faults(spark):
    sizes = spark.createDataFrame([(i, 1 + i * 37 % 5000) for i in range(2000)], "doc_id bigint, tokens bigint")
    packed = K.pack_documents(sizes).cache()
    assert {r["fault"]: r["n"] for r in K.packing_faults(packed, sizes).collect()} == dict.fromkeys(("overfull", "gaps", "split", "tokens", "unused"), 0)
    lost = packed.filter("doc_id > 100").withColumn("tokens", packed["tokens"] + 1)
    found = {r["fault"]: r["n"] for r in K.packing_faults(lost, sizes).collect()}
    assert found["tokens"] == 2000 and found["gaps"] > 0
