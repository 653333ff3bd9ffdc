from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rangeloom.config import RunConfig
from rangeloom.streaming.adaptive import AdaptivePartitioner, InterEpochPolicy, IntraEpochPolicy, State, policy_of, run_stream

SCHEMA = "epoch int, rank int, key float, name string"


def batch(spark, epoch, n=400, shift=0.0, start=0):
    return spark.range(start, start + n).select(F.lit(epoch).alias("epoch"), (F.col("id") % 4).cast("int").alias("rank"), (F.rand(epoch) * 10 + shift).cast("float").alias("key"), F.concat(F.lit(f"{epoch}-"), F.col("id")).alias("name"))


def test_nothing_is_lost_and_bins_widen(spark, tmp_path):
    own = AdaptivePartitioner(spark, str(tmp_path / "a"), 4, IntraEpochPolicy(10_000, 50), (16, 16, 16))
    own.process(batch(spark, 1), 0)
    first = own.state()
    assert first.round_no == 1 and len(first.edges) == 5
    own.process(batch(spark, 1, 400, 5.0, 400), 1)
    second = own.state()
    assert second.edges[0] <= first.edges[0] and second.edges[-1] >= first.edges[-1] and second.round_no == 2
    own.process(batch(spark, 2, 400, 100.0), 2)
    assert own.state().edges[0] > 50
    own.finish()
    own.finish()
    rows = own.assigned()
    assert rows.count() == 1200 == rows.select("name").distinct().count()
    assert rows.filter("dest < 0 OR dest > 3").count() == 0
    assert {r["epoch"]: r["count"] for r in rows.groupBy("epoch").count().collect()} == {1: 800, 2: 400}


def test_a_batch_done_again_changes_nothing(spark, tmp_path):
    own = AdaptivePartitioner(spark, str(tmp_path / "b"), 4, IntraEpochPolicy(10_000, 50), (8, 8, 8))
    for _ in range(2):
        own.process(batch(spark, 1), 0)
        state = own.state().to_json()
    own.process(batch(spark, 1, start=400), 1)
    again = AdaptivePartitioner(spark, str(tmp_path / "b"), 4, IntraEpochPolicy(10_000, 50), (8, 8, 8))
    before = again.state().to_json()
    again.process(batch(spark, 1, start=400), 1)
    assert again.state().to_json() == before != state
    again.finish()
    assert again.assigned().count() == 800


def test_inter_epoch_keeps_its_bins(spark, tmp_path):
    own = AdaptivePartitioner(spark, str(tmp_path / "c"), 4, InterEpochPolicy(2, 120), (8, 8, 8))
    own.process(batch(spark, 1, 200), 0)
    assert own.state().edges is None and sum(own.state().waiting.values()) == 200
    own.process(batch(spark, 1, 400, 0.0, 200), 1)
    edges = own.state().edges
    assert edges is not None and own.state().triggered
    own.process(batch(spark, 2, 400, 50.0), 2)
    assert own.state().edges == edges
    # out of bounds goes to the last rank at once
    assert own.assigned().filter("epoch = 2 AND dest <> 3").count() == 0
    own.process(batch(spark, 3, 400, 50.0), 3)
    assert own.state().edges is None or own.state().edges[0] > 40
    own.finish()
    assert own.assigned().count() == 1400


def test_late_records(spark, tmp_path):
    for late, epochs in (("keep", {1, 2}), ("current", {2})):
        own = AdaptivePartitioner(spark, str(tmp_path / late), 4, IntraEpochPolicy(10_000, 50), (8, 8, 8), late)
        own.process(batch(spark, 2), 0)
        own.process(batch(spark, 1, start=400), 1)
        own.finish()
        rows = own.assigned()
        assert rows.count() == 800 and {r["epoch"] for r in rows.select("epoch").distinct().collect()} == epochs


def test_null_and_nan_keys(spark, tmp_path):
    own = AdaptivePartitioner(spark, str(tmp_path / "n"), 4, IntraEpochPolicy(10_000, 5), (8, 8, 8))
    rows = [(1, i % 4, float(i), f"k{i}") for i in range(40)] + [(1, 0, None, "null"), (1, 1, float("nan"), "nan")]
    own.process(spark.createDataFrame(rows, SCHEMA), 0)
    own.process(spark.createDataFrame([], SCHEMA), 1)
    own.finish()
    assert own.assigned().count() == 42
    assert own.assigned().filter("name IN ('null', 'nan') AND dest <> 0").count() == 0


def test_as_a_stream_like_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    batch(spark, 1).coalesce(1).write.mode("append").parquet(source)
    own = AdaptivePartitioner(spark, str(tmp_path / "out"), 4, IntraEpochPolicy(10_000, 50), (8, 8, 8))
    stream = lambda: spark.readStream.schema(batch(spark, 1).schema).parquet(source)
    run_stream(stream(), own, str(tmp_path / "cp"))
    batch(spark, 2, start=400).coalesce(1).write.mode("append").parquet(source)
    run_stream(stream(), own, str(tmp_path / "cp"))
    own.finish()
    assert own.assigned().count() == 800
    alone = AdaptivePartitioner(spark, str(tmp_path / "again"), 4, IntraEpochPolicy(10_000, 50), (8, 8, 8))
    alone.process(batch(spark, 1), 0)
    alone.process(batch(spark, 2, start=400), 1)
    assert alone.state().edges == own.state().edges


def test_policies():
    assert isinstance(policy_of(RunConfig()), IntraEpochPolicy)
    assert isinstance(policy_of(RunConfig(reneg_policy="inter_epoch")), InterEpochPolicy)
    p = IntraEpochPolicy(100, 5)
    assert p.should_renegotiate(State(writes={"0": 201}), {"0": 199})
    assert not p.should_renegotiate(State(writes={"0": 199, "1": 500}), {"0": 101})
    assert p.should_renegotiate(State(waiting={"3": 5}), {})
    assert State.from_json(State(epoch=3, edges=[1.0, 2.0]).to_json()).edges == [1.0, 2.0]


def test_wrong_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        AdaptivePartitioner(spark, str(tmp_path), 6, IntraEpochPolicy())
    with pytest.raises(ValueError):
        AdaptivePartitioner(spark, str(tmp_path), 4, IntraEpochPolicy(), late="drop")


def test_registered_query_adapts_within_epochs(spark, data, monkeypatch):
    """Each epoch comes in several batches by arrival, and every record once."""
    from rangeloom.plans import range_queries

    seen = []

    class Recorded(AdaptivePartitioner):
        def process(self, batch, batch_id):
            seen.extend((batch_id, r["epoch"], int(r["name"].split("-")[0])) for r in batch.collect())
            if batch_id == 0:
                super().process(batch, batch_id)

    monkeypatch.setattr(range_queries, "AdaptivePartitioner", Recorded)
    range_queries.adaptive_intra_epoch(spark, str(data))
    assert len(seen) == range_queries.line_particles(spark, str(data)).count()
    for epoch in {e for _, e, _ in seen}:
        spans = [[o for b, e, o in seen if (b, e) == (at, epoch)] for at in sorted({b for b, e, _ in seen if e == epoch})]
        assert len(spans) > 1 and all(max(a) < min(b) for a, b in zip(spans, spans[1:], strict=False))
