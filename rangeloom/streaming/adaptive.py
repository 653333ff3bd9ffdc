"""Range assignment that adapts from batch to batch.

Bins are carried from micro-batch to micro-batch within an epoch, together with the records that no bin holds. A policy
says when new pivots are taken: the pivots of every source rank, over its bins and its waiting records, are merged by a
tree and become the bins. Waiting records are tried again after each round; at the end of an epoch those left go to
the rank at their end. Bins are a few numbers and live in a small versioned table, waiting records and assigned ones in
tables by batch, so a batch that is run again writes the same again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.config import RunConfig, SharedFiles
from rangeloom.functions import kernels
from rangeloom.functions.edges import as_float32, bin_index, out_of_bounds
from rangeloom.operators.pivots import pivots_from_keys, tree_pivots

#: A round takes about so many keys of each rank at most; more are sampled, as pivots of a sample are what a round is for.
PIVOT_KEYS = 100_000


@dataclass
class State:
    """What a partitioner carries: the epoch, its bins and their counts, rounds, and how much was written."""

    epoch: int = 0
    round_no: int = 0
    batch: int = -1
    edges: list[float] | None = None
    counts: list[int] = field(default_factory=list)
    total_counts: list[int] = field(default_factory=list)
    writes: dict[str, int] = field(default_factory=dict)
    waiting: dict[str, int] = field(default_factory=dict)
    triggered: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> State:
        return cls(**json.loads(text))


class Policy(Protocol):
    """When a partitioner takes new pivots, and what an epoch's start does to its bins."""

    def on_epoch(self, state: State) -> bool:
        """Whether the bins are dropped when the epoch begins."""

    def should_renegotiate(self, state: State, before: dict[str, int]) -> bool:
        """Whether a round is due, after a batch; ``before`` are the writes of each rank before it."""

    def waits(self, state: State) -> bool:
        """Whether all records wait, whatever the bins."""

    def clamps(self, state: State) -> bool:
        """Whether records out of bounds go to the end ranks at once."""


@dataclass
class IntraEpochPolicy:
    """New bins each epoch; a round when rank 0's writes pass a multiple of the interval or any rank's buffer is full."""

    interval: int = 500_000
    capacity: int = 512

    def on_epoch(self, state: State) -> bool:
        return True

    def should_renegotiate(self, state: State, before: dict[str, int]) -> bool:
        passed = state.writes.get("0", 0) // self.interval > before.get("0", 0) // self.interval
        return passed or any(n >= self.capacity for n in state.waiting.values())

    def waits(self, state: State) -> bool:
        return False

    def clamps(self, state: State) -> bool:
        return False


@dataclass
class InterEpochPolicy:
    """New bins every ``interval`` epochs: all records wait until rank 0's buffer is full, one round is made, and from
    then on records out of bounds go to the end ranks."""

    interval: int = 1
    capacity: int = 512

    def on_epoch(self, state: State) -> bool:
        return (state.epoch - 1) % self.interval == 0

    def should_renegotiate(self, state: State, before: dict[str, int]) -> bool:
        return not state.triggered and state.waiting.get("0", 0) >= self.capacity

    def waits(self, state: State) -> bool:
        return not state.triggered

    def clamps(self, state: State) -> bool:
        return state.triggered


def policy_of(config: RunConfig) -> Policy:
    if config.reneg_policy == "intra_epoch":
        return IntraEpochPolicy(config.reneg_interval, config.oob_capacity)
    return InterEpochPolicy(max(1, config.reneg_interval), config.oob_capacity)


class AdaptivePartitioner:
    """Assigns records (epoch, rank, key and any others) to ranks, batch by batch; use ``process`` in ``foreachBatch``.

    Below ``path`` are state/<batch>.json, assigned/batch=<n> and waiting/batch=<n>. Records of an epoch that is over keep
    their epoch and are placed by the present bins ('keep'), or are counted to the present epoch ('current').
    """

    def __init__(self, spark: SparkSession, path: str, ranks: int, policy: Policy, pivots: Sequence[int] = (256, 256, 256), late: str = "keep") -> None:
        if late not in ("keep", "current"):
            raise ValueError("late must be 'keep' or 'current'")
        kernels.tree_fanout(ranks)
        self.spark, self.path, self.ranks, self.policy, self.pivots, self.late = spark, path.rstrip("/"), ranks, policy, tuple(pivots), late
        self._files = SharedFiles(spark, self.path)

    def state(self, before: int | None = None) -> State:
        """The state after the last batch (before a given one)."""
        done = sorted(int(f[:-5]) for f in self._files.names("state") if f.endswith(".json"))
        done = [b for b in done if before is None or b < before]
        return State.from_json(self._files.read(f"state/{done[-1]:012d}.json")) if done else State()

    def _save(self, state: State) -> None:
        self._files.write(f"state/{state.batch:012d}.json", state.to_json())

    def _waiting(self, state: State, like: DataFrame) -> DataFrame:
        folder = f"waiting/batch={state.batch}"
        if state.batch < 0:
            return like.limit(0)
        if not self._files.exists(folder):
            raise FileNotFoundError(f"waiting records of batch {state.batch} are missing below {self.path}")
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{folder}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. Its epochs are taken in order; a new epoch closes the one before."""
        state = self.state(before=batch_id)
        current = batch.persist()
        assigned: list[DataFrame] = []
        waiting = self._waiting(state, batch)
        try:
            epochs = sorted(r["epoch"] for r in current.select("epoch").distinct().collect())
            for epoch in epochs or [state.epoch]:
                part = current.filter(F.col("epoch") == epoch)
                if epoch > state.epoch:
                    assigned.append(self._purge(waiting, state))
                    waiting = batch.limit(0)
                    state.epoch, state.writes, state.waiting = epoch, {}, {}
                    if self.policy.on_epoch(state) or state.edges is None:
                        state.edges, state.counts, state.triggered = None, [0] * self.ranks, False
                elif epoch < state.epoch and self.late == "current":
                    part = part.withColumn("epoch", F.lit(state.epoch))
                done, waiting = self._step(part, waiting, state)
                assigned.append(done)
            out = assigned[0]
            for more in assigned[1:]:
                out = out.unionByName(more)
            out.write.mode("overwrite").parquet(f"{self.path}/assigned/batch={batch_id}")
            waiting.write.mode("overwrite").parquet(f"{self.path}/waiting/batch={batch_id}")
            written = self.spark.read.schema(out.schema).parquet(f"{self.path}/assigned/batch={batch_id}")
            for r in written.filter(F.col("epoch") == state.epoch).groupBy("dest").count().collect():
                state.counts[r["dest"]] += r["count"]
            state.total_counts = state.total_counts or [0] * self.ranks
            for r in written.groupBy("dest").count().collect():
                state.total_counts[r["dest"]] += r["count"]
            state.batch = batch_id
            self._save(state)
        finally:
            current.unpersist()

    def _step(self, part: DataFrame, waiting: DataFrame, state: State) -> tuple[DataFrame, DataFrame]:
        before = dict(state.writes)
        for r in part.groupBy("rank").count().collect():
            state.writes[str(r["rank"])] = state.writes.get(str(r["rank"]), 0) + r["count"]
        every = waiting.unionByName(part)
        hold = self.policy.waits(state)
        left = every if hold or state.edges is None else every.filter(out_of_bounds(F.col("key"), state.edges) | F.col("key").isNull())
        state.waiting = {str(r["rank"]): r["count"] for r in left.groupBy("rank").count().collect()}
        if self.policy.should_renegotiate(state, before):
            self._round(every, state)
            hold = self.policy.waits(state)
        if hold or state.edges is None:
            return every.limit(0).withColumn("dest", F.lit(0)), every
        if self.policy.clamps(state):
            return every.withColumn("dest", F.coalesce(bin_index(F.col("key"), state.edges, force=True), F.lit(0))), every.limit(0)
        outside = out_of_bounds(F.col("key"), state.edges) | F.col("key").isNull()
        rest = every.filter(outside)
        state.waiting = {str(r["rank"]): r["count"] for r in rest.groupBy("rank").count().collect()}
        return every.filter(~outside).withColumn("dest", bin_index(F.col("key"), state.edges)), rest

    def _round(self, every: DataFrame, state: State) -> None:
        """New bins from the pivots of all ranks. What the bins held so far counts by the present counts, as part of rank 0's."""
        n = self.pivots[0]
        keyed = every.filter(F.col("key").isNotNull() & ~F.isnan("key"))
        held_counts = list(state.counts)
        if state.edges is not None:
            inside = keyed.filter(~out_of_bounds(F.col("key"), state.edges))
            for r in inside.groupBy(bin_index(F.col("key"), state.edges).alias("bin")).count().collect():
                held_counts[r["bin"]] += r["count"]
            keyed = keyed.filter(out_of_bounds(F.col("key"), state.edges))
        # of a rank with many keys outside, a sample of PIVOT_KEYS or so by a hash stands for all, with their weight
        sizes = {r["rank"]: r["n"] for r in keyed.groupBy("rank").agg(F.count("*").alias("n")).collect()}
        most = max(sizes.values(), default=0)
        if most > PIVOT_KEYS:
            share = F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(float(PIVOT_KEYS)) / F.element_at(F.create_map(*[x for r, c in sizes.items() for x in (F.lit(r), F.lit(float(c)))]), F.col("rank")))
            sampled = keyed.filter(F.pmod(F.xxhash64(*keyed.columns), F.lit(1 << 30)) < share)
            taken = {r["rank"]: r["n"] for r in sampled.groupBy("rank").agg(F.count("*").alias("n")).collect()}
            of = F.element_at(F.create_map(*[x for r, c in taken.items() for x in (F.lit(r), F.lit(sizes[r] / c))]), F.col("rank"))
            sets = pivots_from_keys(sampled, "key", n, ["rank"]).withColumn("weight", F.col("weight") * of)
        else:
            sets = pivots_from_keys(keyed, "key", n, ["rank"])
        if state.edges is not None and sum(held_counts):
            held, weight = kernels.combined_pivots(np.zeros(0, np.float32), state.edges, held_counts, n)
            sets = sets.unionByName(self.spark.createDataFrame([(0, held.tolist(), float(weight))], sets.schema))
        merged = tree_pivots(sets, self.ranks, self.pivots[1:3]).first()
        if merged is None or merged["weight"] <= 0:
            return
        new = as_float32(merged["pivots"])
        if state.edges is not None:
            # bins never shrink within an epoch
            new[0], new[-1] = min(new[0], state.edges[0]), max(new[-1], state.edges[-1])
        state.edges, state.round_no, state.triggered = new, state.round_no + 1, True

    def _purge(self, waiting: DataFrame, state: State) -> DataFrame:
        """Waiting records to the rank at their end; without any bins, to rank 0."""
        if state.edges is None:
            return waiting.withColumn("dest", F.lit(0))
        return waiting.withColumn("dest", F.coalesce(bin_index(F.col("key"), state.edges, force=True), F.lit(0)))

    def finish(self) -> None:
        """End the last epoch: what still waits is placed. Doing it twice changes nothing."""
        state = self.state()
        folder = f"waiting/batch={state.batch}"
        if state.batch < 0:
            return
        if not self._files.exists(folder):
            raise FileNotFoundError(f"waiting records of batch {state.batch} are missing below {self.path}")
        waiting = self.spark.read.parquet(f"{self.path}/{folder}")
        if waiting.columns and not waiting.isEmpty():
            self._purge(waiting, state).write.mode("overwrite").parquet(f"{self.path}/assigned/batch={state.batch + 1_000_000_000}")

    def assigned(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/assigned")


def run_stream(stream: DataFrame, partitioner: AdaptivePartitioner, checkpoint: str):
    """Feed a stream through a partitioner until what is available is read."""
    query = stream.writeStream.foreachBatch(partitioner.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
