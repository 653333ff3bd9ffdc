"""Synthetic inputs: keys drawn to given bin weights, and the particles of a simulation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions.kernels import apportion
from rangeloom.functions.scalar import particle_id, particle_name

PATTERNS = ("sequential", "random", "shuffle_skew")


def fit_quota(counts: Sequence[int], quota: int, seed: int) -> list[int]:
    """Counts taken down at random, one at a time, until they add up to ``quota``."""
    counts = np.array(counts, np.int64)
    surplus = int(counts.sum()) - quota
    if surplus < 0:
        raise ValueError("the quota is larger than the counts")
    taken = np.random.default_rng(seed).multivariate_hypergeometric(counts, surplus, method="marginals") if surplus else 0
    return (counts - taken).tolist()


def generate_keys(spark: SparkSession, weights: Sequence[float], lo: float, hi: float, total: int, pattern: str, ranks: int = 1, seed: int = 0) -> DataFrame:
    """``total`` keys over equally wide bins in [lo, hi) by their weights: rank, seq, bin, key.

    'sequential' goes through the bins in order, 'random' mixes them, and 'shuffle_skew' mixes them and gives the bin's
    number for a key. With several ranks each gets total / ranks keys, which must be whole.
    """
    if pattern == "rank_sequential":
        raise NotImplementedError("rank_sequential has no definition")
    if pattern not in PATTERNS:
        raise ValueError(f"pattern must be one of {PATTERNS}")
    if total % ranks:
        raise ValueError("each rank must get as many keys")
    each = total // ranks
    width = (hi - lo) / len(weights)
    rows = []
    for rank in range(ranks):
        counts = fit_quota(apportion(weights, total), each, seed + rank) if pattern == "random" and ranks > 1 else apportion(weights, each)
        rows += [(rank, b, int(n)) for b, n in enumerate(counts) if n]
    plan = spark.createDataFrame(rows, "rank int, bin int, n bigint").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))
    drawn = plan.select("rank", "bin", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i"))
    # from a hash, so that a lost task gives the same keys again
    u = F.pmod(F.xxhash64(F.lit(seed), "rank", "bin", "i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    key = F.col("bin").cast("float") if pattern == "shuffle_skew" else (F.lit(lo) + (F.col("bin") + u) * F.lit(width)).cast("float")
    order = ["bin", "i"] if pattern == "sequential" else [F.xxhash64(F.lit(seed + 1), "rank", "bin", "i"), "bin", "i"]
    seq = F.row_number().over(Window.partitionBy("rank").orderBy(*order)) - 1
    return drawn.select("rank", seq.cast("bigint").alias("seq"), "bin", key.alias("key"))


def simulate(spark: SparkSession, dumps: int, ranks: int, per_rank: int, shift: int = 28, wide: bool = False, payload_bytes: int = 40, energy: Column | None = None) -> DataFrame:
    """The particles of a simulation: epoch (from 1), rank, seq, name, key, payload; one record a particle and dump.

    Names are the base64 of the particle's id. The key is its rank plus two a dump, or ``energy``.
    """
    n = dumps * ranks * per_rank
    at = spark.range(n).select((F.col("id") / (ranks * per_rank)).cast("int").alias("d"), (F.col("id") / per_rank % ranks).cast("int").alias("rank"), (F.col("id") % per_rank).alias("seq"))
    name = particle_name(particle_id(F.col("rank"), F.col("seq"), 32 if wide else shift), 8 if wide else 6)
    key = (F.col("d") * 2 + F.col("rank")).cast("float") if energy is None else energy.cast("float")
    data = F.substring(F.repeat(F.sha2(F.concat_ws("/", "d", "rank", "seq").cast("binary"), 256), -(-payload_bytes // 64)), 1, payload_bytes).cast("binary")
    return at.select((F.col("d") + 1).alias("epoch"), "rank", "seq", name.alias("name"), key.alias("key"), data.alias("payload"))
