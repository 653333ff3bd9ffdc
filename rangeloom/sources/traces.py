"""Traces of keys: folders T.<ts> with files eparticle.<ts>.<rank> of packed 32-bit floats; and dumps of pivot states."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PATH = r"T\.(\d+)/[A-Za-z_]+\.(\d+)\.(\d+)$"


def read_traces(spark: SparkSession, root: str) -> DataFrame:
    """All keys below ``root``: ts, rank, seq (the key's place in its file, from 0), key. A file that is no whole number of floats is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*.*").load(f"{root.rstrip('/')}/T.*")
    named = files.select(F.regexp_extract("path", _PATH, 1).cast("int").alias("ts"), F.regexp_extract("path", _PATH, 3).cast("int").alias("rank"), "path", "content")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ts, rank, path, content in zip(frame["ts"], frame["rank"], frame["path"], frame["content"], strict=True):
                if len(content) % 4:
                    raise ValueError(f"not whole floats: {path}")
                keys = np.frombuffer(content, "<f4")
                yield pd.DataFrame({"ts": ts, "rank": rank, "seq": np.arange(len(keys)), "key": keys})

    return named.mapInPandas(unpack, "ts int, rank int, seq bigint, key float")


def trace_sizes(spark: SparkSession, root: str) -> DataFrame:
    """ts, rank and n (keys) of every trace file; the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*.*").load(f"{root.rstrip('/')}/T.*")
    return files.select(F.regexp_extract("path", _PATH, 1).cast("int").alias("ts"), F.regexp_extract("path", _PATH, 3).cast("int").alias("rank"), (F.col("length") / 4).cast("bigint").alias("n"))


def with_epochs(traces: DataFrame) -> DataFrame:
    """Traces with ``epoch``, the place of their ts in numeric order, from 0. The steps are few and are broadcast."""
    steps = traces.select("ts").distinct()
    numbered = steps.select("ts", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1).alias("epoch"))
    return traces.join(F.broadcast(numbered), "ts")


def rank_counts(traces: DataFrame) -> DataFrame:
    """How many ranks each step has: ts, n_ranks, the largest rank and one."""
    return traces.groupBy("ts").agg((F.max("rank") + 1).alias("n_ranks"))


def scaled_ranks(traces: DataFrame, n_ranks: int, trace_ranks: int) -> DataFrame:
    """Traces of ``trace_ranks`` ranks spread to more or fewer: rank r takes that of trace rank r modulo trace_ranks."""
    spark = traces.sparkSession
    wanted = spark.range(n_ranks).select(F.col("id").cast("int").alias("rank"), F.pmod("id", F.lit(trace_ranks)).cast("int").alias("_trace"))
    return traces.withColumnRenamed("rank", "_trace").join(F.broadcast(wanted), "_trace").drop("_trace")


def replayed(traces: DataFrame, repeats: str | Mapping[int, int]) -> DataFrame:
    """Traces replayed by a dump map ``ts:times,...``: each step ``times`` times over, with ``dump`` from 0; others once."""
    if isinstance(repeats, str):
        repeats = {int(a): int(b) for a, b in (x.split(":") for x in repeats.split(",") if x)}
    if any(n < 0 for n in repeats.values()):
        raise ValueError("a step cannot be replayed fewer than 0 times")
    table = F.broadcast(traces.sparkSession.createDataFrame(list(repeats.items()) or [(-1, 1)], "ts int, times int"))
    times = F.coalesce("times", F.lit(1))
    counted = traces.join(table, "ts", "left").filter(times > 0)
    return counted.withColumn("dump", F.explode(F.sequence(F.lit(0), times - 1))).drop("times")


def write_trace(keys: np.ndarray, root: str, ts: int, rank: int) -> str:
    """One trace file; for tests and small inputs."""
    import os

    folder = os.path.join(root, f"T.{ts}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"eparticle.{ts}.{rank}")
    np.asarray(keys, "<f4").tofile(path)
    return path


def parse_state(text: str) -> dict[str, object]:
    """A dump of one rank's pivot state: its range, and the vectors rbc and bin, whose lengths are checked."""
    out: dict[str, object] = {}
    if m := re.search(r"pivot range:\s*\(\s*(\S+)\s+([^\s)]+)\s*\)", text):
        out |= {"rmin": float(m.group(1)), "rmax": float(m.group(2))}
    if m := re.search(r"particle_cnt:\s*([\d.eE+-]+)", text):
        out["particle_cnt"] = float(m.group(1))
    for name in ("rbc", "bin"):
        if m := re.search(rf"^\s*{name}:\s*(.*?)\s*\((\d+)\)\s*$", text, re.MULTILINE | re.DOTALL):
            values = [float(x) for x in re.split(r"[,\s]+", m.group(1).strip(", \n")) if x]
            if len(values) != int(m.group(2)):
                raise ValueError(f"{name}: {len(values)} values, {m.group(2)} announced")
            out[name] = values
    return out
