"""How evenly ranges spread records over ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.config import materialize
from rangeloom.functions.edges import bin_index_of
from rangeloom.operators.pivots import MAX_BROADCAST_GROUPS, full_pivots, tree_pivots


def _small(edges: DataFrame) -> DataFrame:
    return F.broadcast(edges) if edges.count() <= MAX_BROADCAST_GROUPS else edges


def load_stddev(counts: DataFrame, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """The population standard deviation of the counts over their mean, by group: by, load_std. Empty ranks must be rows.

    Where there are no records at all it is null.
    """
    return counts.groupBy(*by).agg((F.stddev_pop(n) / F.nullif(F.avg(n), F.lit(0.0))).alias("load_std"))


def count_into_bins(df: DataFrame, key: str, edges: DataFrame, ranks: int, by: Sequence[str]) -> DataFrame:
    """Records in each bin of their group's edges (by, edges), those out of bounds in the end bins: by, dest, n.

    Empty bins are rows, too. Null keys are in no bin; NaN is in the first. Edges, ``ranks`` + 1 of them, are one row a group;
    up to MAX_BROADCAST_GROUPS rows are broadcast.
    """
    edges = materialize(edges)
    placed = df.select(*by, F.col(key).alias("_key")).join(_small(edges.select(*by, F.col("edges").cast("array<float>").alias("_edges"))), list(by))
    counts = placed.groupBy(*by, bin_index_of(F.col("_key"), F.col("_edges"), force=True, n_edges=ranks + 1).alias("dest")).agg(F.count("*").alias("n"))
    every = edges.select(*by, F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("dest"))
    return every.join(counts, [*by, "dest"], "left").fillna(0, ["n"])


def rank_pivots(df: DataFrame, key: str, ranks: int, n: int, sample: int, order: Sequence[str]) -> DataFrame:
    """The merged pivots of each epoch of records (epoch, rank, key): epoch, edges."""
    per_rank = full_pivots(df, key, n, sample, ["epoch", "rank"], order)
    return tree_pivots(per_rank, ranks, (n, n), ["epoch"]).select("epoch", F.col("pivots").alias("edges"))


def load_suites(df: DataFrame, key: str, ranks: int, n: int, sample: int, order: Sequence[str]) -> DataFrame:
    """The load balance of each epoch under three choices of pivots: runtype, nranks, pvtcnt, epidx, load_std.

    'ep0pp' takes the pivots of the first epoch for all, 'epxsub1pp' those of the epoch before (from the second on),
    'epxpp' each epoch's own.
    """
    own = materialize(rank_pivots(df, key, ranks, n, sample, order))
    # a window over one row an epoch
    line = Window.partitionBy(F.lit(0)).orderBy("epoch")
    numbered = own.withColumn("epidx", F.row_number().over(line) - 1).withColumns({"before": F.lag("edges").over(line), "first": F.first("edges").over(line)})
    choices = F.array(F.struct(F.lit("ep0pp").alias("runtype"), F.col("first").alias("edges")), F.struct(F.lit("epxsub1pp").alias("runtype"), F.col("before").alias("edges")), F.struct(F.lit("epxpp").alias("runtype"), F.col("edges").alias("edges")))
    chosen = materialize(numbered.select("epoch", "epidx", F.explode(choices).alias("c")).select("epoch", "epidx", "c.runtype", "c.edges").filter("edges IS NOT NULL"))
    # all three are counted in one pass over the records
    placed = df.select("epoch", F.col(key).alias("_key")).join(_small(chosen.select("epoch", "runtype", F.col("edges").cast("array<float>").alias("_edges"))), "epoch")
    counts = placed.groupBy("epoch", "runtype", bin_index_of(F.col("_key"), F.col("_edges"), force=True, n_edges=ranks + 1).alias("dest")).agg(F.count("*").alias("n"))
    every = chosen.select("epoch", "epidx", "runtype", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("dest"))
    filled = every.join(counts, ["epoch", "runtype", "dest"], "left").fillna(0, ["n"])
    result = load_stddev(filled, ["runtype", "epidx"])
    return result.select("runtype", F.lit(ranks).alias("nranks"), F.lit(n).alias("pvtcnt"), "epidx", "load_std")


def append_suites(suites: DataFrame, path: str) -> None:
    """Suites' rows added to a folder of CSV files with a header: runtype, nranks, pvtcnt, epidx, load_std."""
    suites.select("runtype", "nranks", "pvtcnt", "epidx", "load_std").coalesce(1).write.mode("append").option("header", "true").csv(path)


def read_suites(spark, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema("runtype string, nranks int, pvtcnt int, epidx int, load_std double").csv(path)
