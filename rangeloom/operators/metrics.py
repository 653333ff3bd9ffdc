"""Figures by rank and epoch: reduced, compared with the epoch before, checked, and turned into rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collisions(df: DataFrame, by: Sequence[str] = ("epoch", "rank"), name: str = "name") -> DataFrame:
    """How many records of a group have a name that came before: by, n, collisions."""
    # two steps, so that no group's names come to one task
    names = df.groupBy(*by, name).agg(F.count("*").alias("_n"))
    return names.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum("_n") - F.count(F.col(name))).alias("collisions"))


def reduce_metrics(df: DataFrame, by: Sequence[str], sums: Sequence[str] = (), mins: Sequence[str] = (), maxs: Sequence[str] = ()) -> DataFrame:
    """Figures of all ranks as one row a group: total_<c>, min_<c>, max_<c>."""
    how = [F.sum(c).alias(f"total_{c}") for c in sums] + [F.min(c).alias(f"min_{c}") for c in mins] + [F.max(c).alias(f"max_{c}") for c in maxs]
    return df.groupBy(*by).agg(*how)


def epoch_deltas(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("rank",), epoch: str = "epoch") -> DataFrame:
    """Cumulative figures as differences from the epoch before; the first epoch's are as they are."""
    line = Window.partitionBy(*by).orderBy(epoch)
    return df.withColumns({f"d_{c}": F.col(c) - F.coalesce(F.lag(c).over(line), F.lit(0)) for c in columns})


def violations(df: DataFrame) -> DataFrame:
    """Epochs whose figures contradict each other: local and foreign writes are all writes, what is sent is delivered and received.

    Columns: epoch, local, foreign, writes, sent, delivered, received; a null makes a contradiction.
    """
    fine = (F.col("local") + F.col("foreign") == F.col("writes")) & (F.col("sent") == F.col("delivered")) & (F.col("delivered") == F.col("received"))
    return df.filter(~F.coalesce(fine, F.lit(False)))


def percent_of(part: Column, whole: Column) -> Column:
    """The share in percent; null where there is no whole."""
    return part / F.nullif(whole, F.lit(0)) * 100


def rates(df: DataFrame, seconds: str, counts: Mapping[str, str], ranks: int) -> DataFrame:
    """Added columns for each count: <name>_per_s, s_per_<name> and <name>_per_rank_s."""
    out, s = {}, F.col(seconds)
    for name, column in counts.items():
        c = F.col(column)
        out |= {f"{name}_per_s": c / F.nullif(s, F.lit(0.0)), f"s_per_{name}": s / F.nullif(c, F.lit(0)), f"{name}_per_rank_s": c / F.nullif(s, F.lit(0.0)) / F.lit(ranks)}
    return df.withColumns(out)


def storage_overhead(df: DataFrame, index: str, filters: str, data: str, logical: str) -> DataFrame:
    """Added columns: what index, filters and stored data take, in percent of the logical bytes."""
    whole = F.col(logical)
    return df.withColumns({"index_pct": percent_of(F.col(index), whole), "filter_pct": percent_of(F.col(filters), whole), "data_pct": percent_of(F.col(data), whole)})


def cpu_use(df: DataFrame, user: str, system: str, wall: str, by: Sequence[str]) -> DataFrame:
    """CPU use in percent over the ranks of a group: the least rounded down and the largest rounded up: by, min_cpu, max_cpu."""
    use = (F.col(user) + F.col(system)) / F.nullif(F.col(wall), F.lit(0.0)) * 100
    return df.groupBy(*by).agg(F.floor(F.min(use)).alias("min_cpu"), F.ceil(F.max(use)).alias("max_cpu"))


def first_to_arrive(df: DataFrame, at: str, rank: str, by: Sequence[str]) -> DataFrame:
    """The rank that reached a barrier first (of several the smallest), when, and how long the last took: by, first_rank, first_at, wait."""
    first = F.min(F.struct(F.col(at).alias("t"), F.col(rank).alias("r")))
    return df.groupBy(*by).agg(first.alias("f"), F.max(at).alias("_last")).select(*by, F.col("f.r").alias("first_rank"), F.col("f.t").alias("first_at"), (F.col("_last") - F.col("f.t")).alias("wait"))


def latency_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """by, n, avg, median (the lower one of an even number), min, max, total. Null values do not count.

    The median is exact: its neighbourhood is found by an approximate percentile, and only the values within are counted
    one by one, so no group's values have to be in one place.
    """
    clean = df.select(*by, F.col(value).alias("_v")).filter("_v IS NOT NULL")
    rough = clean.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("_v").alias("avg"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.sum("_v").alias("total"), F.percentile_approx("_v", [0.49, 0.51], 1000).alias("_p")
    )
    ends = rough.select(*by, "n", F.col("_p")[0].alias("_low"), F.col("_p")[1].alias("_high"))
    near = clean.join(F.broadcast(ends), list(by))
    # what lies below is counted together, as null
    kept = near.filter(F.col("_v") <= F.col("_high")).select(*by, "n", F.when(F.col("_v") < F.col("_low"), None).otherwise(F.col("_v")).alias("_v"))
    counts = kept.groupBy(*by, "n", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    median = counts.withColumn("_upto", upto).filter(F.col("_upto") > F.floor((F.col("n") - 1) / 2)).groupBy(*by).agg(F.min("_v").alias("median"))
    return rough.join(F.broadcast(median), list(by)).select(*by, "n", "avg", "median", "min", "max", "total")


def round_summary(df: DataFrame, micros: str, by: Sequence[str] = ()) -> DataFrame:
    """Durations of rounds: by, rounds, mean (whole microseconds), std, min, max."""
    return df.groupBy(*by).agg(
        F.count(micros).alias("rounds"), F.expr(f"sum(`{micros}`) div nullif(count(`{micros}`), 0)").alias("mean"), F.stddev_pop(micros).alias("std"), F.min(micros).alias("min"), F.max(micros).alias("max")
    )


def read_amplification(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of lookups (table_seeks, data_seeks, ok, ops): sums, least and most a query, how many succeeded, and operations beyond one a query."""
    return df.groupBy(*by).agg(
        F.count("*").alias("queries"),
        *[f(c).alias(f"{n}_{c}") for c in ("table_seeks", "data_seeks") for n, f in (("total", F.sum), ("min", F.min), ("max", F.max))],
        F.count_if("ok").alias("ok_ops"),
        F.sum(F.greatest(F.col("ops") - 1, F.lit(0))).alias("extra_ops"),
    )


def drop_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of (dropped, bytes_read, bytes_written, files_read, files_written, drain_time): sums, and the longest drain."""
    sums = [F.sum(c).alias(c) for c in ("dropped", "bytes_read", "bytes_written", "files_read", "files_written")]
    return df.groupBy(*by).agg(*sums, F.max("drain_time").alias("max_drain_time"))


def perf_rows(df: DataFrame, at: str, stat: str, value: str) -> DataFrame:
    """Figures as rows of a performance log: ts_ms, stat_type, stat_value."""
    return df.select(F.col(at).cast("bigint").alias("ts_ms"), F.col(stat).cast("string").alias("stat_type"), F.col(value).cast("string").alias("stat_value"))


def perf_log(df: DataFrame, at: str, stat: str, value: str, interval_ms: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """A performance log by intervals: by, ts_ms (the interval's begin), stat_type, stat_value (the last one in the interval).

    Of several values at the same time the largest counts. Rows without a time or a stat are left out.
    """
    kept = df.filter(F.col(at).isNotNull() & F.col(stat).isNotNull())
    begin = (F.floor(F.col(at) / interval_ms) * interval_ms).cast("bigint").alias("ts_ms")
    last = F.max(F.struct(F.col(at), F.col(value).cast("string").alias("v"))).alias("l")
    return kept.groupBy(*by, begin, F.col(stat).cast("string").alias("stat_type")).agg(last).select(*by, "ts_ms", "stat_type", F.col("l.v").alias("stat_value"))


def write_monitor(df: DataFrame, path: str, epoch: str = "epoch") -> None:
    """Figures by rank and epoch as a table, a folder an epoch, and beside it as text: one line ``name=value`` a figure, by rank.

    Writing an epoch again replaces it and leaves the others.
    """
    root = path.rstrip("/")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(epoch).parquet(f"{root}/bin")
    names = [c for c in df.columns if c != epoch]
    line = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names])
    df.select(epoch, line.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(epoch).text(f"{root}/txt")
