"""Histograms with buckets that widen with the value: built by group, added up, and read for percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.functions.edges import bin_index_of


def bucket_limits() -> list[float]:
    """The upper limits of the buckets: 16 a decade up to 10**9 (9 in the first), and five above."""
    steps = (1, 1.2, 1.4, 1.6, 1.8, 2, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 8, 9)
    return [*map(float, range(1, 10)), *(round(s * 10**d) * 1.0 for d in range(1, 9) for s in steps), 1e9, 2e9, 4e9, 8e9, 1e200]


LIMITS = bucket_limits()


def bucket_of(x: Column) -> Column:
    """The bucket of a value: the first whose limit lies above it; the last takes all that is larger."""
    limits = F.array(*[F.lit(v) for v in LIMITS])
    return F.least(bin_index_of(x.cast("double"), limits) + 1, F.lit(len(LIMITS) - 1))


def log_histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts by group and bucket, with the group's figures: by, bucket, n, num, max, min, sum. Null and NaN do not count."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    part = clean.groupBy(*by, bucket_of(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"), F.max(value).alias("max"), F.min(value).alias("min"), F.sum(value).alias("sum"))
    return add_histograms(part, by)


def add_histograms(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histograms of parts (by, bucket, n, max, min, sum and any others) as one a group."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    merged = parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.max("max").alias("_max"), F.min("min").alias("_min"), F.sum("sum").alias("_sum"))
    return merged.select(*by, "bucket", "n", F.sum("n").over(group).alias("num"), F.max("_max").over(group).alias("max"), F.min("_min").over(group).alias("min"), F.sum("_sum").over(group).alias("sum"))


def histogram_percentile(hist: DataFrame, percents: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of histograms, interpolated within the bucket and kept between the least and the largest value: by, p, value."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    at = hist.withColumn("_upto", upto)
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.col("num") * (p / 100.0)).alias("t")) for p in percents])
    before = F.col("_upto") - F.col("n")
    # the first bucket up to which enough is counted; one that asks for nothing is in the first
    hit = F.filter(wanted, lambda w: (w["t"] <= F.col("_upto")) & ((w["t"] > before) | ((before == 0) & (w["t"] <= 0))))
    limits = F.array(F.lit(0.0), *[F.lit(v) for v in LIMITS])
    left, right = F.element_at(limits, F.col("bucket") + 1), F.element_at(limits, F.col("bucket") + 2)
    rows = at.select(*by, F.explode(hit).alias("w"), left.alias("_l"), right.alias("_r"), before.alias("_b"), "n", "min", "max")
    inside = F.col("_l") + (F.col("_r") - F.col("_l")) * (F.col("w.t") - F.col("_b")) / F.col("n")
    return rows.select(*by, F.col("w.p").alias("p"), F.least(F.greatest(inside, F.col("min").cast("double")), F.col("max").cast("double")).alias("value"))


def histogram_average(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The mean of each group; 0 where nothing was counted: by, avg."""
    return hist.groupBy(*by).agg((F.first("sum") / F.nullif(F.first("num"), F.lit(0))).alias("a")).select(*by, F.coalesce("a", F.lit(0.0)).alias("avg"))
