"""Percentiles of very large numeric columns by radix selection, per group, exact or within a known bound.

Floats become integers in the same order. A histogram of the leading 16 bits is counted per group; it is a sum, so the
histograms of separate partitions, epochs or days add up to that of their union. Each target rank lies in one digit;
only the values with that digit are counted by the next 16 bits, and so on. After all digits the value is exact; after
fewer it is known up to the width of its digit: two leading digits of a double leave a relative error below 2**-20.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.config import materialize
from rangeloom.operators import radix

DIGIT = 16
PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
# The ends of a range that was never set.
UNSET = (1.7976931348623157e308, 2.2250738585072014e-308)


def _rank(p: Column, n: Column) -> Column:
    """The place of a percentile among n sorted values, from 1: the smallest with at least the share p at or below it."""
    return F.greatest(F.ceil(p * n), F.lit(1)).cast("bigint")


def sketch(codes: DataFrame, by: Sequence[str], width: int, bits: int = DIGIT) -> DataFrame:
    """The histogram of the leading ``bits`` bits of ``code`` by group: by, digit, n. Sketches of parts add up."""
    return radix.histogram(codes, by, width, bits)


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches added up over the groups that are not in ``by``."""
    return sketches.groupBy(*by, "digit").agg(F.sum("n").alias("n"))


def _first_targets(probs: Sequence[float]) -> Column:
    return F.array(*[F.struct(F.lit(float(p)).alias("p"), _rank(F.lit(float(p)), F.col("_all")).alias("rank")) for p in probs])


def _bounds(found: DataFrame, by: Sequence[str], width: int, known_bits: int) -> DataFrame:
    left = width - known_bits
    low = F.shiftleft(F.col("digit").cast("bigint"), left)
    high = low + F.lit((1 << left) - 1)
    return found.select(*by, "p", radix.decode(low, width).alias("low"), radix.decode(high, width).alias("high"), F.col("n_all").alias("n"))


def sketch_percentiles(sketches: DataFrame, by: Sequence[str], width: int, probs: Sequence[float] = PROBS, bits: int = DIGIT) -> DataFrame:
    """Percentiles from sketches alone: by, p, low, high, n. The value of the rank lies within low and high.

    A group without values gives no row.
    """
    return _bounds(radix.follow(sketches, by, _first_targets(probs)), by, width, bits)


def radix_percentiles(codes: DataFrame, by: Sequence[str], width: int, probs: Sequence[float] = PROBS, digits: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """Percentiles of coded values by group: by, p, low, high, n. With all digits low equals high, the exact value.

    ``codes`` has the ``by`` columns and ``code``; it is read once a digit, so it should be a table. ``first`` may give
    the histogram of the first digit, as merged from sketches. The value at p is the smallest with at least the share p
    of the group's values at or below it. A null group is a group like others; an empty table gives an empty result.
    """
    digits = width // DIGIT if digits is None else digits
    return _bounds(radix.select(codes, by, width, _first_targets(probs), digits, first), by, width, DIGIT * digits)


def property_codes(particle_mem: DataFrame) -> DataFrame:
    """The coded properties of particle records, each record once: epoch, src_rank, code.

    Null and NaN are no values; infinities are, at the ends. Of copies that differ the smallest property counts.
    """
    once = particle_mem.groupBy("epoch", "src_rank", "seq").agg(F.min("indexed_prop").alias("x"))
    return once.filter("x IS NOT NULL AND NOT isnan(x)").select("epoch", "src_rank", radix.encode(F.col("x"), 32).alias("code"))


def bound_codes(bounds: DataFrame) -> DataFrame:
    """The coded values of bounds, each stored row once: epoch, stage, code. Unset ends, null and NaN are no values."""
    rows = bounds.select("epoch", "round_no", "stage", "node", "pbidx", "b_value", "b_far_end", "is_start", "received_ts").distinct()
    kept = rows.filter(F.col("b_value").isNotNull() & ~F.isnan("b_value") & ~F.col("b_value").isin(*UNSET))
    return kept.select("epoch", "stage", radix.encode(F.col("b_value"), 64).alias("code"))


def _named(found: DataFrame, field: str, by: str | None) -> DataFrame:
    group = F.col(by).cast("bigint") if by else F.lit(None).cast("bigint")
    return found.select(F.lit(field).alias("field"), F.lit(by or "run").alias("grouping"), group.alias("group_id"), "p", "low", "high", "n")


def all_percentiles(particle_mem: DataFrame, bounds: DataFrame, probs: Sequence[float] = PROBS) -> DataFrame:
    """Exact percentiles of indexed_prop by epoch, by src_rank and of the run, of b_value by epoch, by stage and of the run.

    All groupings of a field are followed together, digit by digit. The first digits of the run come from the merged
    histograms of its epochs.
    """
    parts = []
    for field, codes, width, groupings in (
        ("indexed_prop", property_codes(particle_mem), 32, ("epoch", "src_rank")),
        ("b_value", bound_codes(bounds), 64, ("epoch", "stage")),
    ):
        table = materialize(codes)
        groups = [F.struct(F.lit(g).alias("grouping"), (F.col(g) if g != "run" else F.lit(None)).cast("bigint").alias("group_id")) for g in (*groupings, "run")]
        own = table.select("code", F.explode(F.array(*groups[:-1])).alias("g")).select("g.grouping", "g.group_id", "code")
        first = materialize(sketch(own, ["grouping", "group_id"], width))
        run = merge(first.filter(F.col("grouping") == groupings[0])).select(F.lit("run").alias("grouping"), F.lit(None).cast("bigint").alias("group_id"), "digit", "n")
        every = table.select("code", F.explode(F.array(*groups)).alias("g")).select("g.grouping", "g.group_id", "code")
        found = radix_percentiles(every, ["grouping", "group_id"], width, probs, first=first.unionByName(run))
        parts.append(found.select(F.lit(field).alias("field"), "grouping", "group_id", "p", "low", "high", "n"))
    return reduce(DataFrame.unionByName, parts)


def merged_percentiles(particle_mem: DataFrame, bounds: DataFrame, probs: Sequence[float] = PROBS) -> DataFrame:
    """The run's percentiles from the merged sketches of its epochs alone, with the bounds between which they lie.

    A merged sketch has at most 2**bits rows, however many values there are.
    """
    parts = []
    for field, codes, width, bits in (("indexed_prop", property_codes(particle_mem), 32, 20), ("b_value", bound_codes(bounds), 64, 22)):
        parts.append(_named(sketch_percentiles(merge(sketch(codes, ["epoch"], width, bits)), [], width, probs, bits), field, None))
    return reduce(DataFrame.unionByName, parts)


def percentiles_sql(probs: Sequence[float] = PROBS) -> str:
    listed = ", ".join(f"CAST({p} AS DOUBLE)" for p in probs)
    unset = ", ".join(repr(u) for u in UNSET)
    groups = [("indexed_prop", "epoch", "epoch"), ("indexed_prop", "src_rank", "src_rank"), ("indexed_prop", "run", "NULL"), ("b_value", "epoch", "epoch"), ("b_value", "stage", "stage"), ("b_value", "run", "NULL")]
    named = " UNION ALL ".join(f"SELECT '{f}' AS field, '{g}' AS \"grouping\", CAST({e} AS BIGINT) AS group_id, x FROM {'props' if f == 'indexed_prop' else 'bvals'}" for f, g, e in groups)
    return f"""
WITH props AS (
    SELECT epoch, src_rank, CAST(x AS DOUBLE) + 0.0 AS x
    FROM (SELECT epoch, src_rank, seq, min(indexed_prop) AS x FROM particle_mem GROUP BY epoch, src_rank, seq) WHERE x IS NOT NULL AND NOT isnan(x)
), bvals AS (
    SELECT epoch, stage, b_value + 0.0 AS x FROM (SELECT DISTINCT * FROM bounds) WHERE b_value IS NOT NULL AND NOT isnan(b_value) AND b_value NOT IN ({unset})
), named AS ({named}),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY field, "grouping", group_id ORDER BY x) AS r, count(*) OVER (PARTITION BY field, "grouping", group_id) AS n FROM named
), probs AS (SELECT unnest([{listed}]) AS p)
SELECT field, "grouping", group_id, p, x AS low, x AS high, n FROM ranked JOIN probs ON r = greatest(1, CAST(ceil(p * n) AS BIGINT))
"""


def relative_width(bits: int, width: int) -> float:
    """How far apart, at most, the ends of a digit of ``bits`` leading bits lie, as a share of a normal value."""
    mantissa = bits - 1 - (8 if width == 32 else 11)
    return math.ldexp(1.0, -mantissa)
