"""Values by rank, exactly, without a group's values in one place: selection by radix.

Floats become integers in the same order. A histogram of the leading 16 bits is counted per group; each wanted rank lies in
one digit, and only the values with that digit are counted by the next 16 bits, and so on. A group's histogram has at most
65,536 rows, whatever the group holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rangeloom.config import materialize

DIGIT = 16
#: Up to so many followed digits are broadcast to the next pass; beyond that the pass joins them by a shuffle.
MAX_BROADCAST = 200_000


def ordered(x: np.ndarray) -> np.ndarray:
    """Floats as signed integers of the same width in the same order; both zeros become one."""
    kind = np.int32 if x.dtype == np.float32 else np.int64
    bits = (x + x.dtype.type(0)).view(kind)
    return bits ^ ((bits >> (bits.itemsize * 8 - 1)) & np.iinfo(kind).max)


def value(code: np.ndarray, width: int) -> np.ndarray:
    kind, real = (np.int32, np.float32) if width == 32 else (np.int64, np.float64)
    code = code.astype(kind)
    return (code ^ ((code >> (width - 1)) & np.iinfo(kind).max)).view(real).astype(np.float64)


@F.pandas_udf(LongType())
def _encode32(x: pd.Series) -> pd.Series:
    return pd.Series(ordered(x.to_numpy(np.float32)).astype(np.int64))


@F.pandas_udf(LongType())
def _encode64(x: pd.Series) -> pd.Series:
    return pd.Series(ordered(x.to_numpy(np.float64)))


def encode(x: Column, width: int) -> Column:
    """The order-preserving code of a float (32) or double (64) column that holds neither null nor NaN."""
    return _encode32(x.cast("float")) if width == 32 else _encode64(x.cast("double"))


def decode(code: Column, width: int) -> Column:
    @F.pandas_udf("double")
    def decoded(c: pd.Series) -> pd.Series:
        return pd.Series(value(c.to_numpy(np.int64), width))

    return decoded(code)


def histogram(codes: DataFrame, by: Sequence[str], width: int, bits: int = DIGIT) -> DataFrame:
    """The histogram of the leading ``bits`` bits of ``code`` by group: by, digit, n. Histograms of parts add up."""
    return codes.groupBy(*by, F.shiftright("code", width - bits).alias("digit")).agg(F.count("*").alias("n"))


def follow(hist: DataFrame, by: Sequence[str], targets: Column) -> DataFrame:
    """The digit of each target: by, p, rest (the rank within the digit), digit, n_all, n (in the digit).

    ``targets`` is an array of (p, rank from 1), which may be told from ``_all``, the number of the group's values.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(group.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
    at = hist.withColumns({"_upto": upto, "_all": F.sum("n").over(group)})
    hit = F.filter(targets, lambda t: (t["rank"] > F.col("_upto") - F.col("n")) & (t["rank"] <= F.col("_upto")))
    rows = at.select(*by, "digit", "n", "_upto", "_all", F.explode(hit).alias("t"))
    return rows.select(*by, F.col("t.p").alias("p"), (F.col("t.rank") - F.col("_upto") + F.col("n")).alias("rest"), "digit", F.col("_all").alias("n_all"), "n")


def select(codes: DataFrame, by: Sequence[str], width: int, targets: Column, digits: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """The digits of the values at the target ranks of each group: by, p, digit, n_all. After all digits they are the codes.

    ``codes`` has the ``by`` columns and ``code``; it is read once a digit. ``first`` may give the histogram of the first
    digit. A null group is a group like others; an empty table gives an empty result.
    """
    digits = width // DIGIT if digits is None else digits
    found = follow(histogram(codes, by, width) if first is None else first, by, targets)
    for d in range(1, digits):
        found = materialize(found.select(*by, "p", "rest", "digit", "n_all"))
        shift = width - DIGIT * (d + 1)
        wanted = found.select(*by, F.col("digit").alias("_prefix")).distinct()
        if found.count() <= MAX_BROADCAST:
            wanted = F.broadcast(wanted)
        values = codes.withColumn("_prefix", F.shiftright("code", shift + DIGIT))
        same = [values[c].eqNullSafe(wanted[c]) for c in by] + [values["_prefix"] == wanted["_prefix"]]
        kept = values.join(wanted, reduce(lambda a, b: a & b, same), "left_semi")
        next_digit = kept.groupBy(*by, "_prefix", F.shiftright("code", shift).alias("digit")).agg(F.count("*").alias("n"))
        ranks = found.groupBy(*by, F.col("digit").alias("_prefix")).agg(F.collect_list(F.struct("p", F.col("rest").alias("rank"))).alias("_targets"), F.max("n_all").alias("_n_all"))
        pair = [next_digit[c].eqNullSafe(ranks[c]) for c in by] + [next_digit["_prefix"] == ranks["_prefix"]]
        joined = next_digit.join(ranks, reduce(lambda a, b: a & b, pair)).select(*[next_digit[c] for c in by], next_digit["_prefix"], "digit", "n", "_targets", "_n_all")
        upto = F.sum("n").over(Window.partitionBy(*by, "_prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        hit = F.filter("_targets", lambda t: (t["rank"] > F.col("_upto") - F.col("n")) & (t["rank"] <= F.col("_upto")))
        rows = joined.withColumn("_upto", upto).select(*by, "digit", "n", "_upto", "_n_all", F.explode(hit).alias("t"))
        found = rows.select(*by, F.col("t.p").alias("p"), (F.col("t.rank") - F.col("_upto") + F.col("n")).alias("rest"), "digit", F.col("_n_all").alias("n_all"), "n")
    return found.select(*by, "p", "digit", "n_all")
