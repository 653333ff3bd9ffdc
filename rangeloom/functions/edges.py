"""Column expressions on ranges and sorted edges.

A range is half open, [lo, hi); an unset one is null. Edges e0 <= e1 <= ... <= en make n bins; a key belongs to the bin
that starts at or below it and ends above it, so a bin without width holds nothing. -1 stands for a key left of all
bins, n for one right of them. NaN counts as left. Null keys give null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Up to so many edges the search is an expression that Spark compiles; beyond that it runs on Arrow batches.
MAX_COMPILED = 96
#: How far apart two floats may be and still count as equal.
EPSILON = 1e-3


def in_range(x: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce((x >= lo) & (x < hi) & ~F.isnan(x), F.lit(False))


def relative_position(x: Column, lo: Column, hi: Column) -> Column:
    """-1, 0 or 1: before, in or after the range. All is before an unset range, as is NaN."""
    return F.when(x.isNull(), None).when(lo.isNull() | hi.isNull() | F.isnan(x) | (x < lo), -1).when(x >= hi, 1).otherwise(0)


def float_eq(a: Column, b: Column) -> Column:
    return F.abs(a.cast("float") - b.cast("float")) < EPSILON


def float_gt(a: Column, b: Column) -> Column:
    return a.cast("float") > b.cast("float") + F.lit(EPSILON).cast("float")


def float_gte(a: Column, b: Column) -> Column:
    return float_eq(a, b) | float_gt(a, b)


def float_lt(a: Column, b: Column) -> Column:
    return a.cast("float") < b.cast("float") - F.lit(EPSILON).cast("float")


def float_lte(a: Column, b: Column) -> Column:
    return float_eq(a, b) | float_lt(a, b)


def bin_index(key: Column, edges: Sequence[float], force: bool = False) -> Column:
    """The bin of a key among fixed edges: -1 left, n right; with ``force`` the first or last bin instead."""
    points = [float(e) for e in edges]
    n = len(points) - 1
    if n < 1 or any(a > b for a, b in zip(points, points[1:], strict=False)):
        raise ValueError("edges must be two or more, in order")

    def search(low: int, high: int) -> Column:
        """How many of the edges low..high-1 are at or below the key, plus low."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(points[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    if len(points) <= MAX_COMPILED:
        at = F.when(F.isnan(key), F.lit(0)).otherwise(search(0, len(points)))
    else:
        array = np.array(points)

        @F.pandas_udf(IntegerType())
        def found(x: pd.Series) -> pd.Series:
            return pd.Series(np.where(x.isna(), 0, np.searchsorted(array, x.to_numpy(np.float64), side="right")).astype(np.int32))

        at = found(key.cast("double"))
    index = at - 1
    if force:
        index = F.greatest(F.lit(0), F.least(F.lit(n - 1), index))
    return F.when(key.isNotNull(), index).cast("int")


def bin_index_of(key: Column, edges: Column, force: bool = False, n_edges: int | None = None) -> Column:
    """As ``bin_index``, for edges in an array column. Null edges (no bins yet) leave every key on the left.

    Where all arrays are known to have ``n_edges`` edges, and those are not many, Spark compiles the search.
    """
    n = F.size(edges) - 1
    if n_edges is not None and n_edges <= MAX_COMPILED:
        below = reduce(lambda a, b: a + b, [(F.get(edges, F.lit(i)) <= key).cast("int") for i in range(n_edges)])
    else:
        below = F.size(F.filter(edges, lambda e: e <= key))
    at = F.when(F.isnan(key) | edges.isNull(), F.lit(-1)).otherwise(below - 1)
    index = F.greatest(F.lit(0), F.least(n - 1, at)) if force else at
    return F.when(key.isNotNull(), index).cast("int")


def out_of_bounds(key: Column, edges: Sequence[float] | None) -> Column:
    """Whether no bin holds a key; all are out of bounds where there are no bins."""
    if edges is None:
        return key.isNotNull()
    return (key < F.lit(float(edges[0]))) | (key >= F.lit(float(edges[-1]))) | F.isnan(key)


def as_float32(edges: Sequence[float]) -> list[float]:
    """Pivots as they are installed for bins: narrowed to 32 bits."""
    return [float(np.float32(e)) for e in edges]
