"""Names followed through all epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER = 1_000_000


def chosen(name: Column, threshold: int) -> Column:
    """Whether a name is in the sample: by its hash, ``threshold`` in a million, the same names in every run."""
    return F.pmod(F.xxhash64(name), F.lit(PER)) < threshold


def stable_names(df: DataFrame, n_epochs: int, sample: Column | None = None, first_epoch: int = 1) -> DataFrame:
    """Sampled names of the first epoch with their counts: name, n (1, and 1 for each later write), valid.

    A name is valid if its count is the number of epochs: once in each, that is, unless writes make up for gaps.
    Names that do not occur in the first epoch are no samples, however often they come later.
    """
    taken = df if sample is None else df.filter(sample)
    by = taken.groupBy("name").agg(F.max((F.col("epoch") == first_epoch).cast("int")).alias("_in"), F.count_if(F.col("epoch") > first_epoch).alias("_later"))
    return by.filter("_in = 1").select("name", (F.col("_later") + 1).alias("n"), (F.col("_later") + 1 == n_epochs).alias("valid"))


def valid_names(df: DataFrame, n_epochs: int, threshold: int = 100, first_epoch: int = 1) -> DataFrame:
    return stable_names(df, n_epochs, chosen(F.col("name"), threshold), first_epoch).filter("valid").select("name")
