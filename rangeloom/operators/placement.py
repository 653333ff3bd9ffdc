"""Where records go: by hash, by ring, or by range; and what happens to those that no range holds."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from rangeloom.functions.edges import bin_index, out_of_bounds
from rangeloom.functions.scalar import hash_rank


def claimed_path(path: Column, mount: str, ignore: Sequence[str] = ()) -> Column:
    """How a path is routed: 'ignored' below an ignored folder, 'inside' below the mount, else 'outside'.

    A folder's own path and names that only begin like it are not below it. Null is outside.
    """
    below = lambda root: path.startswith(root.rstrip("/") + "/")
    case = F.when(path.isNull(), "outside")
    for root in ignore:
        case = case.when(below(root), "ignored")
    return case.when(below(mount), "inside").otherwise("outside")


def place_by_hash(df: DataFrame, key: str, ranks: int, radix: int = 0, dest: str = "dest") -> DataFrame:
    """The receiving rank of each record by the hash of its key; with a radix only every 2**radix-th rank receives."""
    return df.withColumn(dest, F.lit(0) if ranks == 1 else hash_rank(F.col(key), ranks, radix))


def place_by_ring(df: DataFrame, key: str, ranks: int, replicas: int = 1024, dest: str = "dest") -> DataFrame:
    """The receiving rank by consistent hashing: the owner of the next point on a ring with ``replicas`` points a rank.

    Adding a rank moves only the keys that it takes over. Null keys are keys like others.
    """
    points = sorted((int.from_bytes(hashlib.blake2b(f"{r}/{v}".encode(), digest_size=8).digest(), "little", signed=True), r) for r in range(ranks) for v in range(replicas))
    at, owner = np.array([p for p, _ in points]), np.array([r for _, r in points], np.int32)

    @F.pandas_udf(IntegerType())
    def next_owner(h: pd.Series) -> pd.Series:
        return pd.Series(owner[np.searchsorted(at, h.to_numpy(np.int64)) % len(at)])

    return df.withColumn(dest, next_owner(F.xxhash64(F.col(key))))


def place_by_range(df: DataFrame, key: str, edges: Sequence[float] | None, purge: bool = False, dest: str = "dest") -> DataFrame:
    """The rank whose bin holds the key. A record out of bounds has the destination null, or, when purging, the rank at its end.

    Without bins all records are out of bounds, and purging is not possible. Null keys stay without a destination.
    """
    if edges is None:
        if purge:
            raise ValueError("nothing to purge to: there are no bins")
        return df.withColumn(dest, F.lit(None).cast("int"))
    at = bin_index(F.col(key), edges, force=purge)
    return df.withColumn(dest, at if purge else F.when(~out_of_bounds(F.col(key), edges), at))


def split_out_of_bounds(df: DataFrame, key: str, edges: Sequence[float] | None) -> tuple[DataFrame, DataFrame]:
    """Records that a bin holds, and those that must wait. Null keys wait."""
    out = out_of_bounds(F.col(key), edges)
    return df.filter(~out), df.filter(out | F.col(key).isNull())


def is_local(dest: Column, rank: Column, force_remote: bool = False) -> Column:
    """Whether a record stays at its source, so that it needs no message; never where all have to be sent. Null without a destination."""
    return (dest == rank) & F.lit(not force_remote)


def to_destinations(df: DataFrame, ranks: int, dest: str = "dest") -> DataFrame:
    """Records moved so that partition i holds destination i, exactly. Records without a destination are an error."""
    sure = F.when(F.col(dest).isNull(), F.raise_error(F.lit("a record has no destination"))).otherwise(F.col(dest))
    return df.repartitionById(ranks, sure.cast("int"))


def to_receivers(df: DataFrame, ranks: int, radix: int, dest: str = "dest") -> DataFrame:
    """Records moved to as many partitions as there are receivers."""
    return df.repartitionById(-(-ranks >> radix), F.shiftright(F.col(dest), radix))


def destination_counts(df: DataFrame, ranks: int, by: Sequence[str] = (), dest: str = "dest") -> DataFrame:
    """Records of each destination, destinations without any included: by, dest, n."""
    counted = df.groupBy(*by, dest).agg(F.count("*").alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
    every = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias(dest))
    return every.join(counted, [*by, dest], "left").fillna(0, ["n"])


def invalid_records(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Records that break a rule, with the names of those broken in ``broken``; a rule whose outcome is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)
