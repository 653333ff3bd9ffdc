"""Finding records by name, by pointer and by key range. Lookups by name read one rank's partition a name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions.scalar import hash_rank

#: Asked for at most so many names at once they are broadcast, more are joined by a shuffle.
MAX_BROADCAST_NAMES = 1_000_000


def _small(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES else names


def dereference(index: DataFrame, log: DataFrame) -> DataFrame:
    """The payloads that an index points to by (src_rank, offset)."""
    return index.join(log.drop("epoch"), ["src_rank", "offset"])


def probe(names: DataFrame, name_filter: DataFrame, data: DataFrame, ranks: int, radix: int = 0) -> DataFrame:
    """Names looked up where a filter says that they may be: name, epoch, src_rank, payload and found.

    A filter's answer may be wrong (another name of the same hash): then ``found`` is false and the payload null.
    """
    asked = names.select("name").distinct().withColumn("name_hash", F.xxhash64("name")).withColumn("home", hash_rank(F.col("name"), ranks, radix))
    maybe = name_filter.join(_small(asked), ["home", "name_hash"]).select("name", "epoch", "src_rank")
    stored = data.select("name", "epoch", F.col("rank").alias("src_rank"), "payload", F.lit(True).alias("found"))
    return maybe.join(stored, ["name", "epoch", "src_rank"], "left").fillna(False, ["found"])


def values_of(found: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """One value a name: its payloads of all epochs one after the other: by, n_epochs, value."""
    parts = F.array_sort(F.collect_list(F.struct("epoch", "payload")))
    return found.groupBy(*by).agg(F.count_distinct("epoch").alias("n_epochs"), F.array_join(F.transform(parts, lambda p: p["payload"].cast("string")), "").alias("value"))


def binary_values_of(found: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """As ``values_of``, for binary payloads."""
    parts = F.array_sort(F.collect_list(F.struct("epoch", "payload")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["payload"]))
    return found.groupBy(*by).agg(F.count_distinct("epoch").alias("n_epochs"), joined.alias("value"))


def lookup(data: DataFrame, names: DataFrame, ranks: int, radix: int = 0) -> DataFrame:
    """Records by name: each name is looked for only at the rank of its hash."""
    asked = names.select("name").distinct().withColumn("rank", hash_rank(F.col("name"), ranks, radix))
    return data.join(_small(asked), ["rank", "name"])


def lookup_one(data: DataFrame, name: str, ranks: int, radix: int = 0) -> DataFrame:
    """The records of one name; only the partition of its rank is read."""
    spark = data.sparkSession
    rank = spark.range(1).select(hash_rank(F.lit(name), ranks, radix).alias("r")).first()["r"]
    return data.filter((F.col("rank") == rank) & (F.col("name") == name))


def lookup_everywhere(data: DataFrame, names: DataFrame, ranks: int) -> DataFrame:
    """Names looked for at every rank: name, rank, hits; ranks without the name have 0."""
    asked = names.select("name").distinct()
    every = asked.select("name", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"))
    hits = data.join(_small(asked), "name", "left_semi").groupBy("name", "rank").agg(F.count("*").alias("hits"))
    return every.join(hits, ["name", "rank"], "left").fillna(0, ["hits"])


def sample_names(names: DataFrame, depth: int, seed: int = 0, ranks: Sequence[int] | None = None, order: Column | None = None) -> DataFrame:
    """Up to ``depth`` names of each rank, by the order of a seeded hash. Spark keeps no more a rank before it shuffles."""
    rows = names if ranks is None else names.filter(F.col("rank").isin(list(ranks)))
    place = F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64("name", F.lit(seed)) if order is None else order, "name"))
    return rows.withColumn("_p", place).filter(F.col("_p") <= depth).drop("_p")


def range_ranks(edges: Sequence[float], lo: float, hi: float) -> list[int]:
    """The ranks whose bins overlap [lo, hi); the end ranks also hold what lies beyond the edges."""
    n = len(edges) - 1
    return [i for i in range(n) if (i == 0 or edges[i] < hi) and (i == n - 1 or edges[i + 1] > lo) and lo < hi]


def range_scan(data: DataFrame, key: str, lo: float, hi: float, edges: Sequence[float] | None = None, source: str | None = None) -> DataFrame:
    """Records with lo <= key < hi; with the edges of a range store only the ranks that may hold them are read.

    ``source`` names the column of doubles that the key was narrowed from: a filter on it, wider by the narrowing, reaches
    the Parquet scan, which a filter on the narrowed key does not.
    """
    kept = data if edges is None else data.filter(F.col("rank").isin(range_ranks(edges, lo, hi)))
    if source is not None:
        room = 2.0**-22
        kept = kept.filter((F.col(source) >= lo - abs(lo) * room - 1e-38) & (F.col(source) <= hi + abs(hi) * room + 1e-38))
    return kept.filter((F.col(key) >= lo) & (F.col(key) < hi))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/data")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/log").withColumnRenamed("rank", "src_rank")


def read_filter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/filter")


def read_bounds(spark: SparkSession, path: str) -> list[float]:
    """The edges of a range store."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/bounds").orderBy("rank").collect()
    return [*(r["lo"] for r in rows), rows[-1]["hi"]]
