"""Layouts in which records are stored, their manifests and name samples.

inline: (name, payload) at the rank of the name's hash. kvsep: payloads in a log at their source, the index of names
points into it. filter: records stay at their source, and a filter at the name's home tells where a name may be.
range: records at the rank whose key range holds them, sorted by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rangeloom.config import materialize
from rangeloom.functions.scalar import hash_rank
from rangeloom.operators.placement import place_by_hash, place_by_range

# The keys of a manifest, in the order in which they are written.
MANIFEST_KEYS = (
    "num_epochs", "key_size", "value_size", "filter_bits_per_key", "memtable_size", "lg_parts", "skip_checksums", "bypass_shuffle", "force_leveldb_format",
    "unordered_storage", "particle_id_size", "particle_size", "filename_size", "filedata_size", "io_engine", "comm_sz",
)


def running_offset(length: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """Where each record begins in its source's log: the lengths of all before it. For groups of bounded size."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint")


def with_running_sum(df: DataFrame, value: Column, name: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows of the group; no group is summed in one task.

    Rows are sorted by range over all tasks; each task sums its own rows as they stream by, and one row a task and group carries
    the sums from task to task. ``order`` has to be unique within a group for a result that is always the same.
    """
    rows = df.withColumn("_v", value.cast("bigint")).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    schema = StructType([*rows.schema.fields, StructField("_p", IntegerType()), StructField("_s", LongType())])
    keys, columns = list(by), df.columns

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.nan_to_num(batch.column("_v").fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
            new = np.flatnonzero(reduce(np.logical_or, [c[1:] != c[:-1] for c in codes], np.zeros(len(v) - 1, bool))) + 1
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            total = np.cumsum(v) - v
            # each group begins at 0, the first one where the last batch ended
            base = np.zeros(len(v), np.int64)
            starts = np.concatenate([[0], new])
            base[starts] = np.diff(np.concatenate([[0], total[starts]]))
            total = total - np.cumsum(base)
            if first == last:
                total[: new[0] if len(new) else len(v)] += carry
            last, carry = tuple(batch.column(k)[-1].as_py() for k in keys), int(total[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(v), part), pa.int32()), pa.array(total, pa.int64())], [*batch.schema.names, "_p", "_s"])

    own = materialize(rows.mapInArrow(summed, schema))
    ends = own.groupBy(*by, "_p").agg(F.sum("_v").alias("_t"))
    line = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(line), F.lit(0)).alias("_b"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)] + [F.col("_p") == F.col("_q")]
    return own.join(before, reduce(lambda a, b: a & b, same)).select(*columns, (F.col("_s") + F.col("_b")).alias(name))


def separate(df: DataFrame, ranks: int, order: Sequence[str], radix: int = 0) -> tuple[DataFrame, DataFrame]:
    """Keys and payloads apart: the log (src_rank, epoch, offset, payload) and the index (epoch, rank, name, src_rank, offset)."""
    logged = with_running_sum(df, F.octet_length("payload"), "offset", ["rank"], ["epoch", *order]).withColumnRenamed("rank", "src_rank")
    log = logged.select("src_rank", "epoch", "offset", "payload")
    index = place_by_hash(logged, "name", ranks, radix, "rank").select("epoch", "rank", "name", "src_rank", "offset")
    return log, index


def name_filter(df: DataFrame, ranks: int, radix: int = 0) -> DataFrame:
    """Where a name may be: epoch, home (the rank of the name's hash), name_hash, src_rank; each once."""
    return df.select("epoch", hash_rank(F.col("name"), ranks, radix).alias("home"), F.xxhash64("name").alias("name_hash"), F.col("rank").alias("src_rank")).distinct()


def limit_writes(df: DataFrame, most: int, by: Sequence[str], order: Sequence[str], legacy: bool = False) -> DataFrame:
    """The first ``most`` records of each group; 0 means all. ``legacy`` keeps one less and counts a rank over all epochs."""
    if most <= 0:
        return df
    groups = [c for c in by if c != "epoch"] if legacy else list(by)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*(["epoch"] if legacy else []), *order))
    return df.withColumn("_place", place).filter(F.col("_place") < most if legacy else F.col("_place") <= most).drop("_place")


def write_store(df: DataFrame, path: str, layout: str, ranks: int, order: Sequence[str] = ("seq",), radix: int = 0, edges: Sequence[float] | None = None, options: Mapping[str, str] | None = None) -> None:
    """Store records (epoch, rank, name, payload; key for 'range') below ``path``, by epoch and rank.

    ``options`` go to the Parquet writer (filters of names, block sizes). The write fails if the folder exists.
    """
    root, options = path.rstrip("/"), dict(options or {})

    def save(rows: DataFrame, name: str, sort: Sequence[str]) -> None:
        # a rank that holds much is spread over several files, each with a range of the sort key
        moved = rows.repartitionByRange("epoch", "rank", *sort).sortWithinPartitions("epoch", "rank", *sort)
        moved.write.options(**options).partitionBy("epoch", "rank").mode("errorifexists").parquet(f"{root}/{name}")

    if layout == "inline":
        save(place_by_hash(df.drop("rank"), "name", ranks, radix, "rank").select("epoch", "rank", "name", "payload"), "data", ["name"])
    elif layout == "kvsep":
        log, index = separate(df, ranks, order, radix)
        save(log.withColumnRenamed("src_rank", "rank"), "log", ["offset"])
        save(index, "data", ["name"])
    elif layout == "filter":
        save(df.select("epoch", "rank", "name", "payload"), "data", ["name"])
        name_filter(df, ranks, radix).repartition("home").write.partitionBy("home").mode("errorifexists").parquet(f"{root}/filter")
    elif layout == "range":
        if edges is None:
            raise ValueError("the range layout needs edges")
        placed = place_by_range(df.drop("rank"), "key", edges, purge=True, dest="rank")
        save(placed.select("epoch", "rank", "key", "name", "payload"), "data", ["key"])
        spark = df.sparkSession
        bounds = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        spark.createDataFrame(bounds, "rank int, lo double, hi double").coalesce(1).write.mode("errorifexists").parquet(f"{root}/bounds")
    else:
        raise ValueError(f"no such layout: {layout}")


def discard(df: DataFrame) -> None:
    """Run a plan and store nothing."""
    df.write.format("noop").mode("overwrite").save()


def manifest(spark: SparkSession, path: str, fields: Mapping[str, object], fmt: str | None = None) -> None:
    """Write a manifest: one line ``key=value`` for each field, and ``fmt=`` where a format is given."""
    unknown = set(fields) - set(MANIFEST_KEYS)
    if unknown:
        raise ValueError(f"no such manifest fields: {sorted(unknown)}")
    lines = [f"{k}={int(v) if isinstance(v, bool) else v}" for k in MANIFEST_KEYS if (v := fields.get(k)) is not None] + ([f"fmt={fmt}"] if fmt else [])
    spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("errorifexists").text(path)


def parse_manifest(lines: Sequence[str]) -> dict[str, str]:
    """The fields of a manifest. Unknown keys are ignored; a key size or rank count that is missing or 0 is an error."""
    found = {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in lines if "=" in line)}
    known = {k: v for k, v in found.items() if k in MANIFEST_KEYS or k == "fmt"}
    for key in ("key_size", "comm_sz"):
        if not known.get(key, "").isdigit() or int(known[key]) == 0:
            raise ValueError(f"bad manifest: {key}")
    return known


def read_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """The fields of a manifest; lines of other keys are left out before any come to the driver."""
    known = F.trim(F.substring_index("value", "=", 1)).isin(*MANIFEST_KEYS, "fmt")
    return parse_manifest([r["value"] for r in spark.read.text(path).filter(known).distinct().collect()])


def manifest_json(fields: Mapping[str, object]) -> str:
    return json.dumps({k: fields[k] for k in MANIFEST_KEYS if k in fields})


def write_names(samples: DataFrame, path: str) -> None:
    """Sampled names (rank, name) as text, one folder a rank."""
    samples.select("rank", F.col("name").alias("value")).repartition("rank").write.partitionBy("rank").mode("errorifexists").text(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """rank, name: from folders by rank, or from files NAMES-<rank>.txt."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("name"), F.input_file_name().alias("_f"))
    rank = F.coalesce(F.nullif(F.regexp_extract("_f", r"NAMES-(\d+)\.txt", 1), F.lit("")), F.regexp_extract("_f", r"rank=(\d+)/", 1))
    return lines.filter("name <> ''").select(rank.cast("int").alias("rank"), "name")


def extract_files(found: DataFrame, out: str) -> None:
    """Looked-up values (name, value) as one file each below a folder that all executors share. Names must be plain."""
    import os

    def save(frames):
        import pandas as pd

        for frame in frames:
            done = []
            for name, value in zip(frame["name"], frame["value"], strict=True):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"not a file name: {name}")
                with open(os.path.join(out, name), "wb") as f:
                    f.write(value)
                done.append(name)
            yield pd.DataFrame({"name": done})

    os.makedirs(out, exist_ok=True)
    found.select("name", "value").mapInPandas(save, "name string").write.format("noop").mode("overwrite").save()
