"""The queries of the data-processing problems that belong to the core, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.config import materialize, shared_path
from rangeloom.operators import archives, log_entries, packed_fields, skewed_keys
from rangeloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_fields.packed_perflog(table(spark, sf_dir, "perflog"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skewed_keys.heavy_particles(table(spark, sf_dir, "particle_mem"))


def p3_dest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = table(spark, sf_dir, "particle_mem").select("epoch", "src_rank", "seq", "arrived_ts", "shuffle_dest", "buf_sz")
    # read several times
    records = materialize(skewed_keys.once(needed).select("epoch", "shuffle_dest", "buf_sz"))
    totals = skewed_keys.key_totals(records, "epoch", "shuffle_dest", "buf_sz")
    return totals.select(F.col("grp").cast("int").alias("epoch"), F.col("key").cast("int").alias("shuffle_dest"), F.col("n").alias("n_records"), F.col("total").alias("bytes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.found_files(table(spark, sf_dir, "ps"))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.distinct_files(table(spark, sf_dir, "ps")).select("ps_id", "epoch", "path", "length", "size_known")


def p4_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = archives.plan_containers(materialize(archives.distinct_files(table(spark, sf_dir, "ps"))))
    return plan.groupBy("container").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.max(F.col("offset") + F.col("length")).alias("end"))


def p4_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of every hundredth listing, looked up in the archive of all."""
    ps, out = table(spark, sf_dir, "ps"), shared_path(spark, "archive")
    archives.archive_listing(ps, out)
    asked = archives.distinct_files(ps).filter("ps_id % 100 = 0").select("epoch", "path")
    return archives.listed_members(archives.read_members(spark, out, asked)).select("ps_id", "epoch", "path", "length")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries.found_entries(table(spark, sf_dir, "perflog_raw"))


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries.entries(table(spark, sf_dir, "perflog_raw"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p3_found, p3_dest_totals, p4_found, p4_files, p4_containers, p4_lookup, p5_found, p5_entries)}

ORACLE_SQL: dict[str, str] = {
    "p1_found": packed_fields.PACKED_SQL,
    "p3_found": skewed_keys.HEAVY_SQL,
    "p3_dest_totals": skewed_keys.TOTALS_SQL,
    "p4_found": archives.FOUND_SQL,
    "p4_files": archives.FILES_SQL,
    "p4_lookup": archives.LOOKUP_SQL,
    "p5_found": log_entries.found_sql(),
}
