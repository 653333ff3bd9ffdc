"""The queries of the problems of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rangeloom.config import materialize
from rangeloom.llm import mixing, packing, percentiles, residue
from rangeloom.llm.tokens import token_sizes
from rangeloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.all_percentiles(table(spark, sf_dir, "particle_mem"), table(spark, sf_dir, "bounds"))


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.merged_percentiles(table(spark, sf_dir, "particle_mem"), table(spark, sf_dir, "bounds"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_documents(table(spark, sf_dir, "documents"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.packed_documents(table(spark, sf_dir, "documents")))


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(token_sizes(table(spark, sf_dir, "documents")))
    return packing.packing_faults(packing.pack_documents(sizes), sizes)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "mix_target")
    return mixing.shares(mixing.mixed(table(spark, sf_dir, "documents"), target), target)


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "mix_target")
    sizes = materialize(token_sizes(table(spark, sf_dir, "documents"), ("doc_id", "source")))
    return mixing.mixture_faults(materialize(mixing.mix_documents(sizes, target)), sizes, target)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found_documents(table(spark, sf_dir, "documents"))


def p8_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.clean_documents(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_percentiles, p2_merged, p6_found, p6_containers, p6_fill, p6_faults, p7_mixture, p7_shares, p7_faults, p8_found, p8_residue, p8_clean)}

ORACLE_SQL: dict[str, str] = {
    "p2_percentiles": percentiles.percentiles_sql(),
    "p6_found": packing.FOUND_SQL,
    "p6_faults": packing.FAULTS_SQL,
    "p7_faults": mixing.FAULTS_SQL,
}
