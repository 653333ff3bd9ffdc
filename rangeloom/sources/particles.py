"""Given tables seen as particle records: epoch, rank, seq, name, key and payload columns.

seq numbers the records of an (epoch, rank) by a unique order of their columns; it is made where it is needed only,
since it costs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.sources.tables import table

RANKS = 8
#: The order in which the records of a rank arrive; these columns together are unique in lineitem.
ARRIVAL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def line_particles(spark: SparkSession, sf_dir: str, ranks: int = RANKS) -> DataFrame:
    """lineitem as records: epoch (years from 1994), rank (supplier modulo ranks), key (price as a 32-bit float), name."""
    return table(spark, sf_dir, "lineitem").select(
        (F.year("l_shipdate") - 1994).cast("int").alias("epoch"),
        F.pmod("l_suppkey", F.lit(ranks)).cast("int").alias("rank"),
        F.col("l_extendedprice").cast("float").alias("key"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"),
        *ARRIVAL,
    )


def event_particles(spark: SparkSession, sf_dir: str, ranks: int = RANKS) -> DataFrame:
    """events as records: epoch (day from 2024-01-01, from 1), rank (user modulo ranks), name (event_id), key, payload."""
    return table(spark, sf_dir, "events").select(
        (F.datediff("ts", F.lit("2024-01-01")) + 1).cast("int").alias("epoch"),
        F.pmod("user_id", F.lit(ranks)).cast("int").alias("rank"),
        F.col("event_id").cast("string").alias("name"),
        F.col("value").cast("float").alias("key"),
        "event_id", "ts", "user_id", "event_type", "value", "props",
    )


def arrival(*by: str) -> Column:
    """The place of a record in the order of arrival, from 1, within ``by``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*ARRIVAL))


#: The same records in SQL, for comparison.
LINE_SQL = """line AS (
    SELECT CAST(year(l_shipdate) - 1994 AS INTEGER) AS epoch, CAST(l_suppkey % 8 AS INTEGER) AS "rank", CAST(l_extendedprice AS FLOAT) AS key,
        CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS name, *
    FROM lineitem
)"""
EVENT_SQL = """event AS (
    SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch, CAST(user_id % 8 AS INTEGER) AS "rank",
        CAST(event_id AS VARCHAR) AS name, CAST(value AS FLOAT) AS key, event_id, ts, user_id, event_type, value, props
    FROM events
)"""
SEQ_SQL = "row_number() OVER (PARTITION BY epoch, \"rank\" ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"
