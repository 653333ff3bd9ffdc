"""Queries of range partitioning, lookup and monitoring over the given tables, with the same in SQL.

Records are lineitem (epoch: year, rank: supplier modulo 8, key: price) or events (epoch: day, rank: user modulo 8).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.config import shared_dir
from rangeloom.functions import edges as E
from rangeloom.functions import records
from rangeloom.functions import scalar as S
from rangeloom.operators import balance, histograms, lookup, metrics, pivots, placement, sampling, stores
from rangeloom.sources import generate, traces
from rangeloom.sources.particles import ARRIVAL, EVENT_SQL, LINE_SQL, RANKS, SEQ_SQL, event_particles, line_particles
from rangeloom.sources.tables import table
from rangeloom.streaming.adaptive import AdaptivePartitioner, InterEpochPolicy, IntraEpochPolicy

Query = Callable[[SparkSession, str], DataFrame]
#: Edges of eight bins of prices; prices lie on both sides of them.
EDGES = [2000.0, 15000.0, 27000.0, 39000.0, 51000.0, 63000.0, 75000.0, 87000.0, 98000.0]
PIVOTS, SAMPLE = 16, 256
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _steps(n: int) -> str:
    return ", ".join(f"CAST({k} AS DOUBLE) / {n - 1}" for k in range(n))


def _edges(edges: list[float] = EDGES) -> str:
    return "[" + ", ".join(f"CAST({e} AS DOUBLE)" for e in edges) + "]"


_BIN = f"len(list_filter({_edges()}, lambda e: e <= key)) - 1"
_CLAMPED = f"greatest(0, least(7, {_BIN}))"


# pivots and bins


@query(f"WITH {LINE_SQL}, q AS (SELECT quantile_cont(CAST(key AS DOUBLE), [{_steps(9)}]) AS p FROM line) SELECT CAST(unnest(range(9)) AS INTEGER) AS k, round(unnest(p), 4) AS pivot FROM q")
def pivots_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.quantile_edges(line_particles(spark, sf_dir), "key", 9).select("k", F.round("pivot", 4).alias("pivot"))


@query(f"WITH {LINE_SQL}, q AS (SELECT epoch, quantile_cont(CAST(key AS DOUBLE), [{_steps(9)}]) AS p FROM line GROUP BY epoch) SELECT epoch, CAST(unnest(range(9)) AS INTEGER) AS k, round(unnest(p), 4) AS pivot FROM q")
def pivots_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.quantile_edges(line_particles(spark, sf_dir), "key", 9, ["epoch"]).select("epoch", "k", F.round("pivot", 4).alias("pivot"))


@query()
def pivots_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.approximate_edges(line_particles(spark, sf_dir), "key", 9)


@query(f"WITH {LINE_SQL} SELECT CAST({_BIN} AS INTEGER) AS bin, count(*) AS n FROM line GROUP BY 1")
def bin_assign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_particles(spark, sf_dir).groupBy(E.bin_index(F.col("key"), EDGES).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {LINE_SQL}, c AS (SELECT epoch, CAST({_CLAMPED} AS INTEGER) AS dest, count(*) AS n FROM line GROUP BY 1, 2), e AS (SELECT DISTINCT epoch, CAST(unnest(range(8)) AS INTEGER) AS dest FROM line) SELECT e.epoch, e.dest, coalesce(c.n, 0) AS n FROM e LEFT JOIN c USING (epoch, dest)")
def bin_assign_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placement.place_by_range(line_particles(spark, sf_dir), "key", EDGES, purge=True)
    return placement.destination_counts(placed, RANKS, ["epoch"])


@query(f"WITH {LINE_SQL} SELECT epoch, CAST(CASE WHEN key < 2000 THEN -1 WHEN key >= 98000 THEN 1 ELSE 0 END AS INTEGER) AS position, count(*) AS n, round(min(key), 2) AS least, round(max(key), 2) AS most FROM line GROUP BY 1, 2")
def oob_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = E.relative_position(F.col("key"), F.lit(EDGES[0]), F.lit(EDGES[-1]))
    return line_particles(spark, sf_dir).groupBy("epoch", at.alias("position")).agg(F.count("*").alias("n"), F.round(F.min("key"), 2).alias("least"), F.round(F.max("key"), 2).alias("most"))


@query(f"WITH {LINE_SQL}, c AS (SELECT epoch, {_CLAMPED} AS dest, count(*) AS n FROM line GROUP BY 1, 2), e AS (SELECT DISTINCT epoch, unnest(range(8)) AS dest FROM line), f AS (SELECT e.epoch, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (epoch, dest)) SELECT epoch, round(stddev_pop(n) / avg(n), 6) AS load_std FROM f GROUP BY epoch")
def load_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placement.place_by_range(line_particles(spark, sf_dir), "key", EDGES, purge=True)
    return balance.load_stddev(placement.destination_counts(placed, RANKS, ["epoch"]), ["epoch"]).select("epoch", F.round("load_std", 6).alias("load_std"))


_FIRST = f"WITH {LINE_SQL}, seq AS (SELECT *, {SEQ_SQL} AS seq FROM line)"


@query(f"{_FIRST} SELECT epoch, \"rank\", seq, key, name FROM seq WHERE seq <= {SAMPLE}")
def first_n_per_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("epoch", "rank").orderBy(*ARRIVAL)
    return line_particles(spark, sf_dir).withColumn("seq", F.row_number().over(w)).filter(F.col("seq") <= SAMPLE).select("epoch", "rank", "seq", "key", "name")


@query(f"""{_FIRST}, keys AS (SELECT DISTINCT epoch, "rank", key FROM seq WHERE seq <= {SAMPLE}),
q AS (SELECT epoch, "rank", quantile_cont(CAST(key AS DOUBLE), [{_steps(PIVOTS)}]) AS p, count(*) AS n, max(CAST(key AS DOUBLE)) AS m FROM keys GROUP BY 1, 2),
r AS (SELECT epoch, "rank", CAST(unnest(range({PIVOTS})) AS INTEGER) AS k, unnest(p) AS pivot, m, n FROM q)
SELECT epoch, "rank", k, round(CASE WHEN k = {PIVOTS - 1} THEN m + pow(2, floor(log2(m)) - 23) ELSE \"pivot\" END + 1e-5, 3) AS pivot, round(CAST(n AS DOUBLE) / {PIVOTS - 1}, 6) AS weight FROM r""")
def first_n_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = pivots.first_pivots(line_particles(spark, sf_dir), "key", PIVOTS, SAMPLE, ["epoch", "rank"], ARRIVAL)
    return sets.select("epoch", "rank", F.posexplode("pivots").alias("k", "pivot"), "weight").select("epoch", "rank", "k", F.round(F.col("pivot") + 1e-5, 3).alias("pivot"), F.round("weight", 6).alias("weight"))


def _next(x: str) -> str:
    """The next larger 32-bit float of a positive one."""
    return f"(CAST({x} AS DOUBLE) + pow(2, floor(log2({x})) - 23))"


def _combined_sql(groups: str, by: str, n: int) -> str:
    """Relation pivots (by, k, pivot, weight) over a relation of groups (by, e, w, lk, rk): edges, weights, and the sorted keys left and right."""
    between = lambda keys, place: f"({keys}[CAST(floor({place}) AS INT) + 1] + ({keys}[CAST(ceil({place}) AS INT) + 1] - {keys}[CAST(floor({place}) AS INT) + 1]) * ({place} - floor({place})))"
    return f"""sized AS (SELECT *, len(lk) AS nl, len(rk) AS nr, CAST(list_sum(w) AS DOUBLE) AS mid, list_transform(range(len(w)), lambda i: CAST(list_sum(w[1:i + 1]) AS DOUBLE)) AS cum FROM {groups}),
steps AS (SELECT *, unnest(range({n})) AS k, nl + mid + nr AS total FROM sized),
places AS (SELECT *, total * k / {n - 1} AS a, len(list_filter(cum, lambda c: c < total * k / {n - 1} - nl - 1e-9)) AS b FROM steps),
pivots AS (SELECT {by}, CAST(k AS INTEGER) AS k, CASE WHEN total = 0 THEN 0.0 WHEN k = 0 THEN coalesce(lk[1], e[1]) WHEN k = {n - 1} THEN CASE WHEN nr > 0 THEN {_next("rk[-1]")} ELSE e[-1] END
    WHEN a < nl THEN {between("lk", "(a * (nl - 1) / greatest(nl, 1))")} WHEN a - nl < mid THEN e[b + 1] + (e[b + 2] - e[b + 1]) * (a - nl - (cum[b + 1] - w[b + 1])) / w[b + 1]
    ELSE {between("rk", "((a - nl - mid) * (nr - 1) / greatest(nr, 1))")} END AS pivot, total / {n - 1} AS weight FROM places)"""


_FULL = f"""{_FIRST}, sample AS (SELECT DISTINCT epoch, "rank", CAST(key AS DOUBLE) AS key FROM seq WHERE seq <= {SAMPLE}),
q AS (SELECT epoch, "rank", quantile_cont(key, [{_steps(PIVOTS + 1)}]) AS p, max(key) AS m FROM sample GROUP BY 1, 2),
edged AS (SELECT epoch, "rank", CAST(list_concat(p[1:{PIVOTS}], [{_next("m")}]) AS FLOAT[]) AS e FROM q),
rest AS (SELECT s.epoch, s."rank", CAST(s.key AS DOUBLE) AS key, len(list_filter(d.e, lambda x: x <= s.key)) - 1 AS b FROM seq s JOIN edged d ON s.epoch = d.epoch AND s."rank" = d."rank" WHERE s.seq > {SAMPLE}),
counted AS (SELECT epoch, "rank", b, count(*) AS c FROM rest WHERE b BETWEEN 0 AND {PIVOTS - 1} GROUP BY 1, 2, 3),
sides AS (SELECT epoch, "rank", list_sort(list(DISTINCT key) FILTER (b < 0)) AS lk, list_sort(list(DISTINCT key) FILTER (b >= {PIVOTS})) AS rk FROM rest GROUP BY 1, 2),
bins AS (SELECT d.epoch, d."rank", list(coalesce(c, 0) ORDER BY i) AS w FROM (SELECT epoch, "rank", unnest(range({PIVOTS})) AS i FROM edged) d LEFT JOIN counted c ON c.epoch = d.epoch AND c."rank" = d."rank" AND c.b = d.i GROUP BY 1, 2),
full_groups AS (SELECT d.epoch, d."rank", CAST(d.e AS DOUBLE[]) AS e, bins.w, coalesce(lk, []) AS lk, coalesce(rk, []) AS rk FROM edged d JOIN bins USING (epoch, "rank") LEFT JOIN sides USING (epoch, "rank")),
{_combined_sql("full_groups", 'epoch, "rank"', PIVOTS)}"""


@query(f"{_FULL} SELECT epoch, \"rank\", k, round(\"pivot\" + 1e-5, 3) AS pivot, round(weight, 6) AS weight FROM pivots")
def full_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = pivots.full_pivots(line_particles(spark, sf_dir), "key", PIVOTS, SAMPLE, ["epoch", "rank"], ARRIVAL)
    rows = sets.select("epoch", "rank", F.posexplode("pivots").alias("k", "pivot"), "weight")
    return rows.select("epoch", "rank", "k", F.round(F.col("pivot") + 1e-5, 3).alias("pivot"), F.round("weight", 6).alias("weight"))


@query(f"WITH {LINE_SQL} SELECT epoch, CAST(len(list(DISTINCT key)) AS INTEGER) AS n_keys, round(min(key), 2) AS least, round(max(key), 2) AS most FROM line GROUP BY epoch")
def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pivots.dedup_keys(line_particles(spark, sf_dir), "key", ["epoch"])
    return kept.groupBy("epoch").agg(F.count("*").cast("int").alias("n_keys"), F.round(F.min("key"), 2).alias("least"), F.round(F.max("key"), 2).alias("most"))


_HIST = f"""hist AS (
    SELECT b.epoch, b.bin, e[b.bin + 1] AS lo, e[b.bin + 2] AS hi, CAST(coalesce(c.n, 0) AS DOUBLE) AS w
    FROM (SELECT DISTINCT epoch, unnest(range(8)) AS bin FROM line) b CROSS JOIN (SELECT {_edges()} AS e)
    LEFT JOIN (SELECT epoch, {_BIN} AS bin, count(*) AS n FROM line WHERE key >= 2000 AND key < 98000 GROUP BY 1, 2) c ON b.epoch = c.epoch AND b.bin = c.bin
)"""


def _quantiles_sql(hist: str, by: str, n: int) -> str:
    """Quantiles 0 to n-1 of a histogram relation (by, lo, hi, w)."""
    return f"""cum AS (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY {by}) AS total,
    min(lo) OVER (PARTITION BY {by}) AS first, max(hi) OVER (PARTITION BY {by}) AS last FROM {hist}),
steps AS (SELECT unnest(range({n})) AS k),
picked AS (SELECT {by}, k, first, last, lo, hi, w, upto, total * k / {n - 1} AS t, row_number() OVER (PARTITION BY {by}, k ORDER BY upto, lo) AS r
    FROM cum JOIN steps ON upto >= total * k / {n - 1} - 1e-9 AND w > 0),
quantiles AS (SELECT {by}, CAST(k AS INTEGER) AS k, CASE WHEN k = 0 THEN first WHEN k = {n - 1} THEN last ELSE lo + (hi - lo) * (t - upto + w) / w END AS pivot FROM picked WHERE r = 1)"""


@query(f"WITH {LINE_SQL}, {_HIST} SELECT epoch, CAST(bin AS INTEGER) AS bin, lo, hi, w FROM hist")
def bin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epoch_histogram(spark, sf_dir)


def _epoch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placement.place_by_range(line_particles(spark, sf_dir), "key", EDGES).filter("dest IS NOT NULL")
    counts = placement.destination_counts(placed, RANKS, ["epoch"])
    points = F.array(*[F.lit(e) for e in EDGES])
    return counts.select("epoch", F.col("dest").alias("bin"), F.element_at(points, F.col("dest") + 1).alias("lo"), F.element_at(points, F.col("dest") + 2).alias("hi"), F.col("n").cast("double").alias("w"))


@query(f"WITH {LINE_SQL}, {_HIST}, {_quantiles_sql('hist', 'epoch', 9)} SELECT epoch, k, round(\"pivot\" + 1e-6, 4) AS pivot FROM quantiles")
def hist_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.histogram_quantiles(_epoch_histogram(spark, sf_dir), 9, ["epoch"]).select("epoch", "k", F.round(F.col("pivot") + 1e-6, 4).alias("pivot"))


_SETS = f"""q AS (SELECT epoch, "rank", quantile_cont(CAST(key AS DOUBLE), [{_steps(9)}]) AS p, count(*) / 8.0 AS w FROM line GROUP BY 1, 2),
chunks AS (SELECT epoch, "rank", p[i] AS lo, p[i + 1] AS hi, CAST(w AS DOUBLE) AS w FROM (SELECT *, unnest(range(1, 9)) AS i FROM q)),
points AS (SELECT DISTINCT epoch, x FROM (SELECT epoch, lo AS x FROM chunks UNION ALL SELECT epoch, hi FROM chunks)),
pieces AS (SELECT epoch, x AS lo, lead(x) OVER (PARTITION BY epoch ORDER BY x) AS hi FROM points),
merged AS (SELECT p.epoch, p.lo, p.hi, coalesce(sum(c.w * (p.hi - p.lo) / (c.hi - c.lo)), 0) AS w
    FROM pieces p LEFT JOIN chunks c ON c.epoch = p.epoch AND c.lo <= p.lo AND c.hi >= p.hi AND c.hi > c.lo WHERE p.hi IS NOT NULL GROUP BY 1, 2, 3)"""


def _rank_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = line_particles(spark, sf_dir)
    quantiles = pivots.quantile_edges(line, "key", 9, ["epoch", "rank"])
    n = line.groupBy("epoch", "rank").agg((F.count("*") / 8).alias("weight"))
    sets = quantiles.groupBy("epoch", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pivot"))), lambda x: x["pivot"]).alias("pivots"))
    return sets.join(n, ["epoch", "rank"])


@query(f"WITH {LINE_SQL}, {_SETS} SELECT epoch, round(lo, 4) AS lo, round(hi, 4) AS hi, round(w + 1e-6, 4) AS w FROM merged")
def pivot_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = pivots.pivot_union(pivots.chunks_of(_rank_sets(spark, sf_dir), ["epoch"]), ["epoch"])
    return merged.select("epoch", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round(F.col("w") + 1e-6, 4).alias("w"))


@query(f"WITH {LINE_SQL}, {_SETS}, {_quantiles_sql('merged', 'epoch', 9)} SELECT epoch, k, round(\"pivot\" + 1e-5, 3) AS pivot FROM quantiles")
def resample_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = pivots.resample(_rank_sets(spark, sf_dir), 9, ["epoch"])
    return merged.select("epoch", F.posexplode("pivots").alias("k", "pivot")).select("epoch", "k", F.round(F.col("pivot") + 1e-5, 3).alias("pivot"))


def _stage_sql(i: int, sets: str, fan: int, n: int) -> str:
    """Stage i of a tree: relation tree<i> (epoch, node, p, w), n pivots of the union of each ``fan`` sets next to each other."""
    return f"""chunks{i} AS (SELECT epoch, node // {fan} AS node, p[j] AS lo, p[j + 1] AS hi, CAST(w AS DOUBLE) AS w FROM (SELECT *, unnest(range(1, len(p))) AS j FROM {sets} WHERE w > 0)),
points{i} AS (SELECT DISTINCT epoch, node, x FROM (SELECT epoch, node, lo AS x FROM chunks{i} UNION ALL SELECT epoch, node, hi FROM chunks{i})),
pieces{i} AS (SELECT epoch, node, x AS lo, lead(x) OVER (PARTITION BY epoch, node ORDER BY x) AS hi FROM points{i}),
merged{i} AS (SELECT p.epoch, p.node, p.lo, p.hi, coalesce(sum(c.w * (p.hi - p.lo) / (c.hi - c.lo)), 0) AS w
    FROM pieces{i} p LEFT JOIN chunks{i} c ON c.epoch = p.epoch AND c.node = p.node AND c.lo <= p.lo AND c.hi >= p.hi AND c.hi > c.lo WHERE p.hi IS NOT NULL GROUP BY 1, 2, 3, 4),
cum{i} AS (SELECT *, sum(w) OVER (PARTITION BY epoch, node ORDER BY lo ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY epoch, node) AS total,
    min(lo) OVER (PARTITION BY epoch, node) AS first, max(hi) OVER (PARTITION BY epoch, node) AS last FROM merged{i}),
picked{i} AS (SELECT *, total * k / {n - 1} AS t, row_number() OVER (PARTITION BY epoch, node, k ORDER BY upto, lo) AS r
    FROM cum{i} JOIN (SELECT unnest(range({n})) AS k) ON upto >= total * k / {n - 1} - 1e-9 AND w > 0),
tree{i} AS (SELECT epoch, node, list(CASE WHEN k = 0 THEN first WHEN k = {n - 1} THEN last ELSE lo + (hi - lo) * least(1, greatest(0, (t - upto + w) / w)) END ORDER BY k) AS p, any_value(total) / {n - 1} AS w FROM picked{i} WHERE r = 1 GROUP BY 1, 2)"""


def _tree_sql(sets: str, n: int) -> str:
    return ", ".join((_stage_sql(1, sets, 2, n), _stage_sql(2, "tree1", 2, n), _stage_sql(3, "tree2", RANKS, RANKS + 1)))


@query(f"""WITH {LINE_SQL}, {_SETS}, sets AS (SELECT epoch, "rank" AS node, p, w FROM q), {_tree_sql("sets", 16)}
SELECT epoch, CAST(k AS INTEGER) AS k, round(x + 1e-5, 3) AS pivot, round(w, 4) AS weight FROM (SELECT epoch, w, unnest(range({RANKS + 1})) AS k, unnest(p) AS x FROM tree3)""")
def tree_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = pivots.tree_pivots(_rank_sets(spark, sf_dir), RANKS, (16, 16), ["epoch"])
    rows = merged.select("epoch", F.posexplode("pivots").alias("k", "pivot"), "weight")
    return rows.select("epoch", "k", F.round(F.col("pivot") + 1e-5, 3).alias("pivot"), F.round("weight", 4).alias("weight"))


@query(f"""{_FULL}, sets AS (SELECT epoch, "rank" AS node, list("pivot" ORDER BY k) AS p, any_value(weight) AS w FROM pivots GROUP BY 1, 2), {_tree_sql("sets", PIVOTS)},
own AS (SELECT d.epoch, row_number() OVER (ORDER BY d.epoch) - 1 AS epidx, CAST(coalesce(p, list_transform(range({RANKS + 1}), lambda i: 0.0)) AS FLOAT[]) AS e FROM (SELECT DISTINCT epoch FROM line) d LEFT JOIN tree3 USING (epoch)),
chosen AS (SELECT epoch, epidx, 'epxpp' AS runtype, e FROM own UNION ALL SELECT epoch, epidx, 'ep0pp', first(e) OVER (ORDER BY epoch) FROM own UNION ALL SELECT epoch, epidx, 'epxsub1pp', lag(e) OVER (ORDER BY epoch) FROM own),
assigned AS (SELECT c.runtype, c.epidx, greatest(0, least({RANKS - 1}, len(list_filter(c.e, lambda x: x <= l.key)) - 1)) AS dest, count(*) AS n FROM line l JOIN chosen c ON l.epoch = c.epoch WHERE c.e IS NOT NULL GROUP BY 1, 2, 3),
filled AS (SELECT s.runtype, s.epidx, coalesce(n, 0) AS n FROM (SELECT DISTINCT runtype, epidx, unnest(range({RANKS})) AS dest FROM assigned) s LEFT JOIN assigned a USING (runtype, epidx, dest))
SELECT runtype, {RANKS} AS nranks, {PIVOTS} AS pvtcnt, CAST(epidx AS INTEGER) AS epidx, round(stddev_pop(n) / avg(n), 6) AS load_std FROM filled GROUP BY runtype, epidx""")
def load_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = balance.load_suites(line_particles(spark, sf_dir), "key", RANKS, PIVOTS, SAMPLE, ARRIVAL)
    return found.withColumn("load_std", F.round("load_std", 6))


@query(f"""WITH {LINE_SQL}, q AS (SELECT epoch, quantile_cont(CAST(key AS DOUBLE), [{_steps(9)}]) AS p FROM line GROUP BY epoch),
placed AS (SELECT l.epoch, greatest(0, least(7, len(list_filter(q.p, lambda e: CAST(e AS FLOAT) <= l.key)) - 1)) AS dest FROM line l JOIN q ON q.epoch = l.epoch - 1),
counts AS (SELECT epoch, dest, count(*) AS n FROM placed GROUP BY 1, 2), every AS (SELECT DISTINCT epoch, unnest(range(8)) AS dest FROM placed)
SELECT e.epoch, round(stddev_pop(coalesce(n, 0)) / avg(coalesce(n, 0)), 6) AS load_std FROM every e LEFT JOIN counts c USING (epoch, dest) GROUP BY e.epoch""")
def prev_epoch_pivots_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = line_particles(spark, sf_dir)
    by_epoch = pivots.quantile_edges(line, "key", 9, ["epoch"]).groupBy("epoch").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pivot"))), lambda x: x["pivot"]).alias("edges"))
    present = line.select("epoch").distinct()
    earlier = by_epoch.select((F.col("epoch") + 1).alias("epoch"), "edges").join(present, "epoch", "left_semi")
    counts = balance.count_into_bins(line, "key", earlier, RANKS, ["epoch"])
    return balance.load_stddev(counts, ["epoch"]).select("epoch", F.round("load_std", 6).alias("load_std"))


@query(f"""WITH {LINE_SQL}, {_HIST}, one AS (SELECT {_edges()} AS e, (SELECT list(s + 1.0 ORDER BY bin) FROM (SELECT bin, sum(w) AS s FROM hist GROUP BY bin)) AS w,
    (SELECT list_sort(list(DISTINCT CAST(key AS DOUBLE))) FROM line WHERE key < {EDGES[0]}) AS lk, (SELECT list_sort(list(DISTINCT CAST(key AS DOUBLE))) FROM line WHERE key >= {EDGES[-1]}) AS rk),
{_combined_sql("one", "1 AS one", 9)} SELECT k, round("pivot" + 1e-5, 3) AS pivot, round(weight, 6) AS weight FROM pivots""")
def calc_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.calc_pivots(line_particles(spark, sf_dir), "key", EDGES, [1.0] * 8, 9)
    return found.select(F.posexplode("pivots").alias("k", "pivot"), "weight").select("k", F.round(F.col("pivot") + 1e-5, 3).alias("pivot"), F.round("weight", 6).alias("weight"))


@query(f"WITH {LINE_SQL}, {_HIST} SELECT CAST(bin AS INTEGER) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, sum(w) + 1.0 AS w FROM hist GROUP BY bin")
def fill_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.fill_bins(pivots.bins_from_arrays(spark, EDGES, [1.0] * 8), line_particles(spark, sf_dir), "key", EDGES)


@query(f"WITH {LINE_SQL}, {_SETS}, w AS (SELECT epoch, min(lo) AS a, max(hi) AS b FROM merged GROUP BY epoch) SELECT n.epoch, n.a <= o.a + 1e-3 AND n.b >= o.b - 1e-3 AS widened FROM w n JOIN w o ON o.epoch = n.epoch - 1")
def widened_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = pivots.resample(_rank_sets(spark, sf_dir), 9, ["epoch"]).select("epoch", "pivots")
    earlier = merged.select((F.col("epoch") + 1).alias("epoch"), F.col("pivots").alias("old"))
    return merged.join(earlier, "epoch").select("epoch", pivots.widened(F.col("old"), F.col("pivots")).alias("widened"))


# placement


@query()
def hash_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.destination_counts(placement.place_by_hash(event_particles(spark, sf_dir), "name", RANKS), RANKS)


@query()
def ring_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.destination_counts(placement.place_by_ring(event_particles(spark, sf_dir), "name", RANKS), RANKS)


@query(f"WITH {LINE_SQL} SELECT CAST({_CLAMPED} AS INTEGER) AS partition, count(*) AS n, round(min(key), 2) AS least, round(max(key), 2) AS most FROM line GROUP BY 1")
def range_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placement.place_by_range(line_particles(spark, sf_dir), "key", EDGES, purge=True)
    moved = placement.to_destinations(placed, RANKS)
    return moved.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"), F.round(F.min("key"), 2).alias("least"), F.round(F.max("key"), 2).alias("most"))


@query("SELECT CAST(n AS INTEGER) AS \"rank\", CAST(r AS INTEGER) AS radix, (n // (1 << r)) * (1 << r) = n AS receives FROM (SELECT unnest(range(32)) AS n), (SELECT unnest(range(4)) AS r)")
def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(32).select(F.col("id").cast("int").alias("rank"))
    return rows.select("rank", F.explode(F.array(*[F.struct(F.lit(r).alias("radix"), S.is_receiver(F.col("rank"), r).alias("receives")) for r in range(4)])).alias("x")).select("rank", "x.*")


_PATHS = "SELECT CASE event_type WHEN 'click' THEN '/mnt/out/particle/' WHEN 'view' THEN '/mnt/out2/' WHEN 'error' THEN '/mnt/out/tmp/' ELSE '/mnt/out' END || CAST(event_id AS VARCHAR) AS path FROM events"


@query(f"SELECT CASE WHEN path LIKE '/mnt/out/tmp/%' THEN 'ignored' WHEN path LIKE '/mnt/out/%' THEN 'inside' ELSE 'outside' END AS route, count(*) AS n FROM ({_PATHS}) GROUP BY 1")
def path_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    root = F.when(kind == "click", "/mnt/out/particle/").when(kind == "view", "/mnt/out2/").when(kind == "error", "/mnt/out/tmp/").otherwise("/mnt/out")
    paths = table(spark, sf_dir, "events").select(F.concat(root, F.col("event_id").cast("string")).alias("path"))
    return paths.groupBy(placement.claimed_path(F.col("path"), "/mnt/out", ["/mnt/out/tmp"]).alias("route")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_discount AS a, l_tax AS b FROM lineitem)
SELECT abs(CAST(a AS FLOAT) - CAST(b AS FLOAT)) < 1e-3 AS eq, CAST(a AS FLOAT) > CAST(b AS FLOAT) + CAST(1e-3 AS FLOAT) AS gt, CAST(a AS FLOAT) < CAST(b AS FLOAT) - CAST(1e-3 AS FLOAT) AS lt, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def epsilon_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy(E.float_eq(a, b).alias("eq"), E.float_gt(a, b).alias("gt"), E.float_lt(a, b).alias("lt")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT list_filter([CASE WHEN NOT coalesce(length(props) <= 9, false) THEN 'size' END, CASE WHEN NOT coalesce(value > 0.5, false) THEN 'value' END, CASE WHEN NOT coalesce(user_id % 8 < 7, false) THEN 'route' END], lambda x: x IS NOT NULL) AS broken FROM events)
SELECT array_to_string(broken, ',') AS broken, count(*) AS n FROM b WHERE len(broken) > 0 GROUP BY 1""")
def invalid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"size": F.length("props") <= 9, "value": F.col("value") > 0.5, "route": F.pmod("user_id", F.lit(8)) < 7}
    found = placement.invalid_records(table(spark, sf_dir, "events"), rules)
    return found.groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


# layouts and lookups


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_particles(spark, sf_dir).withColumn("payload", F.col("props"))


@query(f"""WITH {EVENT_SQL} SELECT name, epoch, "rank" AS src_rank, CAST(coalesce(sum(strlen(props)) OVER (PARTITION BY "rank" ORDER BY epoch, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", props AS payload FROM event""")
def wisc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, index = stores.separate(_stored(spark, sf_dir), RANKS, ["event_id"])
    return lookup.dereference(index, log).select("name", "epoch", "src_rank", "offset", "payload")


@query(f"WITH {EVENT_SQL} SELECT name, epoch, \"rank\" AS src_rank, props AS payload, true AS found FROM event WHERE event_id % 100 = 0")
def bloomy_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _stored(spark, sf_dir)
    asked = data.filter(F.col("event_id") % 100 == 0).select("name")
    return lookup.probe(asked, stores.name_filter(data, RANKS), data, RANKS).select("name", "epoch", "src_rank", "payload", "found")


@query(f"WITH {LINE_SQL} SELECT name, count(DISTINCT epoch) AS n_epochs, string_agg(l_returnflag || l_linestatus, '' ORDER BY epoch, l_returnflag || l_linestatus) AS value FROM line WHERE l_orderkey % 100 = 0 GROUP BY name")
def name_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = line_particles(spark, sf_dir)
    flags = table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") - 1994).cast("int").alias("epoch"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"), F.concat("l_returnflag", "l_linestatus").alias("payload"))
    stored = placement.place_by_hash(flags, "name", RANKS, dest="rank")
    asked = line.filter(F.col("l_orderkey") % 100 == 0).select("name")
    return lookup.values_of(lookup.lookup(stored, asked, RANKS))


@query(f"WITH {EVENT_SQL} SELECT epoch, name, props AS payload FROM event WHERE name = '4242'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = placement.place_by_hash(_stored(spark, sf_dir).drop("rank"), "name", RANKS, dest="rank")
    return lookup.lookup_one(stored, "4242", RANKS).select("epoch", "name", "payload")


@query(f"WITH {EVENT_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY \"rank\" ORDER BY (event_id * 2654435761) % 1000003, name) AS r FROM event) SELECT \"rank\", name, props AS payload FROM s WHERE r <= 25")
def sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _stored(spark, sf_dir)
    order = (F.col("event_id") * 2654435761) % 1000003
    asked = lookup.sample_names(data.select("rank", "name", "event_id"), 25, order=order)
    return data.join(F.broadcast(asked.select("rank", "name")), ["rank", "name"]).select("rank", "name", "payload")


@query(f"WITH {LINE_SQL}, asked AS (SELECT DISTINCT name FROM line WHERE \"rank\" = 0), ranks AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS \"rank\"), c AS (SELECT name, \"rank\", count(*) AS hits FROM line GROUP BY 1, 2) SELECT a.name, r.\"rank\", coalesce(c.hits, 0) AS hits FROM asked a CROSS JOIN ranks r LEFT JOIN c ON c.name = a.name AND c.\"rank\" = r.\"rank\"")
def anti_shuffle_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = line_particles(spark, sf_dir)
    return lookup.lookup_everywhere(line, line.filter("rank = 0"), RANKS)


_SCAN = f"WITH {LINE_SQL} SELECT epoch, name, key FROM line WHERE key >= 42000 AND key < 47000"


@query(_SCAN)
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.range_scan(line_particles(spark, sf_dir), "key", 42000.0, 47000.0, source="l_extendedprice").select("epoch", "name", "key")


@query(_SCAN)
def range_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/range-store/{uuid.uuid4().hex}"
    stores.write_store(line_particles(spark, sf_dir).withColumn("payload", F.lit("")), path, "range", RANKS, edges=EDGES)
    return lookup.range_scan(lookup.read_store(spark, path), "key", 42000.0, 47000.0, lookup.read_bounds(spark, path)).select("epoch", "name", "key")


@query(f"WITH {EVENT_SQL} SELECT name, epoch, props AS payload FROM event WHERE event_id % 100 = 0")
def kvsep_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/kvsep-store/{uuid.uuid4().hex}"
    data = _stored(spark, sf_dir).select("epoch", "rank", "name", "payload", "event_id")
    stores.write_store(data, path, "kvsep", RANKS, ["event_id"])
    asked = data.filter(F.col("event_id") % 100 == 0).select("name")
    hits = lookup.lookup(lookup.read_store(spark, path), asked, RANKS)
    return lookup.dereference(hits, lookup.read_log(spark, path)).select("name", "epoch", "payload")


@query(f"{_FIRST} SELECT epoch, \"rank\", count(*) AS n, max(seq) AS last FROM seq WHERE seq <= 500 GROUP BY 1, 2")
def write_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = line_particles(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("epoch", "rank").orderBy(*ARRIVAL)))
    return stores.limit_writes(line, 500, ["epoch", "rank"], ["seq"]).groupBy("epoch", "rank").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query(f"WITH {LINE_SQL}, seq AS (SELECT *, row_number() OVER (PARTITION BY \"rank\" ORDER BY epoch, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS s FROM line) SELECT epoch, \"rank\", count(*) AS n FROM seq WHERE s < 500 GROUP BY 1, 2")
def write_limit_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.limit_writes(line_particles(spark, sf_dir), 500, ["epoch", "rank"], ARRIVAL, legacy=True).groupBy("epoch", "rank").agg(F.count("*").alias("n"))


# names


@query("WITH w AS (SELECT CAST(user_id AS VARCHAR) AS name, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS epoch FROM events), g AS (SELECT name, bool_or(epoch = 1) AS first, count(*) FILTER (epoch > 1) AS later FROM w GROUP BY name) SELECT name, later + 1 AS n, later + 1 = 30 AS valid FROM g WHERE first")
def stable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = event_particles(spark, sf_dir).select("epoch", F.col("user_id").cast("string").alias("name"))
    return sampling.stable_names(users, 30)


@query(f"WITH {LINE_SQL} SELECT epoch, \"rank\", count(*) AS n, count(*) - count(DISTINCT name) AS collisions FROM line GROUP BY 1, 2")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.collisions(line_particles(spark, sf_dir))


_NAMES = "printf('%016x', (CAST(o_custkey % 8 AS BIGINT) << 28) | o_orderkey)"


@query(f"WITH h AS (SELECT o_orderkey, {_NAMES} AS h FROM orders) SELECT o_orderkey, base64(unhex(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2))) AS name FROM h")
def particle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", S.particle_name(S.particle_id(F.pmod("o_custkey", F.lit(8)), F.col("o_orderkey"))).alias("name"))


@query()
def pretty_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.pretty_duration(price / 1000).alias("duration"), S.pretty_number(price).alias("number"), S.pretty_size(price * 1000).alias("size"), S.pretty_bandwidth(price * 1000, F.lit(2.0)).alias("bandwidth"), S.pretty_rate(price, F.lit(2.0)).alias("rate"))


# monitoring


_BY_RANK = f"{EVENT_SQL}, m AS (SELECT epoch, \"rank\", count(*) AS writes, sum(strlen(props)) AS bytes, count(*) FILTER (event_id % 8 = \"rank\") AS local, min(ts) AS first_ts, max(ts) AS last_ts FROM event GROUP BY 1, 2)"


def _by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_particles(spark, sf_dir).groupBy("epoch", "rank").agg(F.count("*").alias("writes"), F.sum(F.octet_length("props")).alias("bytes"), F.count_if(placement.is_local(F.col("event_id") % 8, F.col("rank"))).alias("local"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {_BY_RANK} SELECT epoch, CAST(sum(writes) AS BIGINT) AS total_writes, CAST(sum(bytes) AS BIGINT) AS total_bytes, min(writes) AS min_writes, max(writes) AS max_writes, CAST(max(bytes) AS BIGINT) AS max_bytes FROM m GROUP BY epoch")
def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reduce_metrics(_by_rank(spark, sf_dir), ["epoch"], ["writes", "bytes"], ["writes"], ["writes", "bytes"])


@query(f"WITH {_BY_RANK}, c AS (SELECT epoch, \"rank\", CAST(sum(writes) OVER (PARTITION BY \"rank\" ORDER BY epoch) AS BIGINT) AS writes FROM m) SELECT epoch, \"rank\", writes, writes - coalesce(lag(writes) OVER (PARTITION BY \"rank\" ORDER BY epoch), 0) AS d_writes FROM c")
def epoch_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = F.sum("writes").over(Window.partitionBy("rank").orderBy("epoch"))
    return metrics.epoch_deltas(_by_rank(spark, sf_dir).select("epoch", "rank", upto.alias("writes")), ["writes"])


@query(f"WITH {EVENT_SQL} SELECT epoch, count(*) FILTER (event_id % 8 = \"rank\") AS local, count(*) FILTER (event_id % 8 <> \"rank\") AS foreign_, count(*) AS writes, count(*) FILTER (event_type <> 'error') AS delivered FROM event GROUP BY epoch HAVING count(*) FILTER (event_type <> 'error') <> count(*)")
def epoch_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = placement.is_local(F.col("event_id") % 8, F.col("rank"))
    seen = event_particles(spark, sf_dir).groupBy("epoch").agg(F.count_if(here).alias("local"), F.count_if(~here).alias("foreign"), F.count("*").alias("writes"), F.count("*").alias("sent"), F.count_if(F.col("event_type") != "error").alias("delivered"))
    found = metrics.violations(seen.withColumn("received", F.col("delivered")))
    return found.select("epoch", "local", F.col("foreign").alias("foreign_"), "writes", "delivered")


@query(f"WITH {_BY_RANK}, e AS (SELECT epoch, CAST(sum(writes) AS BIGINT) AS writes, CAST(sum(bytes) AS BIGINT) AS bytes FROM m GROUP BY epoch) SELECT epoch, writes, bytes, round(writes / 86400.0, 6) AS write_per_s, round(86400.0 / writes, 6) AS s_per_write, round(writes / 86400.0 / 8, 6) AS write_per_rank_s, round(writes * 12.0 / bytes * 100, 6) AS index_pct FROM e")
def derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.reduce_metrics(_by_rank(spark, sf_dir), ["epoch"], ["writes", "bytes"]).toDF("epoch", "writes", "bytes").withColumn("seconds", F.lit(86400.0))
    rated = metrics.rates(per, "seconds", {"write": "writes"}, RANKS)
    full = metrics.storage_overhead(rated.withColumns({"index_bytes": F.col("writes") * 12, "filter_bytes": F.lit(0)}), "index_bytes", "filter_bytes", "bytes", "bytes")
    return full.select("epoch", "writes", "bytes", *[F.round(c, 6).alias(c) for c in ("write_per_s", "s_per_write", "write_per_rank_s", "index_pct")])


@query(f"WITH {EVENT_SQL} SELECT CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, event_type AS stat_type, props AS stat_value FROM event")
def perf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return metrics.perf_rows(events, "ms", "event_type", "props")


@query(f"WITH {EVENT_SQL}, e AS (SELECT CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, event_type, value FROM event WHERE value IS NOT NULL), r AS (SELECT ms // 3600000 * 3600000 AS ts_ms, event_type, value, row_number() OVER (PARTITION BY ms // 3600000, event_type ORDER BY ms DESC, CAST(CAST(floor(value * 1000) AS BIGINT) AS VARCHAR) DESC) AS n FROM e) SELECT ts_ms, event_type AS stat_type, CAST(CAST(floor(value * 1000) AS BIGINT) AS VARCHAR) AS stat_value FROM r WHERE n = 1")
def perf_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    timed = events.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_type", F.floor(F.col("value") * 1000).cast("string").alias("value"))
    return metrics.perf_log(timed, "ms", "event_type", "value", 3_600_000)


@query("SELECT event_id, hex(encode(CAST(event_id AS VARCHAR) || props) || unhex(repeat('00', 32 - strlen(CAST(event_id AS VARCHAR) || props)))) AS record FROM events")
def packed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.hex(records.pack_record(F.col("event_id").cast("string"), F.col("props"), 32)).alias("record"))


@query("SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(floor(min((l_tax + l_discount) / nullif(l_quantity, 0) * 100)) AS BIGINT) AS min_cpu, CAST(ceil(max((l_tax + l_discount) / nullif(l_quantity, 0) * 100)) AS BIGINT) AS max_cpu FROM lineitem GROUP BY 1")
def cpu_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cpu_use(table(spark, sf_dir, "lineitem"), "l_tax", "l_discount", "l_quantity", ["l_linenumber"])


@query(f"WITH {EVENT_SQL}, f AS (SELECT epoch, \"rank\", min(event_id) AS arrived FROM event GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY arrived, \"rank\") AS r, max(arrived) OVER (PARTITION BY epoch) AS last FROM f) SELECT epoch, \"rank\" AS first_rank, arrived AS first_at, last - arrived AS wait FROM o WHERE r = 1")
def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = event_particles(spark, sf_dir).groupBy("epoch", "rank").agg(F.min("event_id").alias("at"))
    return metrics.first_to_arrive(arrived, "at", "rank", ["epoch"])


@query("WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, any_value(n) AS n, round(avg(value), 6) AS avg, max(CASE WHEN r = (n - 1) // 2 + 1 THEN value END) AS median, min(value) AS min, max(value) AS max, round(sum(value), 4) AS total FROM o GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", "n", F.round("avg", 6).alias("avg"), "median", "min", "max", F.round("total", 4).alias("total"))


@query("WITH r AS (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) AS us FROM events) SELECT event_type, count(*) AS rounds, CAST(sum(us) // count(*) AS BIGINT) AS mean, round(stddev_pop(us), 4) AS std, min(us) AS min, max(us) AS max FROM r GROUP BY event_type")
def round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 1000).cast("bigint").alias("us"))
    found = metrics.round_summary(rounds, "us", ["event_type"])
    return found.select("event_type", "rounds", "mean", F.round("std", 4).alias("std"), "min", "max")


@query("WITH l AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS \"rank\", l_linenumber AS t, CAST(l_quantity AS BIGINT) AS d, l_returnflag <> 'R' AS ok FROM lineitem) SELECT \"rank\", count(*) AS queries, CAST(sum(t) AS BIGINT) AS total_table_seeks, min(t) AS min_table_seeks, max(t) AS max_table_seeks, CAST(sum(d) AS BIGINT) AS total_data_seeks, min(d) AS min_data_seeks, max(d) AS max_data_seeks, count(*) FILTER (ok) AS ok_ops, CAST(sum(greatest(t - 1, 0)) AS BIGINT) AS extra_ops FROM l GROUP BY 1")
def read_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(8)).cast("int").alias("rank"), F.col("l_linenumber").alias("table_seeks"), F.col("l_quantity").cast("bigint").alias("data_seeks"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_linenumber").alias("ops"))
    return metrics.read_amplification(reads, ["rank"])


@query("SELECT CAST(l_suppkey % 8 AS INTEGER) AS \"rank\", count(*) FILTER (l_returnflag = 'R') AS dropped, CAST(sum(CAST(l_extendedprice AS BIGINT)) AS BIGINT) AS bytes_read, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes_written, CAST(sum(l_linenumber) AS BIGINT) AS files_read, count(*) AS files_written, max(l_tax) AS max_drain_time FROM (SELECT * REPLACE (floor(l_extendedprice) AS l_extendedprice) FROM lineitem) GROUP BY 1")
def drop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(8)).cast("int").alias("rank"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("dropped"), F.floor("l_extendedprice").cast("bigint").alias("bytes_read"), F.col("l_quantity").cast("bigint").alias("bytes_written"), F.col("l_linenumber").alias("files_read"), F.lit(1).alias("files_written"), F.col("l_tax").alias("drain_time"))
    return metrics.drop_summary(rows, ["rank"])


_LIMITS = "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in histograms.LIMITS) + "]"


@query(f"""WITH b AS (SELECT event_type, least(len(list_filter({_LIMITS}, lambda e: e <= value)), {len(histograms.LIMITS) - 1}) AS b, value FROM events WHERE value IS NOT NULL),
c AS (SELECT event_type, b, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT event_type, count(*) AS num, min(value) AS mn, max(value) AS mx FROM b GROUP BY 1),
u AS (SELECT c.*, num, mn, mx, sum(n) OVER (PARTITION BY c.event_type ORDER BY b) AS upto FROM c JOIN s USING (event_type)), p AS (SELECT unnest([CAST(1 AS DOUBLE), 25, 50, 75, 99, 100]) AS p),
h AS (SELECT *, num * (p / 100.0) AS t, row_number() OVER (PARTITION BY event_type, p ORDER BY b) AS r FROM u JOIN p ON upto >= num * (p / 100.0)),
l AS (SELECT {_LIMITS} AS l)
SELECT event_type, p, round(least(greatest((CASE WHEN b = 0 THEN 0 ELSE l[b] END) + (l[b + 1] - (CASE WHEN b = 0 THEN 0 ELSE l[b] END)) * (t - (upto - n)) / n, mn), mx), 6) AS value FROM h CROSS JOIN l WHERE r = 1""")
def latency_hist_ptile(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = histograms.log_histogram(table(spark, sf_dir, "events"), "value", ["event_type"])
    return histograms.histogram_percentile(hist, [1, 25, 50, 75, 99, 100], ["event_type"]).select("event_type", "p", F.round("value", 6).alias("value"))


# sources


def _year_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("ts"), F.pmod("l_suppkey", F.lit(RANKS)).cast("int").alias("rank"), F.col("l_extendedprice").cast("float").alias("key"))


_TRACE = "t AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS ts, CAST(l_suppkey % 8 AS INTEGER) AS \"rank\", CAST(l_extendedprice AS FLOAT) AS key FROM lineitem)"


@query(f"WITH {_TRACE}, e AS (SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS epoch FROM (SELECT DISTINCT ts FROM t)) SELECT ts, epoch, count(*) AS n, max(\"rank\") + 1 AS n_ranks FROM t JOIN e USING (ts) GROUP BY 1, 2")
def trace_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _year_traces(spark, sf_dir)
    return traces.with_epochs(rows).groupBy("ts", "epoch").agg(F.count("*").alias("n")).join(traces.rank_counts(rows), "ts")


@query(f"WITH {_TRACE} SELECT CAST(r AS INTEGER) AS \"rank\", count(*) AS n, round(max(key), 2) AS most FROM t JOIN (SELECT unnest(range(20)) AS r) ON \"rank\" = r % 8 GROUP BY 1")
def trace_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.scaled_ranks(_year_traces(spark, sf_dir), 20, RANKS).groupBy("rank").agg(F.count("*").alias("n"), F.round(F.max("key"), 2).alias("most"))


@query(f"WITH {_TRACE}, m AS (SELECT * FROM (VALUES (1995, 3), (1997, 2), (1999, 0)) m(ts, times)), r AS (SELECT t.*, unnest(range(coalesce(times, 1))) AS dump FROM t LEFT JOIN m USING (ts)) SELECT ts, CAST(dump AS INTEGER) AS dump, count(*) AS n FROM r GROUP BY 1, 2")
def trace_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.replayed(_year_traces(spark, sf_dir), "1995:3,1997:2,1999:0").groupBy("ts", "dump").agg(F.count("*").alias("n"))


@query("SELECT CAST(d + 1 AS INTEGER) AS epoch, CAST(r AS INTEGER) AS \"rank\", s AS seq, CAST(d * 2 + r AS FLOAT) AS key, base64(unhex(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2))) AS name FROM (SELECT d, r, s, printf('%016x', (CAST(r AS BIGINT) << 28) | s) AS h FROM (SELECT unnest(range(2)) AS d), (SELECT unnest(range(8)) AS r), (SELECT unnest(range(500)) AS s))")
def simulated_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.simulate(spark, 2, RANKS, 500).select("epoch", "rank", "seq", "key", "name")


@query()
def generated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.generate_keys(spark, [1.0, 2.0], 0.0, 50.0, 8000, "random", RANKS, 7)


@query("SELECT CAST(r AS INTEGER) AS \"rank\", s AS seq, CAST(CASE WHEN s < 333 THEN 0 ELSE 1 END AS INTEGER) AS bin, true AS within FROM (SELECT unnest(range(8)) AS r), (SELECT unnest(range(1000)) AS s)")
def generated_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = generate.generate_keys(spark, [1.0, 2.0], 0.0, 50.0, 8000, "sequential", RANKS, 7)
    return keys.select("rank", "seq", "bin", F.col("key").between(F.col("bin") * 25, F.col("bin") * 25 + 25).alias("within"))


@query("SELECT CAST(r AS INTEGER) AS \"rank\", CAST(b AS INTEGER) AS bin, CAST(b AS FLOAT) AS key, CAST(CASE b WHEN 0 THEN 333 ELSE 667 END AS BIGINT) AS n FROM (SELECT unnest(range(8)) AS r), (SELECT unnest(range(2)) AS b)")
def generated_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.generate_keys(spark, [1.0, 2.0], 0.0, 50.0, 8000, "shuffle_skew", RANKS, 7).groupBy("rank", "bin", "key").agg(F.count("*").alias("n"))


# streaming


def _adaptive(spark: SparkSession, sf_dir: str, policy, cuts: tuple[float, ...] = ()) -> DataFrame:
    """The epochs in order, each cut into batches by arrival (orders' keys) at the given shares of the whole."""
    path = f"{shared_dir(spark)}/adaptive/{uuid.uuid4().hex}"
    own = AdaptivePartitioner(spark, path, RANKS, policy, (32, 32, 32))
    line = line_particles(spark, sf_dir)
    low, high = line.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    part = sum((F.when(F.col("l_orderkey") > low + c * (high - low), 1).otherwise(0) for c in cuts), F.lit(0)) if low is not None else F.lit(0)
    cut = line.select("epoch", "rank", "key", "name", part.alias("part"))
    for batch, r in enumerate(cut.select("epoch", "part").distinct().orderBy("epoch", "part").collect()):
        own.process(cut.filter((F.col("epoch") == r["epoch"]) & (F.col("part") == r["part"])).drop("part"), batch)
    own.finish()
    loads = balance.load_stddev(placement.destination_counts(own.assigned(), RANKS, ["epoch"]), ["epoch"])
    kept = own.assigned().groupBy("epoch").agg(F.count("*").alias("n"), (F.min("dest").between(0, RANKS - 1) & F.max("dest").between(0, RANKS - 1)).alias("placed"))
    return kept.join(loads, "epoch").select("epoch", "n", "placed", ((F.col("load_std") < 0.5) | (F.col("n") < 512 * RANKS)).alias("balanced"))


#: Nothing is lost, every record has a rank, and the ranks are even where the records are more than the buffers hold: else no bins are made.
_ADAPTED = f"WITH {LINE_SQL} SELECT epoch, count(*) AS n, true AS placed, true AS balanced FROM line GROUP BY epoch"


@query(_ADAPTED)
def adaptive_intra_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptive(spark, sf_dir, IntraEpochPolicy(500_000, 512), (0.02, 0.3))


@query(_ADAPTED)
def adaptive_inter_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptive(spark, sf_dir, InterEpochPolicy(100, 512))
