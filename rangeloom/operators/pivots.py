"""Pivots: the edges between equal weights of keys, from records, from buffered samples, and from histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.config import materialize
from rangeloom.functions import kernels
from rangeloom.functions.edges import bin_index, bin_index_of, out_of_bounds
from rangeloom.functions.scalar import next_float32
from rangeloom.operators import radix

PIVOTS = "pivots array<double>, weight double"
#: Up to so many groups their edges are broadcast to the records; beyond that they are joined by a shuffle.
MAX_BROADCAST_GROUPS = 100_000
#: Up to so many keys outside its bins come to a group's row.
MAX_KEYS = 200_000


def _schema(df: DataFrame, by: Sequence[str], rest: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), rest])


def quantile_edges(df: DataFrame, key: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """``n`` exact quantiles of the keys at 0, 1/(n-1), ..., 1, by group: by, k, pivot. Null and NaN keys do not count.

    Keys are found by radix selection, so no group's keys come to one place; ``df`` is read once for 16 bits of the key.
    Between two keys the value is interpolated.
    """
    width = 32 if df.schema[key].dataType.simpleString() == "float" else 64
    clean = df.filter(F.col(key).isNotNull() & ~F.isnan(key))
    codes = clean.select(*by, radix.encode(F.col(key), width).alias("code"))
    at = lambda k, of: (F.col(of) - 1) * F.lit(k / (n - 1))
    target = lambda k, low: F.struct(F.lit(2 * k + (not low)).alias("p"), ((F.floor if low else F.ceil)(at(k, "_all")) + 1).cast("bigint").alias("rank"))
    found = radix.select(codes, by, width, F.array(*[target(k, low) for k in range(n) for low in (True, False)]))
    values = found.select(*by, "p", "n_all", radix.decode(F.col("digit"), width).alias("x"))
    pairs = values.groupBy(*by, F.shiftright("p", 1).alias("k")).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.max("n_all").alias("_all"))
    place = (F.col("_all") - 1) * (F.col("k") / F.lit(n - 1))
    return pairs.select(*by, "k", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("pivot"))


def approximate_edges(df: DataFrame, key: str, n: int, by: Sequence[str] = (), accuracy: int = 100_000) -> DataFrame:
    """As ``quantile_edges``, in bounded memory: each pivot's rank is off by at most 1/accuracy of the records."""
    clean = df.filter(F.col(key).isNotNull() & ~F.isnan(key))
    probs = [k / (n - 1) for k in range(n)]
    return clean.groupBy(*by).agg(F.percentile_approx(F.col(key).cast("double"), probs, accuracy).alias("p")).select(*by, F.posexplode("p").alias("k", "pivot"))


def closed_edges(pivots: Sequence[float]) -> list[float]:
    """Pivots as edges whose last is just above the largest key, so that the bins hold all keys."""
    return [*pivots[:-1], next_float32(pivots[-1])]


def first_records(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``n`` records of each group in an order. Spark keeps no more than n a group before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def pivots_from_keys(df: DataFrame, key: str, n: int, by: Sequence[str]) -> DataFrame:
    """Pivots of each group's keys, repeats within 1e-7 counting once: by, pivots, weight.

    For buffered samples: a group's keys come to one task. A group without usable keys gets zeros and weight 0.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        pivots, weight = kernels.combined_pivots(frame["_key"].to_numpy(np.float32), None, None, n)
        return frame[list(by)].head(1).assign(pivots=[pivots.tolist()], weight=[weight])

    keyed = df.select(*by, F.col(key).cast("float").alias("_key"))
    return keyed.groupBy(*by).applyInPandas(one, _schema(keyed, by, PIVOTS))


def first_pivots(df: DataFrame, key: str, n: int, sample: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pivots of the first ``sample`` records of each group: by, pivots, weight."""
    return pivots_from_keys(first_records(df.select(*dict.fromkeys([*by, *order, key])), sample, by, order), key, n, by)


def combined_pivots(bins: DataFrame, outside: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Pivots over bins (by, edges, weights) and the keys outside them (by, key), which may be many: by, pivots, weight.

    Keys inside a group's bins count for nothing; without bins all keys are on the left. Repeats within 1e-7 count once.
    Groups may be missing on either side; ``bins`` is one row a group. Where no group has more than MAX_KEYS of them, the
    keys of a group come to its row. Else they stay spread over blocks of at most 65,536, and only those next to a pivot come
    to the row; the result is the same. ``outside`` is read twice, so it should be a table.
    """
    known = bins.select(*by, "edges", "weights")
    most = outside.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= MAX_KEYS:
        return _combined_rows(known, outside.groupBy(*by).agg(F.collect_set("key").alias("keys")), n, by)
    ends = F.broadcast(known.select(*by, F.element_at("edges", 1).cast("float").alias("_lo"), F.element_at("edges", -1).cast("float").alias("_hi")))
    side = F.when(F.col("_lo").isNull() | (F.col("key") < F.col("_lo")), 0).when(F.col("key") >= F.col("_hi"), 2)
    sided = outside.select(*by, F.col("key").cast("float").alias("key")).join(ends, list(by), "left").withColumn("_side", side).filter("_side IS NOT NULL")
    kept = _ranked(_kept(sided, "key", [*by, "_side"], kernels.SAME_KEY), [*by, "_side"])
    of = lambda i, c: F.max(F.when(F.col("_side") == i, F.col(c)))
    sides = kept.groupBy(*by, "_side").agg(F.count("*").alias("_n"), F.min("key").alias("_first"), F.max("key").alias("_last"))
    groups = sides.groupBy(*by).agg(*[of(i, c).alias(f"{c}{i}") for i in (0, 2) for c in ("_n", "_first", "_last")])
    whole = known.join(groups, list(by), "full").select(*by, "edges", "weights", *[f"{c}{i}" for i in (0, 2) for c in ("_n", "_first", "_last")])
    whole = materialize(whole)
    kinds = _schema(whole, by, "`_side` int, `_rank` bigint")

    def wanted(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                left, right = (0 if pd.isna(r[c]) else int(r[c]) for c in ("_n0", "_n2"))
                source, place = kernels.positions(left, 0.0 if r["edges"] is None else float(np.sum(r["weights"])), right, n)
                for i in (0, 2):
                    at = place[source == i]
                    out += [(*[r[c] for c in by], i, int(x)) for x in np.unique(np.concatenate([np.floor(at), np.ceil(at)]))]
            yield pd.DataFrame(out, columns=[*by, "_side", "_rank"])

    asked = whole.mapInPandas(wanted, kinds)
    # at most 2 n a group
    near = kept.join(asked, [*by, "_side", "_rank"]).groupBy(*by).agg(F.collect_list(F.struct("_side", "_rank", "key")).alias("_near"))

    def put(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                left, right = (0 if pd.isna(r[c]) else int(r[c]) for c in ("_n0", "_n2"))
                at = {0: [], 2: []}
                for x in [] if r["_near"] is None else r["_near"]:
                    at[x["_side"]].append((x["_rank"], x["key"]))
                value = lambda i, place, at=at: np.interp(place, *map(np.array, zip(*sorted(at[i]), strict=True)))
                ends = [(r["_first0"], r["_last0"]) if left else None, (r["_first2"], r["_last2"]) if right else None]
                pivots, weight = kernels.pivots_at(left, right, ends, lambda p, v=value: v(0, p), lambda p, v=value: v(2, p), r["edges"], r["weights"], n)
                rows.append((pivots.tolist(), weight))
            yield frame[list(by)].assign(pivots=[r[0] for r in rows], weight=[r[1] for r in rows])

    return whole.join(near, list(by), "left").mapInPandas(put, _schema(whole, by, PIVOTS))


def _combined_rows(bins: DataFrame, outside: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Pivots over bins (by, edges, weights) and keys (by, keys) that are one row a group each."""
    joined = bins.join(outside, list(by), "full")

    def all_groups(frames):
        for frame in frames:
            rows = []
            for edges, weights, keys in zip(frame["edges"], frame["weights"], frame["keys"], strict=True):
                some = np.array([] if keys is None else list(keys), np.float32)
                pivots, weight = kernels.combined_pivots(some, None if edges is None else list(edges), None if weights is None else list(weights), n)
                rows.append((pivots.tolist(), weight))
            yield frame[list(by)].assign(pivots=[r[0] for r in rows], weight=[r[1] for r in rows])

    return joined.select(*by, "edges", "weights", "keys").mapInPandas(all_groups, _schema(joined, by, PIVOTS))


def full_pivots(df: DataFrame, key: str, n: int, sample: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pivots of all records but each group's first ``sample``: by, pivots, weight.

    The first ones give n bins; the others fill them, and those that no bin holds are combined with them as keys. The records
    after the sample are told by the last of it, so no group is sorted; ``order`` has to be unique within a group.
    """
    first = materialize(first_records(df.select(*dict.fromkeys([*by, *order, key])), sample, by, order))
    last = first.groupBy(*by).agg(F.max(F.struct(*order)).alias("_last"))
    edges = pivots_from_keys(first, key, n + 1, by).select(*by, F.col("pivots").cast("array<float>").alias("edges"))
    heads = materialize(edges.join(last, list(by)))
    if heads.count() <= MAX_BROADCAST_GROUPS:
        heads = F.broadcast(heads)
    rest = df.select(*by, F.struct(*order).alias("_at"), F.col(key).cast("float").alias("key")).join(heads, list(by)).filter("_at > _last AND key IS NOT NULL AND NOT isnan(key)")
    rest = rest.select(*by, "key", bin_index_of(F.col("key"), F.col("edges"), n_edges=n + 1).alias("_i"))
    inside = F.col("_i").between(0, n - 1)
    # bins and the keys outside, in one pass over the records
    counts = materialize(rest.select(*by, F.when(inside, F.col("_i")).alias("_bin"), F.when(~inside, F.col("key")).alias("key")).groupBy(*by, "_bin", "key").agg(F.count("*").alias("_n")))
    filled = counts.filter("_bin IS NOT NULL").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_m"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0)).cast("double"))
    bins = heads.join(filled, list(by), "left").withColumn("weights", F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(weights))
    return combined_pivots(materialize(bins.select(*by, "edges", "weights")), counts.filter("_bin IS NULL").select(*by, "key"), n, by)


def _kept(df: DataFrame, key: str, by: Sequence[str], eps: float) -> DataFrame:
    """The distinct keys of each group without those within ``eps`` of the last one kept: by, _bucket, key.

    Keys are put into buckets by the leading half of their code, so a bucket holds at most 65,536. A key farther than
    ``eps`` from the one before it is kept whatever came before, so keys fall into runs that are independent of each other;
    one row a bucket carries them over the buckets' borders. A run of several keys is folded in one place.
    """
    clean = df.select(*by, (F.col(key).cast("float") + F.lit(0.0).cast("float")).alias("key")).filter("key IS NOT NULL AND NOT isnan(key)").distinct()
    spread = clean.withColumn("_bucket", F.shiftright(radix.encode(F.col("key"), 32), 16))
    order = Window.partitionBy(*by, "_bucket").orderBy("key")
    far = lambda a, b: (a - b).cast("double") > eps
    gap = far(F.col("key"), F.lag("key").over(order))
    next_gap = far(F.lead("key").over(order), F.col("key"))
    marked = spread.withColumns({"_gap": gap, "_next": next_gap})
    marked = materialize(marked.withColumn("_run", F.max(F.when(F.col("_gap"), F.col("key"))).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    blocks = marked.groupBy(*by, "_bucket").agg(F.min("key").alias("_first"), F.max("key").alias("_last"), F.max("_run").alias("_inner"))
    line = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_bucket")
    before = F.lag("_last").over(line)
    begun = blocks.withColumn("_begin", F.when(before.isNull() | far(F.col("_first"), before), F.col("_first")))
    carried = begun.withColumn("_carried", F.last(F.coalesce("_inner", "_begin"), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    # alone: far from the neighbours on both sides within the bucket
    alone = marked.filter("_gap AND _next").select(*by, "_bucket", "key")
    others = marked.filter("NOT coalesce(_gap AND _next, false)")
    same = [others[c].eqNullSafe(carried[c]) for c in [*by, "_bucket"]]
    runs = others.join(carried, reduce(lambda a, b: a & b, same)).select(*[others[c] for c in [*by, "_bucket"]], "key", F.coalesce("_run", "_begin", "_carried").alias("_run"))
    runs = runs.groupBy(*by, "_run").agg(F.array_sort(F.collect_list(F.struct("key", "_bucket"))).alias("_keys"))
    one = runs.filter(F.size("_keys") == 1).select(*by, F.col("_keys")[0]["_bucket"].alias("_bucket"), F.col("_keys")[0]["key"].alias("key"))

    def fold(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                keys = np.array([x["key"] for x in r["_keys"]], np.float32)
                kept = set(kernels.dedup_sorted(keys, eps).tolist())
                rows += [(*[r[c] for c in by], x["_bucket"], k) for x, k in zip(r["_keys"], keys.tolist(), strict=True) if k in kept]
            yield pd.DataFrame(rows, columns=[*by, "_bucket", "key"])

    many = runs.filter(F.size("_keys") > 1).mapInPandas(fold, _schema(marked, by, "`_bucket` bigint, `key` float"))
    return alone.unionByName(one).unionByName(many)


def _ranked(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept keys with their place in the group from 0: by, key, _rank. Buckets are numbered by themselves and then shifted."""
    kept = materialize(kept)
    line = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0))).drop("_n")
    numbered = kept.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("key")) - 1)
    return materialize(numbered.join(before, [*by, "_bucket"]).select(*by, "key", (F.col("_before") + F.col("_place")).cast("bigint").alias("_rank")))


def dedup_keys(df: DataFrame, key: str, by: Sequence[str] = (), eps: float = kernels.SAME_KEY) -> DataFrame:
    """Each group's keys without those within ``eps`` of the last one kept, in their order: by, key, one row each.

    Null and NaN are left out, both zeros are one. No group's keys come to one place; see ``_kept``.
    """
    return _kept(df, key, by, eps).select(*by, "key")


def histogram_quantiles(hist: DataFrame, n: int, by: Sequence[str] = (), order: str = "lo") -> DataFrame:
    """``n`` quantiles of a histogram (by, lo, hi, w) with its weight spread evenly in each bin: by, k, pivot.

    At the end of a bin the quantile is the bin's right edge, whatever follows. Without weight all are 0.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("w").over(group.orderBy(order, "hi").rowsBetween(Window.unboundedPreceding, 0))
    at = hist.withColumns({"_upto": upto, "_all": F.sum("w").over(group), "_first": F.min("lo").over(group), "_last": F.max("hi").over(group)})
    targets = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("_all") * (k / (n - 1))).alias("t")) for k in range(1, n - 1)])
    hit = F.filter(targets, lambda x: (x["t"] > F.col("_upto") - F.col("w")) & (x["t"] <= F.col("_upto")))
    inner = at.filter("w > 0").select(*by, F.explode(hit).alias("x"), "lo", "hi", "w", "_upto")
    inner = inner.select(*by, F.col("x.k").alias("k"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("x.t") - F.col("_upto") + F.col("w")) / F.col("w")).alias("pivot"))
    ends = at.groupBy(*by).agg(F.first("_first").alias("a"), F.first("_last").alias("b"), F.first("_all").alias("w"))
    none = F.col("w") <= 0
    two = F.when(none, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), F.lit(0.0).alias("pivot")))).otherwise(
        F.array(F.struct(F.lit(0).alias("k"), F.col("a").alias("pivot")), F.struct(F.lit(n - 1).alias("k"), F.col("b").alias("pivot")))
    )
    outer = ends.select(*by, F.explode(two).alias("x")).select(*by, "x.k", "x.pivot")
    return inner.unionByName(outer)


def bins_from_arrays(spark, edges: Sequence[float], weights: Sequence[float] | None = None) -> DataFrame:
    """A histogram's rows: bin, lo, hi, w. Weights are 0 where none are given."""
    weights = [0.0] * (len(edges) - 1) if weights is None else weights
    if len(edges) != len(weights) + 1:
        raise ValueError("one edge more than weights")
    rows = [(i, float(a), float(b), float(w)) for i, (a, b, w) in enumerate(zip(edges, edges[1:], weights, strict=False))]
    return spark.createDataFrame(rows, "bin int, lo double, hi double, w double")


def fill_bins(bins: DataFrame, df: DataFrame, key: str, edges: Sequence[float]) -> DataFrame:
    """A histogram's rows with the records that its bins hold added to their weights."""
    inside = df.filter(~out_of_bounds(F.col(key), edges))
    counts = inside.groupBy(bin_index(F.col(key), edges).alias("bin")).agg(F.count("*").alias("_n"))
    return bins.join(F.broadcast(counts), "bin", "left").select("bin", "lo", "hi", (F.col("w") + F.coalesce("_n", F.lit(0))).alias("w"))


def calc_pivots(df: DataFrame, key: str, edges: Sequence[float], weights: Sequence[float], n: int) -> DataFrame:
    """Pivots over given bins and records, one row: pivots, weight. Records in bounds add to the bins, the others count as keys.

    However many keys are out of bounds, they stay where they are; see ``combined_pivots``.
    """
    filled = fill_bins(bins_from_arrays(df.sparkSession, edges, weights), df, key, edges)
    sorted_bins = filled.agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("b"))
    bins = sorted_bins.select(F.lit(0).alias("_one"), F.array(*[F.lit(float(e)) for e in edges]).alias("edges"), F.transform("b", lambda x: x["w"]).alias("weights"))
    outside = df.filter(out_of_bounds(F.col(key), edges)).select(F.lit(0).alias("_one"), F.col(key).cast("float").alias("key"))
    return combined_pivots(bins, materialize(outside.distinct()), n, ["_one"]).select("pivots", "weight")


def pivot_union(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One histogram from the chunks (by, lo, hi, w) of several pivot sets: by, lo, hi, w.

    Every elementary interval gets the share of each chunk that lies in it; gaps get 0, chunks without width drop out.
    A sweep over the edges by windows: no join, however many chunks overlap.
    """
    solid = chunks.filter("hi > lo").withColumn("_d", F.col("w") / (F.col("hi") - F.col("lo")))
    ends = solid.select(*by, F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("_d").alias("d"), F.lit(1).alias("c")), F.struct(F.col("hi").alias("x"), (-F.col("_d")).alias("d"), F.lit(-1).alias("c")))).alias("e"))
    edges = ends.groupBy(*by, "e.x").agg(F.sum("e.d").alias("_d"), F.sum("e.c").alias("_c"))
    group = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("x")
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    swept = edges.withColumns({"_dens": F.sum("_d").over(upto), "_open": F.sum("_c").over(upto), "hi": F.lead("x").over(group)}).filter("hi IS NOT NULL")
    return swept.select(*by, F.col("x").alias("lo"), "hi", F.when(F.col("_open") > 0, F.greatest(F.col("_dens"), F.lit(0.0)) * (F.col("hi") - F.col("x"))).otherwise(0.0).alias("w"))


def chunks_of(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The chunks of pivot sets (by, pivots, weight): by, lo, hi, w."""
    pairs = F.zip_with(F.slice("pivots", F.lit(1), F.size("pivots") - 1), F.slice("pivots", F.lit(2), F.size("pivots") - 1), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    return sets.filter(F.size("pivots") > 1).select(*by, F.explode(pairs).alias("c"), F.col("weight").alias("w")).select(*by, "c.lo", "c.hi", "w")


def resample(sets: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """``n`` pivots of equal weight over the union of each group's pivot sets (by, pivots, weight): by, pivots, weight."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        pivots, weight = kernels.resample([(np.array(p, np.float64), w) for p, w in zip(frame["pivots"], frame["weight"], strict=True)], n)
        return frame[list(by)].head(1).assign(pivots=[pivots.tolist()], weight=[weight])

    return sets.select(*by, "pivots", "weight").groupBy(*by).applyInPandas(one, _schema(sets, by, PIVOTS))


def tree_pivots(sets: DataFrame, ranks: int, counts: Sequence[int], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The ranks + 1 pivots that a three-stage tree makes of the pivot sets of all ranks: by, pivots, weight.

    Ranks next to each other are merged first; each stage unites the sets of a group and takes pivots of equal weight
    of the union. A task sees one group's sets, never all ranks'. Missing ranks weigh nothing.
    """
    f1, f2, _ = kernels.tree_fanout(ranks)
    stage = sets.select(*by, F.col(rank).cast("int").alias("_node"), "pivots", "weight")
    for fan, n in ((f1, counts[0]), (f2, counts[1]), (ranks, ranks + 1)):
        stage = resample(stage.withColumn("_node", F.floor(F.col("_node") / fan).cast("int")), n, [*by, "_node"])
    return stage.drop("_node")


def widened(old: Column, new: Column, eps: float = 1e-3) -> Column:
    """Whether new pivots reach at least as far as the old ones on both sides, as they must within an epoch."""
    ends = [(F.element_at(new, 1) <= F.element_at(old, 1) + eps), (F.element_at(new, -1) >= F.element_at(old, -1) - eps)]
    return F.when(old.isNull(), True).otherwise(reduce(lambda a, b: a & b, ends))
