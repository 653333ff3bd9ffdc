"""Mixing sources to target shares of the total size, over output shards.

Every source's documents are spread over blocks of about BLOCK_TOKENS tokens by a hash. A source is used in whole rounds as
often as its budget allows, and then as a prefix of its blocks in a permuted order. From the block that is cut on, documents
are taken in order where they still fit, so that a large one doesn't end it. In
each round the blocks are permuted by a bijection of their numbers, so nothing has to be sorted. The blocks are dealt to the
shards by a splitting tree: the shards are halved again and again, and how many blocks of each source go to the left half
is drawn from the multivariate hypergeometric distribution, so that every shard gets an exact, random quota of each
source's blocks, as if all blocks had been shuffled. Each node draws by a seed of its own; TOP_NODES of the tree are made on
the driver, everything below them in Spark. Within a shard documents are ordered by a seeded hash. The driver sees sums by source, of
the block that is cut its neighbours, and the sizes of the documents that may fill it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.config import materialize
from rangeloom.llm.tokens import VOCABULARY, token_sizes

#: About so many tokens are in a block.
BLOCK_TOKENS = 16_384
#: About so many tokens go to an output shard, and there are at least so many shards.
SHARD_TOKENS, LEAST_SHARDS = 4_000_000, 8
#: So many nodes of the splitting tree are made on the driver.
TOP_NODES = 512
#: Blocks are summed by so many in a row, to find the one that is cut.
CHUNK = 1024
#: A plan of at most so many blocks is broadcast to the documents; beyond that they are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 200_000
#: What is left of a budget is filled from so many blocks first, then from FILL_GROWTH times as many, until it is full or none are left.
FILL_BLOCKS, FILL_GROWTH = 16, 4
SEED = 42


def budgets(totals: Mapping[str, int], targets: Mapping[str, tuple[float, int]]) -> dict[str, int]:
    """The tokens that each source gives: the largest total for which all shares are met within the repeats allowed.

    Shares of 0 want nothing. A wanted source that has no tokens gives none, and the others keep their shares relative to
    each other; ``shares`` reports what each reached.
    """
    wanted = {s: t for s, t in targets.items() if t[0] > 0}
    there = {s: t for s, t in wanted.items() if totals.get(s, 0) > 0 and t[1] > 0}
    out = dict.fromkeys(wanted, 0)
    if there:
        all_shares = sum(share for share, _ in there.values())
        total = min(totals[s] * repeats / (share / all_shares) for s, (share, repeats) in there.items())
        out |= {s: min(int(total * share / all_shares + 1e-9), totals[s] * repeats) for s, (share, repeats) in there.items()}
    return out


Node = tuple[int, int, tuple[int, ...], tuple[int, ...]]


def halves(node: Node, seed: int) -> list[Node]:
    """The two halves of a node (first shard, shard after the last, where each source's blocks begin, how many there are)."""
    low, high, starts, quotas = node
    mid = (low + high) // 2
    q = np.array(quotas, np.int64)
    n = int(q.sum()) * (mid - low) // (high - low)
    left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(q, n, method="marginals") if n else np.zeros_like(q)
    between = tuple((np.array(starts, np.int64) + left).tolist())
    return [(low, mid, starts, tuple(left.tolist())), (mid, high, between, tuple((q - left).tolist()))]


def leaves(node: Node, seed: int) -> Iterator[Node]:
    """The shards below a node, in order."""
    todo = [node]
    while todo:
        top = todo.pop()
        if top[1] - top[0] == 1:
            yield top
        else:
            todo += reversed(halves(top, seed))


def deal(spark, names: list[str], quotas: list[int], shards: int, seed: int) -> DataFrame:
    """The blocks of each source for each shard: shard, source, start, n. All of each source's blocks are given away, and
    shards get equal numbers of blocks up to the tree's rounding, at most one a level.
    """
    nodes: list[Node] = [(0, shards, (0,) * len(names), tuple(quotas))]
    while len(nodes) < TOP_NODES and any(n[1] - n[0] > 1 for n in nodes):
        nodes = [half for n in nodes for half in (halves(n, seed) if n[1] - n[0] > 1 else [n])]
    top = spark.createDataFrame([(a, b, list(starts), list(q)) for a, b, starts, q in nodes], "low bigint, high bigint, starts array<bigint>, quotas array<bigint>")

    def below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                done = list(leaves((r.low, r.high, tuple(int(x) for x in r.starts), tuple(int(x) for x in r.quotas)), seed))
                shard, source = np.repeat([d[0] for d in done], len(names)), names * len(done)
                yield pd.DataFrame({"shard": shard, "source": source, "start": [x for d in done for x in d[2]], "n": [x for d in done for x in d[3]]})

    return top.repartition(max(1, min(len(nodes), spark.sparkContext.defaultParallelism))).mapInPandas(below, "shard bigint, source string, start bigint, n bigint").filter("n > 0")


def _permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """Factor and shift of a bijection of 0..n-1."""
    factor = int(rng.integers(1, n + 1))
    while math.gcd(factor, n) != 1:
        factor = int(rng.integers(1, n + 1))
    return factor, int(rng.integers(0, n))


def _cuts(parts: DataFrame, rest: Mapping[str, int]) -> dict[str, tuple[int, int]]:
    """Of each source's last round (source, at, held) the place of the block that is cut and the tokens that it may give."""
    chunks = parts.groupBy("source", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.sum("held").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    want = F.element_at(F.create_map(*[x for s, r in rest.items() for x in (F.lit(s), F.lit(r))]), F.col("source"))
    hit = chunks.withColumn("upto", upto).filter((F.col("upto") >= want) & (F.col("upto") - F.col("held") < want))
    out = {}
    for c in hit.collect():  # one row a source
        done = c["upto"] - c["held"]
        near = parts.filter((F.col("source") == c["source"]) & (F.floor(F.col("at") / CHUNK) == c["chunk"])).select("at", "held").orderBy("at").collect()
        for at, held in near:  # at most CHUNK
            if done + held >= rest[c["source"]]:
                out[c["source"]] = (at, rest[c["source"]] - done)
                break
            done += held
    return out


def _filled(tail: DataFrame, cuts: Mapping[str, tuple[int, int]], blocks: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """The documents (source, doc_id, tokens) of the tail (with at, order) that are taken from the blocks that are cut on.

    They are taken in order where they fit into what may still be given. What then is left is smaller than any document
    left; the smallest of those is taken where that comes closer. What is looked at shrinks with what is left, as larger documents are left out.
    """
    left, low = {s: allowed for s, (_, allowed) in cuts.items()}, {s: at for s, (at, _) in cuts.items()}
    of = lambda numbers: F.element_at(F.create_map(*[x for s in cuts for x in (F.lit(s), F.lit(numbers[s]).cast("bigint"))]), F.col("source"))
    chosen: list[tuple[str, int, int]] = []
    width = FILL_BLOCKS
    while any(left[s] > 0 and low[s] < blocks[s] for s in cuts):
        near = tail.filter((F.col("at") >= of(low)) & (F.col("at") < of(low) + width) & (F.col("tokens") <= of(left)))
        for r in sorted(near.collect(), key=lambda r: (r["at"], r["order"], r["doc_id"])):
            if r["tokens"] <= left[r["source"]]:
                left[r["source"]] -= r["tokens"]
                chosen.append((r["source"], r["doc_id"], r["tokens"]))
        low, width = {s: at + width for s, at in low.items()}, width * FILL_GROWTH
    if any(left.values()):
        taken = F.broadcast(tail.sparkSession.createDataFrame(chosen, "source string, doc_id bigint, tokens bigint"))
        least = F.min(F.struct("tokens", "order", "doc_id")).alias("d")
        # all that fit are taken, so none left is smaller
        for r in tail.filter((F.col("at") >= of({s: at for s, (at, _) in cuts.items()})) & (F.col("tokens") > of(left)) & (F.col("tokens") < 2 * of(left))).join(taken, ["source", "doc_id"], "left_anti").groupBy("source").agg(least).collect():
            chosen.append((r["source"], r["d"]["doc_id"], r["d"]["tokens"]))
    return chosen


def mix_documents(sizes: DataFrame, mix_target: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """The mixture of (doc_id, source, tokens): shard, place, doc_id, source, copy_no, tokens.

    - Each source gives its target share of the total tokens, to within one document; none is used more than max_repeats
      times, and a document is used again only after all of its source have been used equally often.
    - Documents with a null source or one without a target, without a doc_id, or of 0 tokens are not used. A doc_id that
      comes several times counts once, by one of its rows.
    - Where a wanted source has no tokens the others are mixed by their shares relative to each other. Targets with a null
      source, share or limit want nothing.
    """
    spark = sizes.sparkSession
    empty = spark.createDataFrame([], "shard int, place int, doc_id bigint, source string, copy_no int, tokens bigint")
    first = F.min(F.struct("source", "tokens")).alias("d")
    once = sizes.filter("doc_id IS NOT NULL AND source IS NOT NULL AND tokens > 0").groupBy("doc_id").agg(first).select("doc_id", "d.source", "d.tokens")
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in mix_target.dropna().collect()}
    held = materialize(once.filter(F.col("source").isin(list(targets))))
    totals = {r["source"]: r["tokens"] for r in held.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    given = budgets(totals, targets)
    names = sorted(s for s, b in given.items() if b > 0)
    if not names:
        return empty
    rng = np.random.default_rng(seed)
    blocks = {s: -(-totals[s] // block_tokens) for s in names}
    rounds, rest = {s: given[s] // totals[s] for s in names}, {s: given[s] % totals[s] for s in names}
    of = lambda numbers: F.element_at(F.create_map(*[x for s in names for x in (F.lit(s), F.lit(numbers[s]).cast("bigint"))]), F.col("source"))
    placed = held.filter(F.col("source").isin(names)).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), of(blocks)))
    sums = materialize(placed.groupBy("source", "block").agg(F.sum("tokens").alias("held")))
    # a row for each source and round
    plan = [(s, c, *_permutation(blocks[s], rng), blocks[s], c * blocks[s], c == rounds[s]) for s in names for c in range(rounds[s] + (rest[s] > 0))]
    each = F.broadcast(spark.createDataFrame(plan, "source string, copy_no int, factor bigint, shift bigint, blocks bigint, base bigint, partly boolean"))
    drawn = sums.join(each, "source").withColumn("at", F.pmod(F.col("factor") * F.col("block") + F.col("shift"), F.col("blocks")))
    cuts = _cuts(drawn.filter("partly"), {s: r for s, r in rest.items() if r > 0}) if any(rest.values()) else {}
    last = of({s: cuts[s][0] if s in cuts else -1 for s in names})
    used = drawn.filter(~F.col("partly") | (F.col("at") <= last))
    used = used.select("source", "block", "copy_no", (F.col("base") + F.col("at")).alias("pos"), (F.col("partly") & (F.col("at") == last)).alias("cut"))
    quotas = [rounds[s] * blocks[s] + (cuts[s][0] + 1 if s in cuts else 0) for s in names]
    shards = min(max(LEAST_SHARDS, round(sum(given.values()) / shard_tokens)), sum(quotas))
    dealt = deal(spark, names, quotas, shards, seed).select("shard", "source", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos"))
    to_shards = materialize(used.join(dealt, ["source", "pos"]).select("source", "block", "copy_no", "cut", F.col("shard").cast("int").alias("shard")))
    whole = to_shards.filter("NOT cut")
    chosen = placed.join(F.broadcast(whole) if sum(quotas) <= MAX_BROADCAST_BLOCKS else whole, ["source", "block"])
    if cuts:
        order = F.xxhash64(F.lit(seed), "copy_no", "doc_id").alias("order")
        at = F.pmod(F.col("factor") * F.col("block") + F.col("shift"), F.col("blocks")).alias("at")
        filled = _filled(placed.join(each.filter("partly"), "source").select("source", "doc_id", "tokens", at, order), cuts, blocks)
        # they go where the block that is cut goes, a row a source
        cut = spark.createDataFrame(filled, "source string, doc_id bigint, tokens bigint").join(F.broadcast(to_shards.filter("cut")), "source")
        chosen = chosen.unionByName(cut.select(chosen.columns))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "copy_no", "doc_id"), "doc_id", "copy_no"))
    return chosen.select("shard", (place - 1).alias("place"), "doc_id", "source", "copy_no", "tokens")


def mixed(documents: DataFrame, mix_target: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return mix_documents(token_sizes(documents, ("doc_id", "source"), vocabulary), mix_target)


def shares(mixture: DataFrame, mix_target: DataFrame) -> DataFrame:
    """What was reached: source, target_share, max_repeats, n_uses, n_documents, most_uses, tokens, share."""
    uses = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    by = uses.groupBy("source").agg(F.sum("uses").alias("n_uses"), F.count("*").alias("n_documents"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    zero = {c: 0 for c in ("n_uses", "n_documents", "most_uses", "tokens")}
    rows = mix_target.join(F.broadcast(by), "source", "left").fillna(zero)
    return rows.select("source", "target_share", "max_repeats", "n_uses", "n_documents", "most_uses", "tokens", F.coalesce(F.col("tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("share"))


def mixture_faults(mixture: DataFrame, sizes: DataFrame, mix_target: DataFrame) -> DataFrame:
    """How often a mixture breaks what must hold, all 0 in a right one: fault, n.

    ``repeats``: documents used more often than allowed. ``uneven``: sources of which a document was used two times more
    than another. ``twice``: copies of a document that were given twice. ``shares``: sources whose tokens are more than two of their
    largest documents away from their share. ``places``: shards whose places aren't numbered on. ``foreign``: documents without a target.
    """
    target = F.broadcast(mix_target.dropna())
    uses = materialize(mixture.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.count_distinct("copy_no").alias("copies"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest")))
    known = sizes.filter("doc_id IS NOT NULL AND source IS NOT NULL AND tokens > 0").select("source", "doc_id").distinct().join(target.select("source"), "source")
    every = known.join(uses, ["source", "doc_id"], "left").fillna(0, ["uses"])
    by = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("largest").alias("largest"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    shared = target.join(by, "source").withColumn("off", F.abs(F.col("tokens") - F.col("target_share") * total))
    numbered = mixture.groupBy("shard").agg(F.count("*").alias("n"), F.min("place").alias("a"), F.max("place").alias("b"))
    found = {
        "repeats": uses.join(target, "source").filter("uses > max_repeats"),
        "uneven": every.groupBy("source").agg((F.max("uses") - F.min("uses")).alias("d")).filter("d > 1"),
        "twice": uses.filter("uses <> copies"),
        "shares": shared.filter("off > 2 * largest"),
        "places": numbered.filter("a <> 0 OR b <> n - 1"),
        "foreign": uses.join(target, "source", "left_anti"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(fault).alias("fault"), "n") for fault, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


FAULTS_SQL = "SELECT unnest(['repeats', 'uneven', 'twice', 'shares', 'places', 'foreign']) AS fault, CAST(0 AS BIGINT) AS n"
