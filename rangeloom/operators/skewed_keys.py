"""Per-key results when a few keys hold most records.

Keys are never shuffled row by row. Every input split turns its rows into dense accumulator arrays (``numpy.bincount``
over dictionary codes), and only array blocks travel: they are summed by a reduction tree whose groups have a
bounded number of blocks. A task's work thus depends on the size of its split, not on how often a key occurs.

Whole-number keys (ranks) are coded by ranges of BLOCK keys: a block's number and a place in its array, so a dictionary
of any size needs no broadcast. Where only heavy keys are wanted (also floats), the dictionary is built by halves:
the high 16 bits of an order-preserving code are counted first, and only the high halves that can hold a heavy key get
a dense array for the low 16 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.config import materialize

BLOCK = 512
HALF = 1 << 16
#: A block of keys in which fewer are used is handed on key by key instead of as arrays.
THIN = 32
#: So many blocks, of 4 KB each, are summed in one group of the reduction tree.
FAN_IN = 256
#: So many bytes of accumulator arrays are held by a task before it hands on their blocks.
MAX_BYTES = 64 << 20

_BLOCKS = "grp bigint, block int, part int, counts array<bigint>"


def float_code(x: np.ndarray) -> np.ndarray:
    """32-bit floats as unsigned integers in the same order; both zeros get one code. NaN is the caller's business."""
    bits = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31))


def float_of(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.uint32)
    return np.where(code >> 31 == 1, code & np.uint32((1 << 31) - 1), ~code).astype(np.uint32).view(np.float32)


def int_code(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) + (1 << 31)).astype(np.uint32)


def int_of(code: np.ndarray) -> np.ndarray:
    return code.astype(np.int64) - (1 << 31)


class _Dense:
    """Accumulator arrays by group, made of blocks of BLOCK slots that exist where anything was counted; ``take`` hands them on."""

    def __init__(self, width: int) -> None:
        self.width, self.at, self.blocks, self.used = width, {}, np.zeros((64, BLOCK), np.int64), 0

    def add(self, group: np.ndarray, code: np.ndarray, value: np.ndarray | None = None) -> None:
        """Scatter values (1 each, where none are given) into the arrays of their groups."""
        if not len(code):
            return
        per = -(-self.width // BLOCK)
        number = group.astype(np.int64) * per + (code.astype(np.int64) // BLOCK)
        known, inverse = np.unique(number, return_inverse=True)
        places = np.array([self._place(n) for n in known.tolist()])
        slot = inverse * BLOCK + code.astype(np.int64) % BLOCK
        if value is None:
            counts = np.bincount(slot, minlength=len(known) * BLOCK)
        else:
            counts = np.zeros(len(known) * BLOCK, np.int64)
            np.add.at(counts, slot, value)
        self.blocks[places] += counts.reshape(-1, BLOCK)

    def _place(self, number: int) -> int:
        if number not in self.at:
            if self.used == len(self.blocks):
                self.blocks = np.concatenate([self.blocks, np.zeros_like(self.blocks)])
            self.at[number] = self.used
            self.used += 1
        return self.at[number]

    def take(self, least_bytes: int = -1) -> Iterator[pa.RecordBatch]:
        """The blocks that hold anything, if the arrays take more than ``least_bytes``; they are empty afterwards."""
        if self.used * BLOCK * 8 <= least_bytes or not self.used:
            return
        part, per = TaskContext.get().partitionId(), -(-self.width // BLOCK)
        numbers = np.fromiter(self.at, np.int64, len(self.at))
        kept = np.flatnonzero(self.blocks[: self.used].any(axis=1))
        for i in range(0, len(kept), FAN_IN):
            some = kept[i : i + FAN_IN]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers[some] // per, pa.int64()),
                    pa.array(numbers[some] % per, pa.int32()),
                    pa.array(np.full(len(some), part), pa.int32()),
                    pa.ListArray.from_arrays(np.arange(0, (len(some) + 1) * BLOCK, BLOCK, dtype=np.int32), self.blocks[some].ravel()),
                ],
                ["grp", "block", "part", "counts"],
            )
        self.at, self.blocks, self.used = {}, np.zeros((64, BLOCK), np.int64), 0


def _sum_block(table: pa.Table) -> pa.Table:
    counts = table.column("counts").combine_chunks()
    total = counts.flatten().to_numpy().reshape(-1, BLOCK).sum(axis=0)
    return pa.table(
        {
            "grp": table.column("grp").slice(0, 1),
            "block": table.column("block").slice(0, 1),
            "part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int32()),
            "counts": pa.array([total], pa.list_(pa.int64())),
        }
    )


def sum_blocks(blocks: DataFrame) -> DataFrame:
    """Array blocks added up over the splits, by a tree of two levels: grp, block, counts."""
    for _ in range(2):
        branch = F.floor(F.col("part") / FAN_IN) if _ == 0 else F.lit(0)
        blocks = blocks.groupBy("grp", "block", branch.alias("branch")).applyInArrow(_sum_block, _BLOCKS)
    return blocks.select("grp", "block", "counts")


def _entries(blocks: DataFrame) -> DataFrame:
    at = blocks.select("grp", "block", F.posexplode("counts").alias("slot", "n")).filter(F.col("n") > 0)
    return at.select("grp", (F.col("block") * BLOCK + F.col("slot")).alias("code"), "n")


def heavy_keys(df: DataFrame, group_col: str, int_cols: list[str], float_cols: list[str], share: float = 0.05) -> DataFrame:
    """The keys that hold at least ``share`` of the rows of their group: grp, field, code, n, total.

    ``field`` is the column's name, ``code`` an unsigned 32-bit code in the order of the keys (``int_of``, ``float_of``).
    All stored rows count in a group's total, repeated rows and null keys included. Null, NaN and infinite keys are
    never heavy; the two zeros are one key. Rows with a null group are a group of their own, given as null.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    fields = [*int_cols, *float_cols]
    rows = df.select(F.col(f"`{group_col}`").cast("bigint").alias("g"), *[F.col(f"`{c}`").cast("int" if c in int_cols else "float").alias(f"f{i}") for i, c in enumerate(fields)])
    totals = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}  # one row a group
    empty = df.sparkSession.createDataFrame([], "grp bigint, field string, code bigint, n bigint, total bigint")
    if not totals:
        return empty
    groups = sorted(totals, key=lambda g: (g is None, g))
    place = {g: i for i, g in enumerate(groups)}
    known = np.array([g for g in groups if g is not None], np.int64)
    n_ints, n_fields = len(int_cols), len(fields)

    def coded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each field: the place of (group, field) and the code, of the rows that have a key."""
        g = batch.column(0)
        at = np.searchsorted(known, g.fill_null(0).to_numpy(zero_copy_only=False))
        at = np.where(g.is_null().to_numpy(zero_copy_only=False), len(known), at)
        for i in range(n_fields):
            c = batch.column(1 + i)
            ok = ~c.is_null().to_numpy(zero_copy_only=False)
            x = c.fill_null(0).to_numpy(zero_copy_only=False)
            if i >= n_ints:
                ok &= np.isfinite(x)
            yield at[ok] * n_fields + i, (int_code if i < n_ints else float_code)(x[ok])

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _Dense(HALF)
        for batch in batches:
            for group, code in coded(batch):
                dense.add(group, code >> 16)
            yield from dense.take(MAX_BYTES)
        yield from dense.take()

    names = [(i * n_fields + k, g, f, totals[g]) for i, g in enumerate(groups) for k, f in enumerate(fields)]
    of = F.broadcast(df.sparkSession.createDataFrame(names, "grp bigint, g bigint, field string, total bigint"))
    heavy = F.col("n") >= F.col("total") * share
    first = _entries(sum_blocks(rows.mapInArrow(high, _BLOCKS))).join(of, "grp").filter(heavy)
    # at most 1 / share of them in each group
    halves = np.array(sorted((r["grp"] << 16) | r["code"] for r in first.select("grp", "code").collect()), np.int64)
    if not len(halves):
        return empty

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _Dense(HALF)
        for batch in batches:
            for group, code in coded(batch):
                key = (group.astype(np.int64) << 16) | (code >> 16)
                at = np.minimum(np.searchsorted(halves, key), len(halves) - 1)
                hit = halves[at] == key
                dense.add(at[hit], (code & (HALF - 1))[hit])
            yield from dense.take(MAX_BYTES)
        yield from dense.take()

    half = F.broadcast(df.sparkSession.createDataFrame([(i, int(h) >> 16, int(h) % HALF) for i, h in enumerate(halves)], "half bigint, grp bigint, high bigint"))
    low_keys = _entries(sum_blocks(rows.mapInArrow(low, _BLOCKS))).withColumnsRenamed({"grp": "half", "code": "low"})
    keys = low_keys.join(half, "half").join(of, "grp").filter(heavy)
    return keys.select(F.col("g").alias("grp"), "field", (F.col("high") * HALF + F.col("low")).alias("code"), "n", "total")


def heavy_particles(particle_mem: DataFrame, share: float = 0.05) -> DataFrame:
    """``heavy_keys`` of the shuffle destinations and indexed properties by epoch: epoch, field, key_val.

    key_val is the destination (-1 is one like others), or the property times 1,000,000, rounded;
    beyond what a bigint holds it is the largest or least that it does.
    """
    found = heavy_keys(particle_mem, "epoch", ["shuffle_dest"], ["indexed_prop"], share)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            code = f["code"].to_numpy()
            scaled = np.clip(np.rint(float_of(code).astype(np.float64) * 1e6), -(2.0**63), 2.0**63 - 1024)
            yield pd.DataFrame({"epoch": f["grp"].astype("Int32"), "field": f["field"], "key_val": np.where(f["field"] == "shuffle_dest", int_of(code), scaled.astype(np.int64))})

    return found.mapInPandas(named, "epoch int, field string, key_val bigint")


_TOTALS = "g bigint, block bigint, part int, counts array<bigint>, key bigint, n bigint, total bigint"


class _Totals:
    """Counts and sums by group and key, in arrays over blocks of BLOCK keys that exist where a key was seen."""

    def __init__(self) -> None:
        self.at, self.n, self.total = {}, np.zeros((64, BLOCK), np.int64), np.zeros((64, BLOCK), np.int64)

    def add(self, group: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
        block = key >> 9
        groups, of_group = np.unique(group, return_inverse=True)
        blocks, of_block = np.unique(block, return_inverse=True)
        pairs, pair = np.unique(of_group * len(blocks) + of_block, return_inverse=True)
        places = np.array([self._place((int(groups[p // len(blocks)]), int(blocks[p % len(blocks)]))) for p in pairs.tolist()], np.int64)
        slot = pair * BLOCK + (key & (BLOCK - 1))
        self.n[places] += np.bincount(slot, minlength=len(pairs) * BLOCK).reshape(-1, BLOCK)
        sums = np.zeros(len(pairs) * BLOCK, np.int64)
        np.add.at(sums, slot, value)
        self.total[places] += sums.reshape(-1, BLOCK)

    def _place(self, pair: tuple[int, int]) -> int:
        if (at := self.at.get(pair)) is None:
            at = self.at[pair] = len(self.at)
            if at == len(self.n):
                self.n, self.total = (np.concatenate([x, np.zeros_like(x)]) for x in (self.n, self.total))
        return at

    def take(self, least_bytes: int = -1) -> Iterator[pa.RecordBatch]:
        """What was added up, if the arrays take more than ``least_bytes``: arrays of full blocks, the keys of thin ones."""
        used = len(self.at)
        if used * BLOCK * 16 <= least_bytes or not used:
            return
        g, block = np.array(list(self.at), np.int64).T
        n, total = self.n[:used], self.total[:used]
        thin = (n > 0).sum(axis=1) < THIN
        part, names = TaskContext.get().partitionId(), ["g", "block", "part", "counts", "key", "n", "total"]
        full = np.flatnonzero(~thin)
        for i in range(0, len(full), FAN_IN):
            some = full[i : i + FAN_IN]
            both = np.hstack([n[some], total[some]])
            nulls = pa.nulls(len(some), pa.int64())
            lists = pa.ListArray.from_arrays(np.arange(0, (len(some) + 1) * 2 * BLOCK, 2 * BLOCK, dtype=np.int32), both.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(g[some]), pa.array(block[some]), pa.array(np.full(len(some), part), pa.int32()), lists, nulls, nulls, nulls], names)
        row, slot = np.nonzero(n * thin[:, None])
        if len(row):
            keys = pa.array((block[row] << 9) | slot)
            yield pa.RecordBatch.from_arrays([pa.array(g[row]), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.list_(pa.int64())), keys, pa.array(n[row, slot]), pa.array(total[row, slot])], names)
        self.__init__()


def _sum_totals(table: pa.Table) -> pa.Table:
    counts = table.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, 2 * BLOCK).sum(axis=0)
    return pa.table({"g": table.column("g").slice(0, 1), "block": table.column("block").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([counts], pa.list_(pa.int64()))})


def key_totals(df: DataFrame, group_col: str, key_col: str, value_col: str) -> DataFrame:
    """Rows and the sum of a whole-number column, by group and key: grp, key, n, total.

    Every split scatters its rows into dense arrays of counts and sums over blocks of 512 keys; the blocks are summed by a
    tree, and of blocks with few keys those keys by Spark's own partial and final sums. There may be any number of keys.
    Null keys and null groups are keys and groups of their own; null values add nothing, and a key whose values are all
    null has the total 0. An empty table gives an empty result.
    """
    value = F.coalesce(F.col(f"`{value_col}`").cast("bigint"), F.lit(0).cast("bigint"))
    rows = df.select(F.col(f"`{group_col}`").cast("bigint").alias("g"), F.col(f"`{key_col}`").cast("bigint").alias("k"), value.alias("v"))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Totals()
        for batch in batches:
            if batch.num_rows:
                sums.add(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                yield from sums.take(MAX_BYTES)
        yield from sums.take()

    whole = rows.filter("g IS NOT NULL AND k IS NOT NULL")
    parts = materialize(whole.mapInArrow(scatter, _TOTALS))
    blocks = parts.filter("counts IS NOT NULL").select("g", "block", "part", "counts")
    for branch in (F.floor(F.col("part") / FAN_IN), F.lit(0)):
        blocks = blocks.groupBy("g", "block", branch.alias("branch")).applyInArrow(_sum_totals, "g bigint, block bigint, part int, counts array<bigint>")
    slots = blocks.select("g", "block", F.posexplode(F.slice("counts", 1, BLOCK)).alias("slot", "n"), "counts").filter("n > 0")
    dense = slots.select("g", F.shiftleft("block", 9).bitwiseOR(F.col("slot").cast("bigint")).alias("key"), "n", F.get("counts", F.col("slot") + BLOCK).alias("total"))
    thin = parts.filter("counts IS NULL").select("g", "key", "n", "total")
    # the few rows without a group or a key are summed before the shuffle
    nulls = rows.filter("g IS NULL OR k IS NULL").groupBy("g", F.col("k").alias("key")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    every = dense.unionByName(thin).unionByName(nulls)
    return every.groupBy(F.col("g").alias("grp"), "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def once(particle_mem: DataFrame) -> DataFrame:
    """Every particle record once, by (epoch, src_rank, seq). Of several deliveries the one that arrived first counts."""
    keys = ["epoch", "src_rank", "seq"]
    rest = [c for c in particle_mem.columns if c not in (*keys, "arrived_ts")]
    first = F.min(F.struct(F.col("arrived_ts").isNull(), "arrived_ts", *rest)).alias("first")
    return particle_mem.groupBy(*keys).agg(first).select(*keys, *[F.col(f"first.{c}").alias(c) for c in ["arrived_ts", *rest]])


HEAVY_SQL = """
WITH total AS (SELECT epoch, count(*) AS n FROM particle_mem GROUP BY epoch),
keys AS (
    SELECT epoch, 'shuffle_dest' AS field, CAST(shuffle_dest AS DOUBLE) AS k FROM particle_mem WHERE shuffle_dest IS NOT NULL
    UNION ALL
    SELECT epoch, 'indexed_prop', CAST(indexed_prop AS DOUBLE) + 0.0 FROM particle_mem WHERE isfinite(indexed_prop)
), counted AS (SELECT epoch, field, k, count(*) AS c FROM keys GROUP BY epoch, field, k)
SELECT c.epoch, c.field, CAST(round(CASE WHEN c.field = 'shuffle_dest' THEN c.k ELSE c.k * 1000000 END) AS BIGINT) AS key_val
FROM counted c JOIN total t ON c.epoch = t.epoch WHERE c.c >= 0.05 * t.n
"""

TOTALS_SQL = """
WITH ranked AS (
    SELECT *, row_number() OVER (PARTITION BY epoch, src_rank, seq ORDER BY arrived_ts NULLS LAST) AS r FROM particle_mem
)
SELECT epoch, shuffle_dest, count(*) AS n_records, CAST(coalesce(sum(buf_sz), 0) AS BIGINT) AS bytes FROM ranked WHERE r = 1 GROUP BY epoch, shuffle_dest
"""
