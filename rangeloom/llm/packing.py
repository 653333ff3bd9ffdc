"""Filling containers of a fixed capacity with texts by minimum bin slack.

Documents are spread over groups of a bounded number of documents by a hash of their id. Within a group only the
multiset of lengths matters: a container takes the longest length left and then, of the lengths left, the multiset
whose sum comes closest to the room that remains. It is found by subset-sum dynamic programming on a bitset (one bit
a total) and the counts are read back from the bitsets before each length. A text is split only if it alone exceeds
the capacity: into full containers and a rest that is packed like others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.config import materialize
from rangeloom.llm.tokens import VOCABULARY, token_sizes

CAPACITY = 4096
#: Documents in a group. Each group leaves a few containers short of items to fill them, so it should not be small.
GROUP_DOCS = 20_000


def best_fill(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, copies), whose sum comes closest to ``room`` without exceeding it.

    ``order`` holds the lengths in descending order, ``counts`` how many are left of each.
    """
    reach, mask, full = 1, (1 << (room + 1)) - 1, 1 << room
    before: list[tuple[int, int]] = []
    for length in order:
        if length > room or not counts[length]:
            continue
        before.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            more = (reach | (reach << length)) & mask
            if more == reach:
                break
            reach = more
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, []
    for length, earlier in reversed(before):
        copies = 0
        while not (earlier >> total) & 1:
            total -= length
            copies += 1
        if copies:
            taken.append((length, copies))
    return taken


def fill_containers(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Containers for lengths within 1 and ``capacity``: the container and the offset in it, of each length."""
    order = np.argsort(-lengths, kind="stable")
    values, starts, sizes = np.unique(-lengths[order], return_index=True, return_counts=True)
    descending = [int(-v) for v in values]
    at = dict(zip(descending, starts.tolist(), strict=True))
    counts = dict(zip(descending, sizes.tolist(), strict=True))
    container, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    current = 0
    while descending:
        longest = descending[0]
        counts[longest] -= 1
        chosen = [(longest, 1), *best_fill(counts, descending, capacity - longest)]
        filled = 0
        for place, (length, copies) in enumerate(chosen):
            if place:
                counts[length] -= copies
            for _ in range(copies):
                i = order[at[length]]
                at[length] += 1
                container[i], offset[i] = current, filled
                filled += length
        descending = [length for length in descending if counts[length]]
        current += 1
    return container, offset


def pack_documents(sizes: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Places in containers for (doc_id, tokens): container_id, doc_id, part_no, n_parts, tokens, offset.

    Every token of every document gets exactly one place. Parts of a split text are numbered from 0 in the order of the
    text. A doc_id that comes several times counts once (the smallest size); rows without one, and texts of 0 tokens, are
    left out. ``offset`` counts tokens from the start of the container. An empty table gives an empty result.
    """
    once = materialize(sizes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("tokens").alias("tokens")).filter("tokens > 0"))
    groups = max(1, -(-once.count() // group_docs))
    # a given number of partitions, as few bytes of lengths are much work
    spread = once.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("bigint")).repartition(groups, "grp")

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        doc, size, base = frame["doc_id"].to_numpy(), frame["tokens"].to_numpy(), int(frame["grp"].iloc[0]) << 32
        full = (size - 1) // capacity
        rest = size - full * capacity
        container, offset = fill_containers(rest, capacity)
        whole = np.repeat(np.arange(len(doc)), full)
        number = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        rests = {"doc_id": doc, "part_no": full, "n_parts": full + 1, "tokens": rest, "container_id": base + container, "offset": offset}
        fulls = {"doc_id": doc[whole], "part_no": number, "n_parts": full[whole] + 1, "tokens": np.full(len(whole), capacity), "container_id": base + (container.max() + 1) + np.arange(len(whole)), "offset": np.zeros(len(whole), np.int64)}
        return pd.concat([pd.DataFrame(rests), pd.DataFrame(fulls)])[["container_id", "doc_id", "part_no", "n_parts", "tokens", "offset"]]

    return spread.groupBy("grp").applyInPandas(packed, "container_id bigint, doc_id bigint, part_no int, n_parts int, tokens bigint, `offset` bigint")


def packed_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack_documents(token_sizes(documents, vocabulary=vocabulary))


def split_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents that the packer had to split: doc_id."""
    return packed_documents(documents, vocabulary).filter("n_parts > 1 AND part_no = 0").select("doc_id")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers by how much room they leave, in eighths of the capacity: eighths_empty, n_containers, tokens, slack."""
    used = packed.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    return (
        used.groupBy(F.floor((F.lit(capacity) - F.col("used")) * 8 / F.lit(capacity)).cast("int").alias("eighths_empty"))
        .agg(F.count("*").alias("n_containers"), F.sum("used").alias("tokens"), F.sum(F.lit(capacity) - F.col("used")).alias("slack"))
    )


def packing_faults(packed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How often a packing breaks what must hold, all 0 in a right one: fault, n.

    ``overfull``: containers with more than the capacity. ``gaps``: containers with room before or between items. ``split``:
    documents split that fit a container. ``tokens``: documents whose tokens have not exactly one place each. ``unused``: 1
    if there are more containers than 1 % and one a group more than the tokens fill.
    """
    packed = materialize(packed)
    used = packed.groupBy("container_id").agg(F.sum("tokens").alias("used"), F.max(F.col("offset") + F.col("tokens")).alias("end"), F.count_distinct("offset").alias("starts"), F.count("*").alias("n"))
    placed = packed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("parts"), F.count_distinct("part_no").alias("numbers"), F.max("n_parts").alias("n_parts"))
    once = sizes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("tokens").alias("tokens")).filter("tokens > 0")
    both = once.join(placed, "doc_id", "full")
    wrong = both.filter("coalesce(placed, -1) <> coalesce(tokens, -2) OR parts <> numbers OR parts <> n_parts")
    fill, docs = used.agg(F.count("*").alias("c"), F.sum("used").alias("used")).first(), once.count()
    roomy = used.sparkSession.range(int(fill["c"] > -(-(fill["used"] or 0) // capacity) * 1.01 + -(-docs // GROUP_DOCS)))
    found = {"overfull": used.filter(F.col("used") > capacity), "gaps": used.filter("used <> end OR starts <> n"), "split": both.filter((F.col("tokens") <= capacity) & (F.col("parts") > 1)), "tokens": wrong, "unused": roomy}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(fault).alias("fault"), "n") for fault, df in found.items()])


FAULTS_SQL = "SELECT unnest(['overfull', 'gaps', 'split', 'tokens', 'unused']) AS fault, CAST(0 AS BIGINT) AS n"
#: No text is near the limit: those of more than so many bytes have more tokens.
FOUND_SQL = "SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND strlen(text) > 16384"
