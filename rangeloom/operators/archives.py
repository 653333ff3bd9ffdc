"""Many tiny files into few large containers, without losing or duplicating one.

``pack`` writes the bytes of files into blocks, rows of a Parquet table: the block's bytes, and its index of member name,
offset, length and checksum. Files are hashed to partitions and sorted by that hash, so every block covers a range of
hashes of its own: a lookup of a few files reads the blocks whose range holds their hashes, by the statistics of the Parquet
files, and all other reads are parallel over blocks. Members are laid end to end while a partition streams by, one block
in memory, so there is no window, no plan and no join of plan and bytes. ``plan_containers`` makes such an index from a
listing, before any byte is moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.config import shared_path

CONTAINER_BYTES = 128 << 20
#: A bucket holds at most about so many files, however small they are.
BUCKET_FILES = 500_000
#: The bytes of a block: what is held in memory, written and read at once.
BLOCK_BYTES = 4 << 20
#: Up to so many wanted files are looked up by their places alone.
MAX_PUSHED = 64
#: What a file of unknown size is planned with.
UNKNOWN_BYTES = 4096


def canonical_path(path: Column) -> Column:
    """The place a path leads to: file: schemes and percent escapes resolved, no empty, '.' or '..' steps.

    Letter case is kept. A malformed escape is kept as it stands. '..' above the root stays at the root. Null for null.
    """
    plain = path.startswith("/") & ~reduce(lambda a, b: a | b, [path.contains(x) for x in ("%", "//", "/./", "/../")] + [path.endswith(x) for x in ("/", "/.", "/..")])
    # few paths need more than the look above
    return F.when(plain, path).otherwise(_resolved(path))


def _resolved(path: Column) -> Column:
    bare = F.regexp_replace(path, r"(?i)^file:(?://(?:localhost)?)?(?=/)", "")
    # a plus sign is a plus sign in a path
    decoded = F.when(bare.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)).otherwise(bare)

    def walked(place: Column) -> Column:
        rooted = place.startswith("/")
        steps = F.aggregate(
            F.split(place, "/"),
            F.array().cast("array<string>"),
            lambda done, step: F.when(step.isin("", "."), done)
            .when((step == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when((step == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(step))),
        )
        return F.when(place.rlike(r"(^|/)\.{0,2}(/|$)"), F.concat(F.when(rooted, F.lit("/")).otherwise(""), F.array_join(steps, "/"))).otherwise(place)

    # as an array of one, so that it is decoded once
    return F.element_at(F.transform(F.array(decoded), walked), 1)


def distinct_files(listing: DataFrame) -> DataFrame:
    """Every file of a listing (ps_id, epoch, pname, psz) that has to be carried over, once: ps_id, epoch, path, length, size_known.

    ps_id is the smallest among the file's listings, length the largest known size. A file all of whose listings say 0
    bytes is left out; an unknown size is not 0. Listings without a path name no file and are left out; a null epoch is
    an epoch like others. Copies are merged before they are shuffled, so a file listed very often is no burden.
    """
    return (
        listing.filter(F.col("pname").isNotNull())
        .select("ps_id", "epoch", canonical_path(F.col("pname")).alias("path"), F.col("psz").cast("bigint").alias("psz"))
        .groupBy("epoch", "path")
        .agg(F.min("ps_id").alias("ps_id"), F.max("psz").alias("known"), F.max(F.when(F.col("psz") == 0, 0).otherwise(1)).alias("kept"))
        .filter("kept = 1")
        # sizes of 0 and unknown together: the size is not known
        .select("ps_id", "epoch", "path", F.when(F.col("known") > 0, F.col("known")).alias("known"))
        .select("ps_id", "epoch", "path", F.coalesce("known", F.lit(UNKNOWN_BYTES)).alias("length"), F.col("known").isNotNull().alias("size_known"))
    )


def plan_containers(files: DataFrame, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """The index of containers for distinct files (epoch, path, length and others): plus container, offset, checksum.

    A file that alone reaches ``container_bytes`` gets a container of its own. The others are laid end to end in the
    order of a hash of their path, and every ``container_bytes`` a new container begins, with the file that crosses the
    mark; so a container has less than twice that size. ``checksum`` is of the member's header (epoch, path, length).
    Every file comes out exactly once. An empty table gives an empty plan. ``files`` is read twice, so it should be a table.
    """
    small = F.col("length") < container_bytes
    size = files.agg(F.count("*").alias("n"), F.sum(F.when(small, F.col("length"))).alias("bytes")).first()
    buckets = max(1, -(-(size["bytes"] or 0) // (4 * container_bytes)), -(-size["n"] // BUCKET_FILES))
    header = F.crc32(F.concat_ws("\n", F.coalesce(F.col("epoch").cast("string"), F.lit("")), "path", F.col("length").cast("string")).cast("binary"))
    hashed = files.withColumn("_h", F.xxhash64("epoch", "path"))
    spread = hashed.filter(small).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    order = Window.partitionBy("_b").orderBy("_h", "epoch", "path")
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = spread.withColumn("_end", end).withColumn("_slot", F.floor((F.col("_end") - F.lit(1)) / F.lit(container_bytes)))
    within = Window.partitionBy("_b", "_slot").orderBy("_h", "epoch", "path")
    offset = F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = at.withColumns({"container": F.format_string("c%08d-%06d", F.col("_b"), F.col("_slot")), "offset": offset, "checksum": header})
    # a file in a container of its own begins it, whatever its hash
    name = F.concat(F.lit("f"), F.hex("_h"), F.lit("-"), F.hex(F.crc32(F.concat_ws("/", F.col("epoch").cast("string"), "path").cast("binary"))))
    alone = hashed.filter(F.col("length") >= container_bytes).withColumns({"container": name, "offset": F.lit(0).cast("bigint"), "checksum": header})
    return shared.drop("_h", "_b", "_end", "_slot").unionByName(alone.drop("_h"))


def _place(by: Sequence[str], parts: int) -> Column:
    """Where a member lies in the order of the archive: its partition, and within that a hash. Not negative."""
    return F.shiftleft(F.pmod(F.hash(*by), F.lit(parts)).cast("bigint"), 44).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*by), 20))


def _blocks_of(batches: Iterator[pa.RecordBatch], names: Sequence[str], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted members (place, names, content, checksum) as blocks: container, low, high, content, members."""
    first = TaskContext.get().partitionId() << 32
    n = len(names)
    held: list[tuple[np.ndarray, list[pa.Array], memoryview, np.ndarray, pa.Array]] = []
    filled, made, last = 0, 0, None

    def block() -> pa.RecordBatch:
        lengths = np.concatenate([h[3] for h in held])
        columns = [pa.concat_arrays([h[1][i] for h in held]) for i in range(n)]
        offsets = np.cumsum(lengths) - lengths
        members = pa.StructArray.from_arrays([*columns, pa.array(offsets), pa.array(lengths), pa.concat_arrays([h[4] for h in held])], [*names, "offset", "length", "checksum"])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first + made], pa.int64()),
                pa.array([int(held[0][0][0])], pa.int64()),
                pa.array([int(held[-1][0][-1])], pa.int64()),
                pa.array([b"".join(h[2] for h in held)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), members),
            ],
            ["container", "low", "high", "content", "members"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column(0).to_numpy()
        columns = [batch.column(1 + i) for i in range(n)]
        # equal names have equal places, so they are neighbours
        for i in [-1, *np.flatnonzero(place[1:] == place[:-1]).tolist()]:
            one = last if i < 0 else tuple(c[i].as_py() for c in columns)
            if one == tuple(c[i + 1].as_py() for c in columns):
                raise ValueError(f"packed more than once: {one}")
        last = tuple(c[-1].as_py() for c in columns)
        content, checksum = batch.column(1 + n).cast(pa.binary()), batch.column(2 + n)
        ends = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
        data = memoryview(content.buffers()[2]) if content.buffers()[2] is not None else memoryview(b"")
        start = 0
        while start < batch.num_rows:
            # up to the member that fills the block
            stop = min(int(np.searchsorted(ends, ends[start] + block_bytes - filled, side="left")), batch.num_rows)
            stop = max(stop, start + 1)
            held.append((place[start:stop], [c.slice(start, stop - start) for c in columns], data[ends[start] : ends[stop]], np.diff(ends[start : stop + 1]), checksum.slice(start, stop - start)))
            filled += int(ends[stop] - ends[start])
            if filled >= block_bytes:
                yield block()
                held, filled, made = [], 0, made + 1
            start = stop
    if held:
        yield block()


def pack(files: DataFrame, out: str, by: Sequence[str] = ("path",), block_bytes: int = BLOCK_BYTES, grouped: bool = False) -> DataFrame:
    """Write files (``by`` columns that name them, content) into blocks below ``out``; the archive's index comes back, see ``read_index``.

    A block is closed by the member that fills it, so it has ``block_bytes`` and less than one member more; a member is never
    split. ``grouped`` says that the files come grouped by ``by`` from an aggregation with as many partitions as the
    session's shuffles have; they are not shuffled again then. A file packed twice is an error. Files without content, or
    without any name, are left out; empty files are kept. An empty table gives an empty archive.
    """
    spark = files.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = files.select(*by, "content").filter(F.col("content").isNotNull() & F.coalesce(*[F.col(c).cast("string") for c in by]).isNotNull())
    if not grouped:
        kept = kept.repartition(parts, *by)
    placed = kept.select(_place(by, parts).alias("place"), *by, "content", F.crc32("content").alias("checksum")).sortWithinPartitions("place", *by)
    kinds = ", ".join(f"`{c}`: {files.schema[c].dataType.simpleString()}" for c in by)
    schema = f"container bigint, low bigint, high bigint, content binary, members array<struct<{kinds}, offset: bigint, length: bigint, checksum: bigint>>"
    names = list(by)
    blocks = placed.mapInArrow(lambda batches: _blocks_of(batches, names, block_bytes), schema)
    # blocks are large rows: a few of them make a row group, so that one is read without the others
    options = {"parquet.block.size": str(4 * block_bytes), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "compression": "zstd"}
    blocks.withColumn("parts", F.lit(parts)).write.options(**options).mode("errorifexists").parquet(out)
    return read_index(spark, out)


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The index of an archive: the members' names, container, offset, length, checksum. The contents are not read."""
    rows = spark.read.parquet(out).select("container", F.explode("members").alias("m"))
    return rows.select("m.*", "container")


def read_members(spark: SparkSession, out: str, wanted: DataFrame | None = None) -> DataFrame:
    """Files by name (all where ``wanted`` is None): the members' names, content, intact. ``intact`` is false where the checksum differs.

    Of a few wanted files (``MAX_PUSHED``) only the blocks whose hashes may hold them are read; more are read in parallel
    over all blocks.
    """
    blocks = spark.read.parquet(out)
    names = [f.name for f in blocks.schema["members"].dataType.elementType.fields[:-3]]
    asked = None
    if wanted is not None:
        asked = wanted.select(*names).distinct()
        some = blocks.select("parts").first()
        places = [r[0] for r in asked.select(_place(names, some["parts"])).limit(MAX_PUSHED + 1).collect()] if some else []
        if len(places) <= MAX_PUSHED:
            blocks = blocks.filter(reduce(lambda a, b: a | b, [(F.col("low") <= p) & (F.col("high") >= p) for p in places], F.lit(False)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema["members"].dataType.elementType.fields[:-3])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = pa.py_buffer(batch.column(0)[i].as_buffer())
                members = batch.column(1)[i].values
                columns = members.flatten()
                length = columns[-2].to_numpy()
                # members lie end to end
                ends = np.concatenate([[0], np.cumsum(length)])
                step = max(1, int(len(length) * BLOCK_BYTES // max(1, len(content))))
                for a in range(0, len(length), step):
                    b = min(a + step, len(length))
                    part = content.slice(int(ends[a]), int(ends[b] - ends[a]))
                    offsets = pa.py_buffer((ends[a : b + 1] - ends[a]).astype(np.int32))
                    values = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, part])
                    yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in columns[:-3]], values, columns[-1].slice(a, b - a)], [*names, "content", "checksum"])

    found = blocks.select("content", "members").mapInArrow(cut, f"{kinds}, content binary, checksum bigint")
    if asked is not None:
        found = found.join(asked, reduce(lambda a, b: a & b, [found[c].eqNullSafe(asked[c]) for c in names]), "left_semi")
    return found.select(*names, "content", (F.crc32("content") == F.col("checksum")).alias("intact"))


def archive_listing(ps: DataFrame, out: str) -> DataFrame:
    """The distinct files of a listing as members of an archive below ``out``, and its index. See ``distinct_files``.

    A listing has no bytes of its files; what is packed of each is its record: ps_id, length, whether that is known, path.
    """
    record = F.concat_ws("\n", F.col("ps_id").cast("string"), F.col("length").cast("string"), F.col("size_known").cast("string"), "path")
    files = distinct_files(ps).select("epoch", "path", record.cast("binary").alias("content"))
    return pack(files, out, ("epoch", "path"), grouped=True)


def listed_members(members: DataFrame) -> DataFrame:
    """The records of intact members of a listing's archive: ps_id, epoch, path, length, size_known."""
    part = F.split(F.col("content").cast("string"), "\n", 4)
    fields = (part[0].cast("bigint").alias("ps_id"), "epoch", part[3].alias("path"), part[1].cast("bigint").alias("length"), part[2].cast("boolean").alias("size_known"))
    return members.filter("intact").select(*fields)


def found_files(ps: DataFrame) -> DataFrame:
    """The particle files that a listing's archive gives back intact: ps_id. The archive is written to the shared folder."""
    out = shared_path(ps.sparkSession, "archive")
    archive_listing(ps, out)
    return listed_members(read_members(ps.sparkSession, out)).select("ps_id")


_CANON = r"""
WITH RECURSIVE listing AS (
    SELECT ps_id, epoch, psz, url_decode(regexp_replace(replace(pname, '+', '%2B'), '^[Ff][Ii][Ll][Ee]:(//(localhost)?)?/', '/')) AS p FROM ps WHERE pname IS NOT NULL
), shape AS (
    SELECT ps_id, epoch, psz, regexp_replace(regexp_replace(p, '/(\./)+', '/', 'g'), '/+', '/', 'g') AS p FROM listing
), up AS (
    SELECT ps_id, epoch, psz, p FROM shape
    UNION ALL
    SELECT ps_id, epoch, psz, regexp_replace(p, '/[^/]+/\.\./', '/') FROM up WHERE contains(p, '/../')
), files AS (
    SELECT epoch, p, min(ps_id) AS ps_id, max(psz) AS known, bool_or(psz IS NULL OR psz <> 0) AS kept FROM up WHERE NOT contains(p, '/../') GROUP BY epoch, p
)
"""
FOUND_SQL = _CANON + "SELECT ps_id FROM files WHERE kept"
LOOKUP_SQL = _CANON + "SELECT ps_id, epoch, p AS path, CASE WHEN known > 0 THEN known ELSE 4096 END AS length FROM files WHERE kept AND ps_id % 100 = 0"
FILES_SQL = _CANON + "SELECT ps_id, epoch, p AS path, CASE WHEN known > 0 THEN known ELSE 4096 END AS length, coalesce(known > 0, false) AS size_known FROM files WHERE kept"
