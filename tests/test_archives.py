from __future__ import annotations

import posixpath
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import archives as ar

SCHEMA = "ps_id bigint, epoch int, src_rank int, pname string, psz bigint, mtime timestamp"


def canonical(path: str) -> str:
    low = path.lower()
    if low.startswith("file:"):
        rest = path[5:]
        if rest.lower().startswith("//localhost/"):
            rest = rest[11:]
        elif rest.startswith("///"):
            rest = rest[2:]
        path = rest if rest.startswith("/") and not rest.startswith("//") else path
    return posixpath.normpath(unquote(path)).replace("//", "/")


PATHS = [
    "/runs/q1/dump1/AAA", "/runs/q1/dump1/./AAA", "/runs//q1/dump1/AAA", "/runs/q1/dump1/../dump1/AAA", "file:///runs/q1/dump1/AAA", "/runs/q1/dump1/%41AA", "/runs/q1/dump1/aaa",
    "/runs/q1/x/y/../../dump1/AAA", "/runs/q1/dump1/+gA", "/runs/q1/dump1/%2BgA", "/runs/q1/dump1/...", "/runs/q1/.hidden", "FILE://localhost/runs/q1/dump1/AAA", "/../runs/q1/dump1/AAA",
    "/runs/q1/dump1/%E4%BD%A0", "/runs/q1/dump1/AA%2e", "/a b/c", "/a/" + "d/" * 2000 + "e",
]


def test_canonical_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = {r["p"]: r["c"] for r in df.select("p", ar.canonical_path(F.col("p")).alias("c")).collect()}
    assert got == {p: canonical(p) for p in PATHS}


def test_malformed_and_relative_paths(spark):
    df = spark.createDataFrame([("/a/%zz",), (None,), ("a/../../b",), ("",)], "p string")
    got = [r["c"] for r in df.select(ar.canonical_path(F.col("p")).alias("c")).collect()]
    assert got == ["/a/%zz", None, "../b", ""]


def listing(spark, rows):
    return spark.createDataFrame([(i, e, 0, p, s, None) for i, e, p, s in rows], SCHEMA)


def test_found_files(spark):
    rows = [
        (5, 1, "/r/A", 48), (2, 1, "/r/./A", 48), (9, 2, "/r/A", 48),  # one file in epoch 1, one in 2
        (3, 1, "/r/Z", 0), (4, 1, "/r//Z", 0),  # nothing in it
        (6, 1, "/r/Y", 0), (7, 1, "/r/Y", None),  # unknown is not 0
        (8, 1, "/r/X", 0), (10, 1, "/r/X", 7),
        (11, 1, None, 48), (12, None, "/r/A", 1), (13, None, "/r/A", 1),
    ]
    assert sorted(r["ps_id"] for r in ar.found_files(listing(spark, rows)).collect()) == [2, 6, 8, 9, 12]


def test_every_file_has_one_place(spark):
    rng = random.Random(4)
    rows = [(i, 1 + i % 3, f"/r/f{i % 700}", rng.choice([0, 48, 48, 900, 5000, None])) for i in range(2000)]
    files = ar.distinct_files(listing(spark, rows)).cache()
    plan = ar.plan_containers(files, 4000).collect()
    assert len(plan) == files.count() == len({(r["epoch"], r["path"]) for r in plan})
    by: dict = {}
    for r in plan:
        by.setdefault(r["container"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(n for _, n in spans) < 8000 or len(spans) == 1


def test_empty_listing(spark):
    assert ar.found_files(listing(spark, [])).count() == 0


def test_one_file_listed_very_often(spark):
    df = spark.range(20000).selectExpr("id AS ps_id", "1 AS epoch", "0 AS src_rank", "'/r/hot' AS pname", "48L AS psz", "cast(null AS timestamp) AS mtime")
    assert [r["ps_id"] for r in ar.found_files(df).collect()] == [0]


def test_large_files_begin_their_containers(spark):
    rows = [(i, 1, f"/r/f{i}", 5000 if i % 3 == 0 else 10) for i in range(60)]
    plan = ar.plan_containers(ar.distinct_files(listing(spark, rows)).cache(), 4000).collect()
    large = [r for r in plan if r["length"] == 5000]
    assert len(plan) == 60 and len(large) == 20 == len({r["container"] for r in large}) and {r["offset"] for r in large} == {0}


def random_files(n: int) -> dict:
    rng = random.Random(1)
    return {f"/p/{i}": bytes(rng.getrandbits(8) for _ in range(rng.choice([0, 1, 40, 48, 3000]))) for i in range(n)}


@pytest.mark.parametrize("rows_a_batch", ["10000", "7"])
def test_pack_and_read_back(spark, tmp_path, rows_a_batch):
    content = random_files(300)
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in content.items()] + [(None, bytearray(b"x")), ("/none", None)], "path string, content binary")
    out = str(tmp_path / "packed")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        index = ar.pack(df, out, block_bytes=20_000)
        places = {r["path"]: r for r in index.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(places) == set(content) and all(places[p]["length"] == len(c) for p, c in content.items())
    assert 1 < index.select("container").distinct().count() < 60
    back = ar.read_members(spark, out).collect()
    assert all(r["intact"] for r in back)
    assert len(back) == 300 and {r["path"]: bytes(r["content"]) for r in back} == content
    few = spark.createDataFrame([("/p/7",), ("/p/7",), ("/none",)], "path string")
    assert [bytes(r["content"]) for r in ar.read_members(spark, out, few).collect()] == [content["/p/7"]]
    many = spark.createDataFrame([(f"/p/{i}",) for i in range(0, 300, 2)], "path string")
    assert {r["path"]: bytes(r["content"]) for r in ar.read_members(spark, out, many).collect()} == {f"/p/{i}": content[f"/p/{i}"] for i in range(0, 300, 2)}


def test_a_lookup_reads_one_block(spark, tmp_path):
    """The ranges of hashes of all blocks are apart, so a file may be in one of them only."""
    content = random_files(300)
    out = str(tmp_path / "ranges")
    ar.pack(spark.createDataFrame([(p, bytearray(c)) for p, c in content.items()], "path string, content binary"), out, block_bytes=5_000)
    spans = sorted((r["low"], r["high"]) for r in spark.read.parquet(out).select("low", "high").collect())
    assert len(spans) > 10 and all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_empty_archive(spark, tmp_path):
    out = str(tmp_path / "none")
    assert ar.pack(spark.createDataFrame([], "path string, content binary"), out).count() == 0
    assert ar.read_members(spark, out).count() == 0
    assert ar.read_members(spark, out, spark.createDataFrame([("/a",)], "path string")).count() == 0


def test_a_path_packed_twice_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("/a", bytearray(b"1")), ("/b", bytearray(b"1")), ("/a", bytearray(b"2"))], "path string, content binary")
    with pytest.raises(Exception, match="more than once"):
        ar.pack(df, str(tmp_path / "x"))


def test_damage_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([("/a", bytearray(b"abc"))], "path string, content binary")
    out = str(tmp_path / "y")
    ar.pack(df, out)
    bad = spark.read.parquet(out).withColumn("content", F.lit(b"abX"))
    bad.write.parquet(out + "2")
    assert [r["intact"] for r in ar.read_members(spark, out + "2").collect()] == [False]


def test_records_of_a_listing(spark, tmp_path):
    rows = [(5, 1, "/r/A", 48), (2, 1, "/r/./A", 48), (9, None, "/r/line\nfeed", None), (4, 2, "/r/Z", 0)]
    out = str(tmp_path / "listing")
    ar.archive_listing(listing(spark, rows), out)
    got = sorted(tuple(r) for r in ar.listed_members(ar.read_members(spark, out)).collect())
    assert got == [(2, 1, "/r/A", 48, True), (9, None, "/r/line\nfeed", 4096, False)]
