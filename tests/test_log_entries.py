from __future__ import annotations

import datetime as dt

import pytest

from rangeloom.operators import log_entries

OPENED = dt.datetime(2023, 3, 1, 0, 0, 58, 527000)
MS = int(OPENED.replace(tzinfo=dt.UTC).timestamp() * 1000)
SCHEMA = "log_file string, line_no int, line_text string, opened_ts timestamp, shipped_ts timestamp"


def run(spark, files, opened=OPENED):
    rows = [(f, i, t, opened, None) for f, lines in files.items() for i, t in enumerate(lines, 1)]
    return {(r["log_file"], r["line_no"]): r for r in log_entries.entries(spark.createDataFrame(rows, SCHEMA)).collect()}


def at(text: str) -> int:
    return round(dt.datetime.fromisoformat(text).timestamp() * 1000)


LINES = [
    ("2023-03-01T14:41:57,758+05:30 WARN  [pivot_union] no ERROR seen", at("2023-03-01T14:41:57.758+05:30"), "WARN", "pivot_union", "no ERROR seen"),
    ("2023-03-01T14:41:57.7589-0500 [rtp] Info - text", at("2023-03-01T14:41:57.758-05:00"), "INFO", "rtp", "text"),
    ("2023-03-01T14:41:57Z [rtp] text", at("2023-03-01T14:41:57+00:00"), "NONE", "rtp", "text"),
    ("[2023-03-01 00:57:08.096] -INFO- reader.probe: text: more", at("2023-03-01T00:57:08.096+00:00"), "INFO", "reader.probe", "text: more"),
    ("[2023-03-01 00:57:08.096] !!! FATAL !!! state dump [rank 3]: follows", at("2023-03-01T00:57:08.096+00:00"), "FATAL", "", "state dump [rank 3]: follows"),
    ("[2023-03-01 00:57:08.096] mover: text", at("2023-03-01T00:57:08.096+00:00"), "NONE", "mover", "text"),
    ("E0301 01:11:16.633944  9012 bins] text", at("2023-03-01T01:11:16.633+00:00"), "ERROR", "bins", "text"),
    ("Mar  1 00:40:54 cn-0015 bins[9803]: info: text", at("2023-03-01T00:40:54+00:00"), "INFO", "bins", "text"),
    ("Dec 31 23:59:59 cn-0015 mover[2073]: <CRIT> text", at("2023-12-31T23:59:59+00:00"), "FATAL", "mover", "text"),
    ("Mar  1 00:40:54 cn-0015 rtp[447]: state dump [rank 186]: follows", at("2023-03-01T00:40:54+00:00"), "NONE", "rtp", "state dump [rank 186]: follows"),
    ('ts=1677638612.4829 lvl=E comp=monitor msg="retry 2 of 5"', 1677638612482, "ERROR", "monitor", "retry 2 of 5"),
    ('severity=dbg ts=1677638525.957 comp=mover msg="x" rank=7', 1677638525957, "DEBUG", "mover", "x"),
    ('{"time": "2023-03-01T00:57:10.502Z", "level": "info", "component": "reader.probe", "message": "epoch"}', at("2023-03-01T00:57:10.502+00:00"), "INFO", "reader.probe", "epoch"),
    ('{"t": 1677632297791, "sev": "warning", "src": "shuffle", "text": "x", "detail": {"level": 3}}', 1677632297791, "WARN", "shuffle", "x"),
    ("8846, LOGICAL_BYTES_WRITTEN, 42499941", MS + 8846, "NONE", "LOGICAL_BYTES_WRITTEN", " 42499941"),
    ('16754,"RENEG_COUNTS","1,2"', MS + 16754, "NONE", "RENEG_COUNTS", '"1,2"'),
    ("18229,RENEG_RTP_PVT_SEND", MS + 18229, "NONE", "RENEG_RTP_PVT_SEND", ""),
]


def test_layouts(spark):
    got = run(spark, {"f": [line for line, *_ in LINES]})
    for i, (line, ts, level, component, message) in enumerate(LINES, 1):
        r = got["f", i]
        assert (r["ts_ms"], r["log_level"], r["component"], r["message"], r["n_lines"]) == (ts, level, component, message, 1), line


def test_continuations_heads_and_headers(spark):
    head = "[2023-03-01 00:57:08.096] -INFO- a: one"
    lines = ["cut off", "  at mover::x", head, "    at mover::right+0x143", "  > 2023-03-01T01:13:10Z ERROR [b] quoted", "5332,2461,2587", None, "", "Timestamp (ms),Stat Type, Stat Value", "after the header", head, "{", "}"]
    got = run(spark, {"f": lines, "g": ["nothing", "here"]})
    assert {k: r["n_lines"] for k, r in got.items()} == {("f", 3): 6, ("f", 11): 3}
    assert got["f", 3]["message"].startswith("one\n    at mover::right")


def test_json_over_several_lines(spark):
    lines = ["{", '  "level": "info",', '  "t": 1677632237420,', '  "detail": {', '    "level": 3', "  },", '  "src": "store",', '  "text": "retry"', "}", "trailing", "}"]
    got = run(spark, {"f": lines})
    (r,) = got.values()
    assert (r["line_no"], r["n_lines"], r["ts_ms"], r["log_level"], r["component"]) == (1, 11, 1677632237420, "INFO", "store")
    assert r["message"] == "retry\ntrailing\n}"


def test_units_of_relative_stamps(spark):
    named = run(spark, {"f": ["Timestamp (s),Stat Type, Stat Value", "7,RENEG_AGGR_STD,0.1", "7.6059,RENEG_AGGR_STD,0.1"]})
    assert [named["f", i]["ts_ms"] for i in (2, 3)] == [MS + 7000, MS + 7605]
    guessed = run(spark, {"s": ["7.605,RENEG_AGGR_STD,0.1", "8,RENEG_AGGR_STD,0.1"], "m": ["7605,RENEG_AGGR_STD,0.1"], "late": ["9,RENEG_AGGR_STD,1", "Timestamp (s),Stat Type, Stat Value"]})
    assert (guessed["s", 2]["ts_ms"], guessed["m", 1]["ts_ms"], guessed["late", 1]["ts_ms"]) == (MS + 8000, MS + 7605, MS + 9000)


@pytest.mark.parametrize("block", [3, 5, 16_384])
def test_long_files_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(log_entries, "BLOCK_LINES", block)
    lines = ["noise"] * 4 + ["{", ' "t": 1677632237420, "sev": "E", "more": {', ' "a": {}', " },", ' "src": "x", "text": "y"', "}"] + ["more"] * 7 + ["Timestamp (s),Stat Type, Stat Value"] + ["lost"] * 5 + ["3,RENEG_AGGR_STD,1"] + ["1 2 3"] * 8
    got = run(spark, {"f": lines})
    assert got["f", 5]["message"] == "y" + "\nmore" * 7
    assert {k[1]: (r["n_lines"], r["ts_ms"], r["log_level"]) for k, r in got.items()} == {5: (13, 1677632237420, "ERROR"), 24: (9, MS + 3000, "NONE")}


def test_lines_shipped_twice_nulls_and_clashing_columns(spark):
    rows = [("f", 1, LINES[0][0], OPENED, "x"), ("f", 1, LINES[0][0], OPENED, "y"), ("f", 2, "more", OPENED, "x"), (None, 1, LINES[0][0], OPENED, "x"), ("f", None, LINES[0][0], OPENED, "x"), ("g", 1, LINES[6][0], None, "x"), ("h", 1, LINES[14][0], None, "x")]
    df = spark.createDataFrame(rows, "log_file string, line_no int, line_text string, opened_ts timestamp, block string").selectExpr("*", "1 AS layout", "2 AS owner", "3 AS text", "4 AS unit")
    got = {(r["log_file"], r["line_no"]): r for r in log_entries.entries(df).collect()}
    assert set(got) == {("f", 1), ("g", 1), ("h", 1)}
    assert got["f", 1]["n_lines"] == 2 and got["g", 1]["ts_ms"] is None and got["h", 1]["ts_ms"] is None


def test_empty_table_and_a_very_long_line(spark):
    assert log_entries.found_entries(spark.createDataFrame([], SCHEMA)).count() == 0
    got = run(spark, {"f": [LINES[0][0] + "x" * 1_000_000, "y" * 1_000_000]})
    assert got["f", 1]["n_lines"] == 2 and len(got["f", 1]["message"]) > 2_000_000
