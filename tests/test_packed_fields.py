"""Packed fields against a scanner written the other way round, character by character."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest

from rangeloom.operators import packed_fields
from rangeloom.operators.packed_fields import explode_packed, packed_perflog


def plain(c: str) -> bool:
    return c in "_+-." or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"


def blank(c: str) -> bool:
    return c.isspace()


def scan(text: str | None) -> list[str]:
    """The values of a field; [] where there are fewer than two."""
    if text is None:
        return []
    body = re.sub(r":?\s*OOB\s*\([^()]*\)\s*$", "", text) if "OOB" in text else text
    body = re.sub(r"^\s*[A-Za-z_][\w+\-.]*\s*:", "", body)
    bare = body.strip()
    if len(bare) > 1 and bare[0] + bare[-1] in ("()", "[]", "{}", "<>"):
        body = bare[1:-1]
    tokens: list[tuple[str, str]] = []
    i = 0
    while i < len(body):
        c = body[i]
        if c in "\"'":
            j, value, closed = i + 1, "", False
            while j < len(body):
                if body[j] == "\\" and j + 1 < len(body):
                    value += c if body[j + 1] == c else body[j : j + 2]
                    j += 2
                elif body[j] == c and body[j + 1 : j + 2] == c:
                    value += c
                    j += 2
                elif body[j] == c:
                    closed = True
                    break
                else:
                    value += body[j]
                    j += 1
            if closed:
                tokens.append(("value", value))
                i = j + 1
                continue
            tokens.append(("sep", c))
            i += 1
        elif plain(c):
            j = i
            while j < len(body) and plain(body[j]):
                j += 1
            tokens.append(("value", body[i:j]))
            i = j
        else:
            if not blank(c):
                tokens.append(("sep", c))
            i += 1
    while tokens and tokens[-1][0] == "sep":
        tokens.pop()
    out, open_seps, started = [], 0, False
    for kind, value in tokens:
        if kind == "sep":
            open_seps += 1
        else:
            out += [""] * max(0, open_seps - 1) + [value]
            open_seps, started = 0, True
    real = sum(k == "value" for k, _ in tokens)
    return out if started and real > 1 else []


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, v string")
    got: dict[int, list] = {}
    for r in explode_packed(df, "v", ["id"]).collect():
        got.setdefault(r["id"], []).append((r["pos"], r["val"]))
    for rows in got.values():
        assert sorted(p for p, _ in rows) == list(range(len(rows)))
    return [[v for _, v in sorted(got.get(i, []))] for i in range(len(texts))]


CASES = [
    ("1708; 10783; 1027", ["1708", "10783", "1027"]),
    ("RANK124_R9: 1708;;1027 : OOB (365)", ["1708", "", "1027"]),
    ("[ 1 | 2 |  | 3 ]", ["1", "2", "", "3"]),
    ('"a ""b"" c"\t"d \\"e\\""\t\'f, g\'', ['a "b" c', 'd "e"', "f, g"]),
    ("1 ,2 ,3 ,", ["1", "2", "3"]),
    ("1，2，，3", ["1", "2", "", "3"]),
    ("1\xa02\xa0 3", ["1", "2", "3"]),
    ("1\x01\x012", ["1", "", "2"]),
    ('"1,526,601"', []),
    ("0.16", []),
    ("", []),
    ("   ", []),
    (None, []),
    (";;;", []),
    ("RANK1: 5", []),
    ("RANK1: : OOB (3)", []),
    ('"" ""', ["", ""]),
    ("'x'\"y\"", ["x", "y"]),
    ("1 2" + " " * 5000, ["1", "2"]),
    ("7 " * 30000, ["7"] * 30000),
    ('"' + "q, " * 20000 + '"; 5', ["q, " * 20000, "5"]),
    (" 1  2", ["1", "2"]),
    ("<1, 2>", ["1", "2"]),
    ("(1, 2] 3", ["1", "2", "", "3"][:0] or ["1", "2", "3"]),
]


def test_cases(spark):
    assert run(spark, [c for c, _ in CASES]) == [v for _, v in CASES]


def test_like_the_scanner(spark):
    rng = random.Random(3)
    words = ["1", "-2.5", "nan", "4e-01", "left28", '"a b"', "'c;d'", '"e ""f"" g"', '"h \\"i\\" j"', '"k\'s"', '""']
    gaps = [" ", "  ", ", ", ",", ";", "; ", "|", " | ", "^", "/", "\t", "\xa0", "\x01", "，", " ,", ";;", "| |", ", ,"]
    texts = []
    for _ in range(600):
        n = rng.randint(1, 12)
        one = rng.choice(gaps)
        body = rng.choice(words)
        for _ in range(n - 1):
            body += (one if rng.random() < 0.8 else rng.choice(gaps)) + rng.choice(words)
        body += rng.choice(["", " ", "  ", one])
        wrap = rng.choice(["%s"] * 4 + ["[%s]", "( %s )", "{%s }", "< %s>", "RANK3_R1: %s : OOB (12)", "  %s"])
        texts.append(wrap % body)
    assert run(spark, texts) == [scan(t) for t in texts]


def test_by_shuffle_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(packed_fields, "MAX_BROADCAST_SKELETONS", 0)
    assert run(spark, ["1;2", "3|4"]) == [["1", "2"], ["3", "4"]]


def test_records_loaded_twice_and_other_columns(spark):
    rows = [(1, "1;2", "x"), (1, "1;2", "y"), (2, None, "x"), (3, "5", "z"), (None, "8 9", "n"), (None, "8 9", "m")]
    df = spark.createDataFrame(rows, "log_id bigint, stat_value string, val string").withColumnRenamed("val", "pos")
    got = sorted(packed_perflog(df).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 0, "1"), (1, 1, "2"), (None, 0, "8"), (None, 1, "9")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "log_id bigint, stat_value string")
    assert packed_perflog(df).count() == 0


def test_clash_is_refused(spark):
    df = spark.createDataFrame([(1, "1 2")], "pos int, v string")
    with pytest.raises(ValueError):
        explode_packed(df, "v", ["pos"])
