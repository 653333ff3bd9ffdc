"""Several values packed in one field: one row per value, with the value's place kept.

Every field is reduced to its delimiter skeleton: quoted pieces and runs of ordinary characters become masks,
only what separates them stays, and each way of separating is named once. There are few skeletons however
long the fields are, so a splitting rule is resolved once per distinct skeleton and broadcast (behind a check
of its size; beyond that the rules are joined by a shuffle). The rule then says how each field is cut, and
the values come out by position. All of it runs as JVM expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.config import materialize

_BLANK = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PLAIN = r"0-9A-Za-z_+\-.\p{L}\p{Nd}"
#: White space, the same in every engine.
WS = f"[{_BLANK}]"
#: What an unquoted value consists of.
WORD = f"[{_PLAIN}]"
#: A separator that is neither white space nor a quote.
SEP = rf"[^{_PLAIN}{_BLANK}\"']"
QUOTED = r'"[^"\\]*+(?:(?:\\[\s\S]|"")[^"\\]*+)*+"' "|" r"'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+'"

LABEL = rf"^{WS}*[\p{{L}}_]{WORD}*{WS}*:"
# possessive, and begun only where white space begins, so that long fields stay linear
NOTE = rf"(?<!{WS}){WS}*+:?{WS}*+OOB{WS}*+\([^()]*+\){WS}*+$"
OPEN = rf"^{WS}*[\[({{<]"
CLOSE = rf"[\])}}>]{WS}*+$"

#: Masks in a skeleton. They are private characters; the same characters in the data are taken for separators.
_QUOTE_MASK, _WORD_MASK, _OTHER = map(chr, (0xE000, 0xE001, 0xE002))
_MASKS = _QUOTE_MASK + _WORD_MASK

MAX_BROADCAST_SKELETONS = 200_000
MAX_BROADCAST_CHARS = 32_000_000


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def skeleton(text: Column) -> Column:
    """The delimiter skeleton of a field: head, tail, the distinct ways of separating in order, and the masks used.

    Null for null. The length is bounded by the number of different separators, not by the number of values.
    """
    # few fields need the first two looks at all
    safe = F.when(text.contains(_QUOTE_MASK) | text.contains(_WORD_MASK), F.translate(text, _MASKS, _OTHER * 2)).otherwise(text)
    unquoted = _bound(safe, lambda t: F.when(t.contains('"') | t.contains("'"), F.regexp_replace(t, QUOTED, _QUOTE_MASK)).otherwise(t))
    masked = F.regexp_replace(F.regexp_replace(unquoted, f"{WORD}+", _WORD_MASK), f"{WS}+", " ")
    noted = text.contains("OOB") & text.rlike(NOTE)
    return F.when(text.isNotNull(), _bound(masked, lambda m: _named(m, noted)))


def _named(masked: Column, noted: Column) -> Column:
    label = F.when(masked.contains(":"), F.regexp_extract(masked, f"^ ?{_WORD_MASK} ?:", 0)).otherwise("")
    note = F.when(noted, F.regexp_extract(masked, rf" ?:? ?{_WORD_MASK} ?\([^()]*\) ?$", 0)).otherwise("")

    def named(p: Column) -> Column:
        body = masked.substr(F.length(p["l"]) + 1, F.length(masked) - F.length(p["l"]) - F.length(p["n"]))
        # what stands before, between and after the masks
        return _bound(
            F.split(body, f"[{_MASKS}]"),
            lambda gaps: F.concat_ws(
                "\n",
                F.when(F.length(p["l"]) > 0, F.lit("L")).otherwise(""),
                F.when(F.length(p["n"]) > 0, F.lit("N")).otherwise(""),
                F.when(body.contains(_QUOTE_MASK), F.lit("q")).otherwise(""),
                gaps[0],
                F.when(F.size(gaps) > 1, F.element_at(gaps, -1)).otherwise(""),
                F.when(F.size(gaps) < 3, "").otherwise(F.concat(F.lit(_WORD_MASK), F.array_join(F.array_sort(F.array_distinct(F.slice(gaps, 2, F.greatest(F.size(gaps) - 2, F.lit(0))))), _WORD_MASK))),
            ),
        )

    return _bound(F.struct(label.alias("l"), note.alias("n")), named)


def rules(skeletons: DataFrame, column: str = "skeleton") -> DataFrame:
    """The splitting rule of every distinct skeleton.

    ``label``, ``note`` and ``bracket`` say what has to be cut off, ``head`` and ``tail`` whether other separators then stand
    before or after the values, ``how`` how the rest is split: 'one' (fewer than two values), 'blank' (white space alone
    separates), 'plain' (no quotes) or 'quoted'.
    """
    part = F.split(F.col(column), "\n")
    head, tail, gaps = F.trim(part[3]), F.trim(part[4]), F.split(F.substring(part[5], 2, 1 << 30), _WORD_MASK)
    pair = F.concat(F.substring(head, 1, 1), F.reverse(tail).substr(1, 1))
    bracket = pair.isin("[]", "()", "{}", "<>")
    return skeletons.select(
        F.col(column),
        (part[0] == "L").alias("label"),
        (part[1] == "N").alias("note"),
        bracket.alias("bracket"),
        F.when(bracket, F.length(F.ltrim(part[3])) > 1).otherwise(F.length(part[3]) > 0).alias("head"),
        F.when(bracket, F.length(F.rtrim(part[4])) > 1).otherwise(F.length(part[4]) > 0).alias("tail"),
        F.when(part[5] == "", "one")
        .when(part[2] == "q", "quoted")
        .when(F.forall(gaps, lambda g: g == " "), "blank")
        .otherwise("plain")
        .alias("how"),
    )


def _unquote(value: Column) -> Column:
    inner = value.substr(F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))
    return (
        F.when(value.startswith('"'), F.regexp_replace(inner, r'\\"|""', '"'))
        .when(value.startswith("'"), F.regexp_replace(inner, r"\\'|''", "'"))
        .otherwise(value)
    )


def split_by_rule(text: Column, rule: Column) -> Column:
    """The values of a field in order, by the rule of its skeleton (a struct); an empty array where there are fewer than two."""
    how = rule["how"]

    def cut(given: Column, when: Column, *patterns: str) -> Column:
        return _bound(given, lambda t: F.when(when, reduce(lambda x, pattern: F.regexp_replace(x, pattern, ""), patterns, t)).otherwise(t))

    body = cut(text, rule["note"], NOTE)
    body = cut(body, rule["label"], LABEL)
    body = cut(body, rule["bracket"], OPEN, CLOSE)
    # separators at the end give no place; one may stand before the first value
    body = cut(body, rule["tail"], rf"(?<=[{_PLAIN}\"'])[^{_PLAIN}\"']++$")
    body = cut(body, rule["head"], f"^{WS}*(?:{SEP}{WS}*)?")
    gap = f"{WS}*+{SEP}{WS}*+|{WS}++"
    # a quoted value may touch the next one; a quote that is never closed separates
    touch = rf"(?<=[{_PLAIN}\"'])(?=[{_PLAIN}\"'])"
    places = lambda t: F.regexp_extract_all(F.concat(t, F.lit("\n")), F.lit(rf"({QUOTED}|{WORD}+|)(?:{gap}|{touch}|[\"'])"), F.lit(1))
    return _bound(
        body,
        lambda t: F.when(how == "blank", F.split(t, f"{WS}+"))
        .when(how == "plain", F.split(t, gap))
        .when(how == "quoted", F.transform(places(t), _unquote))
        .otherwise(F.array().cast("array<string>")),
    )


def explode_packed(df: DataFrame, value_col: str, keep: Sequence[str], pos_name: str = "pos", val_name: str = "val") -> DataFrame:
    """One row per value of every field that packs two or more values: ``keep`` columns, place from 0, value.

    - Null, empty and blank fields, and fields with one value, give no row.
    - A place without a value between two separators gives ''. Separators at the end give none.
    - A quote that is never closed separates. Very long fields are handled as they are; nothing is cut.
    - Repeated rows come out repeatedly; an empty table gives an empty result.
    - Only ``keep`` comes out, so other columns may have any name, ``pos`` and ``val`` included.
    """
    names = {pos_name, val_name}
    if clash := names & set(keep):
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    base = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{value_col}`").cast("string").alias("text"))
    # one value without separators needs no rule; each text is masked once, and what is read twice is a table
    packed = materialize(base.filter(F.col("text").rlike(f"[^{_PLAIN}]")).withColumn("skeleton", skeleton(F.col("text"))))
    resolved = materialize(rules(packed.select("skeleton").distinct())).filter(F.col("how") != "one")
    size = resolved.agg(F.count("*").alias("n"), F.sum(F.length("skeleton")).alias("chars")).first()
    if size["n"] <= MAX_BROADCAST_SKELETONS and (size["chars"] or 0) <= MAX_BROADCAST_CHARS:
        resolved = F.broadcast(resolved)
    rule = F.struct(*[F.col(c) for c in resolved.columns if c != "skeleton"])
    cut = packed.join(resolved, "skeleton").select(*[F.col(f"k{i}") for i in range(len(keep))], split_by_rule(F.col("text"), rule).alias("vals"))
    return cut.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.posexplode("vals").alias(pos_name, val_name),
    )


def packed_perflog(perflog: DataFrame) -> DataFrame:
    """``explode_packed`` for performance-log records: log_id, pos, val. A record loaded twice counts once.

    Rows without a log_id are told apart by their field.
    """
    few = perflog.select("log_id", F.col("stat_value").cast("string").alias("stat_value")).filter(F.col("stat_value").isNotNull())
    few = few.withColumn("other", F.when(F.col("log_id").isNull(), F.col("stat_value")))
    once = few.groupBy("log_id", "other").agg(F.min("stat_value").alias("stat_value"))
    return explode_packed(once, "stat_value", ["log_id"])


PACKED_SQL = r"""
WITH once AS (
    SELECT log_id, min(stat_value) AS v FROM perflog WHERE stat_value IS NOT NULL GROUP BY log_id
), body AS (
    SELECT log_id,
        regexp_replace(regexp_replace(v, '\s*:?\s*OOB\s*\([^()]*\)\s*$', ''), '^\s*[A-Za-z_][A-Za-z0-9_+\-.]*\s*:', '') AS b
    FROM once
), bare AS (
    SELECT log_id, regexp_replace(regexp_replace(b, '^[\s\x{a0}]*[\[({<]', ''), '[\])}>][\s\x{a0}]*$', '') AS b FROM body
), ended AS (
    SELECT log_id, regexp_replace(regexp_replace(b, '[^A-Za-z0-9_+\-."'']+$', ''), '^[\s\x{a0}]+', '') || ' ' AS b FROM bare
), places AS (
    SELECT log_id, regexp_extract_all(b, '("(?:[^"\\]|\\.|"")*"|''(?:[^''\\]|\\.|'''')*''|[A-Za-z0-9_+\-.]+|)(?:[\s\x{a0}]*[^A-Za-z0-9_+\-.\s\x{a0}"''][\s\x{a0}]*|[\s\x{a0}]+)', 1) AS vals
    FROM ended
), many AS (
    SELECT log_id, vals FROM places WHERE len(list_filter(vals, lambda x: x <> '')) >= 2
), rows AS (
    SELECT log_id, unnest(range(len(vals))) AS pos, unnest(vals) AS raw FROM many
)
SELECT log_id, CAST(pos AS INTEGER) AS pos,
    CASE WHEN raw[1] = '"' THEN regexp_replace(raw[2:-2], '\\"|""', '"', 'g')
         WHEN raw[1] = '''' THEN regexp_replace(raw[2:-2], '\\''|''''', '''', 'g')
         ELSE raw END AS val
FROM rows
"""
