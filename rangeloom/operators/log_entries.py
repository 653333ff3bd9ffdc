"""Raw log lines of several programs into entries: timestamp, level, component and message.

A line starts an entry if its head is a stamp in one of the known layouts; the lines up to the next start or header
line belong to it. The grouping is cumulative per file, but a file may be most of the data, so files are cut into
blocks of lines, by which the texts are shuffled once. Within a block a window finds each line's start, and its entries are
grouped where they are; of each block only the entry that is open at its end and the lines before its first start are
merged with other blocks', by a second window over one row a block. The fields come from an ordered cascade of patterns, one
a layout; each cuts the head line into all its fields at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.config import materialize

BLOCK_LINES = 16_384
#: Up to so many blocks the row of each is broadcast to its entries; beyond that they are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 100_000

_COMP = r"[A-Za-z_][\w.\-]*"
_LEVEL = r"(?:[Tt][Rr][Aa][Cc][Ee]|[Dd][Ee][Bb][Uu][Gg]|[Dd][Bb][Gg]|[Ii][Nn][Ff][Oo]|[Ii][Nn][Ff][Oo][Rr][Mm][Aa][Tt][Ii][Oo][Nn]|[Nn][Oo][Tt][Ii][Cc][Ee]|[Ww][Aa][Rr][Nn](?:[Ii][Nn][Gg])?|[Ee][Rr][Rr](?:[Oo][Rr])?|[Ff][Aa][Tt][Aa][Ll]|[Cc][Rr][Ii][Tt](?:[Ii][Cc][Aa][Ll])?|[DIWEFC])"
_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?"

#: Layouts in the order in which they are tried. Groups are named: at (the stamp), zone, level, component, message.
LAYOUTS: dict[str, str] = {
    # 2023-03-01T00:14:40,226Z ERROR [bins] text, or [rtp] INFO - text
    "iso": rf"^(?<at>{_ISO}) ?(?<zone>Z|[+-]\d\d:?\d\d)?\s+(?:(?<level>{_LEVEL})\s+(?:\[(?<component>{_COMP})\]\s?)?|\[(?<component2>{_COMP})\]\s(?:(?<level2>{_LEVEL})\s+-\s)?)?(?<message>[\s\S]*)$",
    # [2023-03-01 00:57:08.096] -INFO- reader.probe: text, or !!! ERROR !!! rtp: text
    "bracket": rf"^\[(?<at>{_ISO}) ?(?<zone>Z|[+-]\d\d:?\d\d)?\]\s?(?:(?:-(?<level>{_LEVEL})-|!!! (?<level2>{_LEVEL}) !!!)\s?)?(?:(?<component>{_COMP}):\s)?(?<message>[\s\S]*)$",
    # W0301 01:06:25.338505  3027 bins] text
    "glog": rf"^(?<level>[DIWEFC])(?<at>\d{{4}} \d\d:\d\d:\d\d(?:\.\d{{1,9}})?)\s+\d+\s+(?<component>{_COMP})\]\s?(?<message>[\s\S]*)$",
    # Mar  1 00:40:54 cn-0015 bins[9803]: info: text, or <info> text
    "syslog": rf"^(?<at>[A-Z][a-z]{{2}} [ \d]\d \d\d:\d\d:\d\d(?:\.\d{{1,9}})?) \S+ (?<component>{_COMP})(?:\[\d+\])?:\s(?:<(?<level>{_LEVEL})>\s?|(?<level2>{_LEVEL}):\s)?(?<message>[\s\S]*)$",
    # ts=1677638612.482 lvl=E comp=monitor msg="text" rank=7, in any order
    "pairs": r"^(?=(?:[\s\S]*?\s)?ts=(?<at>-?\d+(?:\.\d+)?)(?:\s|$))(?:ts|lvl|level|severity|comp)=\S+\s(?<message>[\s\S]*)$",
    # {"time": "2023-03-01T00:57:10.502Z", "level": "info", "component": "bins", "message": "text"}, on one line or several
    "json": r'^\{\s*(?:"\w+"\s*:[\s\S]*)?$',
    # 8846, RENEG_COUNTS, 1 2 3 : the stamp counts from the opening of the file
    "perf": r'^\s*(?<at>\d+(?:\.\d+)?)\s*,\s*(?<quote>"?)(?<component>[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+)\k<quote>\s*(?:,(?<message>[\s\S]*))?$',
}
HEADER = r'^\s*"?[Tt]imestamp\s*\((?<unit>\w+)\)"?\s*,\s*"?[Ss]tat [Tt]ype"?\s*,\s*"?[Ss]tat [Vv]alue"?\s*$'


#: What stands between the fields of a cut head line; it occurs in none but the last, the message.
_GAP = "\x01"


def _cut(text: Column, layout: Column) -> Column:
    """The fields of a head line by its layout: at, zone, level, component, message. Shorter where the layout has none."""
    out = F.lit(None).cast("array<string>")
    for name, pattern in LAYOUTS.items():
        groups = set(re.findall(r"\(\?<([a-z]+2?)>", pattern))
        if "at" in groups:
            fields = [[g for g in (f, f"{f}2") if g in groups] for f in ("at", "zone", "level", "component", "message")]
            line = _GAP.join("".join(f"${{{g}}}" for g in f) for f in fields)
            out = F.when(layout == name, F.split(F.regexp_replace(text, pattern, line), _GAP, 5)).otherwise(out)
    return out


def layout_of(text: Column, following: Column) -> Column:
    """The layout in which a line starts an entry, 'header' for a header line, null for any other line.

    A brace alone starts a JSON entry if the line after it is indented and has a key. An indented or quoted stamp
    starts nothing: an entry quoted within another is part of that one.
    """
    quick = F.substring(text, 1, 1)
    json = text.rlike(r'^\{\s*"\w+"\s*:') | (text.rlike(r"^\{\s*$") & F.coalesce(following, F.lit("")).rlike(r'^\s+"\w+"\s*:'))
    case = F.when(quick.rlike(r"\d") & text.rlike(rf"^{_ISO} ?(?:Z|[+-]\d\d:?\d\d)?\s"), "iso")
    case = case.when((quick == "[") & text.rlike(rf"^\[{_ISO} ?(?:Z|[+-]\d\d:?\d\d)?\]"), "bracket")
    case = case.when((quick == "{") & json, "json")
    case = case.when(quick.rlike("[DIWEFC]") & text.rlike(LAYOUTS["glog"]), "glog")
    case = case.when(quick.rlike("[A-Z]") & text.rlike(LAYOUTS["syslog"]), "syslog")
    case = case.when(quick.rlike("[tlsc]") & text.rlike(LAYOUTS["pairs"]), "pairs")
    case = case.when(quick.rlike(r"[\d\s]") & text.rlike(LAYOUTS["perf"]), "perf")
    return case.when(text.rlike(HEADER), "header")


def level_of(word: Column) -> Column:
    """DEBUG, INFO, WARN, ERROR or FATAL whatever the spelling; NONE where no level is given."""
    first = F.upper(F.substring(word, 1, 1))
    return (
        F.when(first.isin("D", "T"), "DEBUG").when(first.isin("I", "N"), "INFO").when(first == "W", "WARN").when(first == "E", "ERROR").when(first.isin("F", "C"), "FATAL").otherwise("NONE")
    )


def _millis(stamp: Column, pattern_digits: Column, zone: Column) -> Column:
    """Milliseconds since 1970 of 'yyyy-MM-dd HH:mm:ss' plus a fraction's digits, cut off; the zone is UTC if empty."""
    minutes = F.when(zone.rlike(r"^[+-]"), (F.substring(zone, 2, 2).cast("int") * 60 + F.regexp_extract(zone, r"(\d\d)$", 1).cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    seconds = F.unix_seconds(F.concat(stamp, F.lit("Z")).try_cast("timestamp"))
    millis = F.rpad(F.substring(pattern_digits, 1, 3), 3, "0").cast("bigint")
    return seconds * 1000 - minutes.cast("bigint") * 60_000 + millis


def _decimal_millis(number: Column, digits: int) -> Column:
    """A decimal number shifted by ``digits`` places and cut off, without going through floating point."""
    whole, part = F.substring_index(number, ".", 1), F.when(number.contains("."), F.substring_index(number, ".", -1)).otherwise("")
    return F.concat(whole, F.rpad(F.substring(part, 1, digits), digits, "0")).try_cast("bigint") if digits else whole.try_cast("bigint")


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["text"]), "\n")


def _fragments(lines: DataFrame, messages: bool) -> DataFrame:
    """What each block holds of each entry, and of the lines before its first start (``start`` null), one row each.

    Columns: log_file, block, start, layout, n_lines, opened, unit, cut (fields of the head line), pairs, json (a JSON entry's text up
    to its closing brace), closed (whether that is there), more (the lines after it or after the head), loose (all lines, where start is null).
    """
    sent = lines.select("log_file", F.col("line_no").cast("bigint").alias("line_no"), F.coalesce("line_text", F.lit("")).alias("text"), "opened_ts")
    sent = sent.filter("log_file IS NOT NULL AND line_no IS NOT NULL")
    opened = F.unix_millis("opened_ts")
    # one row a line, and for the line before each block a copy of the block's first line, to look ahead
    block = F.floor(F.col("line_no") / BLOCK_LINES).cast("int")
    both = F.when(F.col("line_no") % BLOCK_LINES == 0, F.array(block, block - 1)).otherwise(F.array(block))
    once = (
        sent.select("log_file", F.explode(both).alias("block"), "line_no", "text", opened.alias("opened"))
        # by block at once, so that nothing below needs a second shuffle of the texts
        .repartition("log_file", "block")
        .groupBy("log_file", "block", "line_no")
        .agg(F.min("text").alias("text"), F.min("opened").alias("opened"))
    )
    in_block = Window.partitionBy("log_file", "block").orderBy("line_no")
    following = F.when(F.lead("line_no").over(in_block) == F.col("line_no") + 1, F.lead("text").over(in_block))
    marked = once.withColumn("following", following).filter(F.floor(F.col("line_no") / BLOCK_LINES) == F.col("block"))
    marked = marked.withColumn("layout", layout_of(F.col("text"), F.col("following"))).drop("following")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    unit = F.when(F.col("layout") == "header", F.struct("line_no", F.lower(F.regexp_extract("text", HEADER, 1)).alias("unit")))
    # JSON goes on until its closing brace
    closes = F.col("text").rlike(r"^\}") | (F.col("layout").eqNullSafe("json") & F.col("text").rlike(r"\}\s*$"))
    owned = marked.select(
        "log_file", "block", "line_no", "text", "opened", "layout",
        F.last(F.when(F.col("layout").isNotNull(), F.struct("line_no", "layout")), ignorenulls=True).over(upto).alias("owner"),
        F.last(unit, ignorenulls=True).over(upto)["unit"].alias("unit"),
        closes.alias("closes"),
    )
    is_head = F.col("line_no") == F.col("owner.line_no")
    line = F.struct("line_no", "text", "closes")
    collected = F.col("owner").isNull() | (F.col("owner.layout") == "json")
    if messages:
        collected = collected | ((F.col("owner.layout") != "header") & ~is_head)
    entry = owned.groupBy("log_file", "block", "owner").agg(
        F.count("*").cast("int").alias("n_lines"),
        F.max(F.when(is_head, F.struct("text", "unit", "opened"))).alias("head"),
        F.collect_list(F.when(collected, line)).alias("lines"),
    )
    layout, text = F.col("owner.layout"), F.col("head.text")
    named = entry.withColumn("json_lines", F.when(layout == "json", _until_closed(F.col("lines"))))
    more = F.when(layout == "json", F.filter("lines", lambda x: x["line_no"] > F.element_at("json_lines", -1)["line_no"])).when(F.col("owner").isNotNull(), F.col("lines"))
    pair = lambda names: F.when(layout == "pairs", F.regexp_extract(text, rf'(?:^|\s)(?:{names})=("[^"]*"|\S*)', 1))
    return named.select(
        "log_file", "block", F.col("owner.line_no").alias("start"), layout.alias("layout"), "n_lines", F.col("head.opened").alias("opened"), F.col("head.unit").alias("unit"),
        _cut(text, layout).alias("cut"),
        F.when(layout == "pairs", F.struct(pair("lvl|level|severity").alias("level"), pair("comp|component|src").alias("component"), pair("msg|message|text").alias("message"))).alias("pairs"),
        _joined(F.col("json_lines")).alias("json"),
        F.exists("json_lines", lambda x: x["closes"]).alias("closed"),
        (_joined(more) if messages else F.lit(None).cast("string")).alias("more"),
        F.when(F.col("owner").isNull(), F.array_sort("lines")).alias("loose"),
    )


def _until_closed(lines: Column) -> Column:
    """The lines in order up to the first that closes; all where none does."""
    first = F.array_min(F.transform(F.filter(lines, lambda x: x["closes"]), lambda x: x["line_no"]))
    return F.array_sort(F.filter(lines, lambda x: first.isNull() | (x["line_no"] <= first)))


def entries(lines: DataFrame, messages: bool = True) -> DataFrame:
    """Log entries from lines (log_file, line_no, line_text, opened_ts): log_file, line_no, n_lines, ts_ms, log_level, component, message.

    - A line shipped more than once counts once; line_no is the entry's first line, n_lines the number of its lines.
    - Lines before the first entry of a file, and header lines, belong to none.
    - Null line texts count as empty lines; lines without a file or number are left out.
    - Relative stamps are in the unit named by the last header above, else by any header of the file, else seconds where
      the file writes its stamps with a decimal point, else milliseconds. Without opened_ts their ts_ms is null, and a
      stamp without a year is null, too.
    - message is the entry's text without its head; further lines follow after line feeds. An entry's message is one value,
      however long. Without ``messages`` it is null, and only head lines and JSON texts are carried.
    - An empty table gives an empty result; other columns are ignored.
    """
    parts = materialize(_fragments(lines, messages))
    has_point = (F.col("layout") == "perf") & F.col("cut")[0].contains(".")
    is_header = F.col("layout") == "header"
    # one row a block: what it hands on, and what the file says of its unit
    blocks = parts.groupBy("log_file", "block").agg(
        F.max(F.when(F.col("start").isNotNull(), F.struct("start", "layout"))).alias("owner"),
        F.max(F.when(is_header, F.struct("start", "unit"))).alias("unit"),
        F.min(F.when(is_header, F.struct("start", "unit"))).alias("first_unit"),
        F.max(has_point).alias("decimal"),
    )
    before = Window.partitionBy("log_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("log_file")
    handed = materialize(blocks.select(
        "log_file", "block",
        F.col("owner.start").alias("last_start"),
        F.last("owner", ignorenulls=True).over(before).alias("owner"),
        F.coalesce(F.last("unit", ignorenulls=True).over(before), F.min("first_unit").over(whole))["unit"].alias("unit0"),
        F.max("decimal").over(whole).alias("decimal"),
    ))
    if handed.count() <= MAX_BROADCAST_BLOCKS:
        handed = F.broadcast(handed)
    known = parts.filter("start IS NOT NULL AND layout <> 'header'").drop("loose").join(handed.drop("owner"), ["log_file", "block"])
    unit = F.coalesce("unit", "unit0", F.when(F.col("decimal"), F.lit("s")).otherwise(F.lit("ms")))
    known = known.withColumn("unit", unit).drop("unit0", "decimal", "block")
    # the rest of entries that go on in other blocks
    loose = parts.filter("start IS NULL").select("log_file", "block", F.col("n_lines").alias("rest_lines"), "loose").join(handed, ["log_file", "block"])
    rest = loose.filter("owner IS NOT NULL AND owner.layout <> 'header'").groupBy("log_file", F.col("owner.start").alias("start"))
    rest = rest.agg(F.sum("rest_lines").cast("int").alias("rest_lines"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "loose"))), lambda x: x["loose"])).alias("loose"))
    at_end = F.col("start") == F.col("last_start")
    open_ = known.filter(at_end).join(rest, ["log_file", "start"], "left").withColumn("loose", F.coalesce("loose", F.array().cast(parts.schema["loose"].dataType)))
    in_json = (F.col("layout") == "json") & ~F.col("closed")
    added = F.when(in_json, _until_closed(F.col("loose"))).otherwise(F.array().cast(parts.schema["loose"].dataType))
    after = F.slice("loose", F.size("_json") + 1, F.greatest(F.size("loose") - F.size("_json"), F.lit(0)))
    line_feed = lambda a, b, some: F.when(F.size(some) > 0, F.concat_ws("\n", F.when(F.col(a) != "", F.col(a)) if a == "more" else F.col(a), b)).otherwise(F.col(a))
    closed = open_.withColumn("_json", added).withColumns(
        {
            "n_lines": F.col("n_lines") + F.coalesce("rest_lines", F.lit(0)),
            "json": line_feed("json", _joined(F.col("_json")), F.col("_json")),
            "more": line_feed("more", _joined(after), after) if messages else F.col("more"),
        }
    )
    return _fields(known.filter(~at_end).unionByName(closed.select(known.columns)))


def _fields(entry: DataFrame) -> DataFrame:
    layout, cut = F.col("layout"), lambda i: F.when(F.size("cut") == 5, F.col("cut")[i]).otherwise("")
    keys = F.from_json("json", "map<string,string>", {"allowUnquotedControlChars": "true"})
    named = entry.withColumn("keys", F.when(layout == "json", keys))
    key = lambda *names: F.coalesce(*[F.col("keys")[n] for n in names])
    is_json, is_pairs = layout == "json", layout == "pairs"
    raw = named.select(
        "log_file", "start", "n_lines", "layout", "unit", "opened", "more",
        F.when(is_json, key("time", "t", "ts", "timestamp")).otherwise(cut(0)).alias("at"),
        F.coalesce(F.when(is_json, F.regexp_extract(key("time", "timestamp"), r"(Z|[+-]\d\d:?\d\d)$", 1)).otherwise(cut(1)), F.lit("")).alias("zone"),
        F.when(is_json, key("level", "sev", "severity", "lvl")).when(is_pairs, F.replace(F.col("pairs.level"), F.lit('"'), F.lit(""))).otherwise(cut(2)).alias("level"),
        F.when(is_json, key("component", "src", "comp")).when(is_pairs, F.replace(F.col("pairs.component"), F.lit('"'), F.lit(""))).otherwise(cut(3)).alias("component"),
        F.when(is_json, key("message", "text", "msg")).when(is_pairs, F.regexp_replace("pairs.message", '^"|"$', "")).otherwise(cut(4)).alias("message"),
    )
    at, year = F.col("at"), F.date_format(F.timestamp_millis("opened"), "yyyy")
    fraction = F.when(at.contains(".") | at.contains(","), F.regexp_extract(at, r"[.,](\d+)", 1)).otherwise("")
    month = F.expr("lpad(cast(floor((instr('JanFebMarAprMayJunJulAugSepOctNovDec', substring(at, 1, 3)) + 2) / 3) as string), 2, '0')")
    clock = F.when(
        layout == "syslog", F.concat(year, F.lit("-"), month, F.lit("-"), F.translate(at.substr(5, 2), " ", "0"), F.lit(" "), at.substr(8, 8))
    ).when(layout == "glog", F.concat(year, F.lit("-"), at.substr(1, 2), F.lit("-"), at.substr(3, 2), F.lit(" "), at.substr(6, 8))).otherwise(F.concat(at.substr(1, 10), F.lit(" "), at.substr(12, 8)))
    absolute = _millis(clock, fraction, F.col("zone"))
    counted = F.col("opened") + F.when(F.col("unit").isin("s", "sec", "seconds"), _decimal_millis(at, 3)).when(F.col("unit").isin("us", "usec"), F.floor(_decimal_millis(at, 0) / 1000)).otherwise(_decimal_millis(at, 0))
    plain_number = at.rlike(r"^-?\d+(\.\d+)?$")
    since_epoch = F.when(is_pairs, _decimal_millis(at, 3)).when(plain_number & (F.length(F.substring_index(at, ".", 1)) >= 12), _decimal_millis(at, 0)).otherwise(_decimal_millis(at, 3))
    ts = F.when(layout == "perf", counted).when(is_pairs | (is_json & plain_number), since_epoch).otherwise(absolute)
    level = F.when(layout == "perf", F.lit("NONE")).otherwise(level_of(F.coalesce("level", F.lit(""))))
    message = F.concat_ws("\n", "message", F.when(F.col("more") != "", F.col("more")))
    return raw.select("log_file", F.col("start").cast("int").alias("line_no"), "n_lines", ts.alias("ts_ms"), level.alias("log_level"), F.coalesce("component", F.lit("")).alias("component"), message.alias("message"))


def found_entries(perflog_raw: DataFrame) -> DataFrame:
    """``entries`` without the message."""
    return entries(perflog_raw, messages=False).select("log_file", "line_no", "n_lines", "ts_ms", "log_level", "component")


def _sql(pattern: str, group: int = 0) -> str:
    """A pattern's group of a line in SQL; named groups and non-capturing ones are not counted."""
    return f"regexp_extract(t, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


def found_sql() -> str:
    """``found_entries`` in SQL, with other patterns: each field by one of its own."""
    level, comp = _LEVEL, _COMP
    iso, zone = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?", r"(?:Z|[+-]\d\d:?\d\d)"
    isohead, brackethead = rf"^{iso} ?{zone}?\s+", rf"^\[{iso} ?{zone}?\]\s?"
    bracketlevel = rf"(?:-{level}-|!!! {level} !!!)\s?"
    has = lambda pattern: f"regexp_matches(t, '{pattern}')"
    perf = rf"^\s*(\d+(?:\.\d+)?)\s*,\s*(?:\"([A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+)\"|([A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+))\s*(?:,|$)"
    glog = rf"^([DIWEFC])(\d{{4}} \d\d:\d\d:\d\d(?:\.\d{{1,9}})?)\s+\d+\s+({comp})\]"
    syslog = rf"^([A-Z][a-z]{{2}} [ \d]\d \d\d:\d\d:\d\d(?:\.\d{{1,9}})?) \S+ ({comp})(?:\[\d+\])?:\s"
    header = HEADER.replace("?<unit>", "")
    named = lambda keys: "coalesce(" + ", ".join(f"json_extract_string(j, '$.{k}')" for k in keys) + ")"
    pair = lambda keys: f"replace({_sql(rf'(?:^|\s)(?:{keys})=(\"[^\"]*\"|\S*)', 1)}, '\"', '')"
    clock = "epoch_ms(CAST(strptime(clock, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP))"
    return rf"""
WITH l AS (
    SELECT log_file, line_no, min(coalesce(line_text, '')) AS t, epoch_ms(min(opened_ts)) AS o FROM perflog_raw WHERE log_file IS NOT NULL AND line_no IS NOT NULL GROUP BY 1, 2
), ahead AS (
    SELECT *, CASE WHEN lead(line_no) OVER w = line_no + 1 THEN lead(t) OVER w ELSE '' END AS following FROM l WINDOW w AS (PARTITION BY log_file ORDER BY line_no)
), laid AS (
    SELECT *, CASE WHEN {has(rf"^{iso} ?{zone}?\s")} THEN 'iso' WHEN {has(rf"^\[{iso} ?{zone}?\]")} THEN 'bracket'
        WHEN {has(r'^\{\s*"\w+"\s*:')} OR ({has(r'^\{\s*$')} AND regexp_matches(following, '^\s+"\w+"\s*:')) THEN 'json'
        WHEN {has(glog)} THEN 'glog' WHEN {has(syslog)} THEN 'syslog'
        WHEN {has(r'(^|\s)ts=-?\d+(\.\d+)?(\s|$)')} AND {has(r'^(ts|lvl|level|severity|comp)=\S+\s')} THEN 'pairs'
        WHEN {has(perf)} THEN 'perf' WHEN {has(header)} THEN 'header' END AS lay FROM ahead
), owned AS (
    SELECT *, max(CASE WHEN lay IS NOT NULL THEN line_no END) OVER (PARTITION BY log_file ORDER BY line_no) AS owner,
        last_value(CASE WHEN lay = 'header' THEN lower({_sql(header, 1)}) END IGNORE NULLS) OVER (PARTITION BY log_file ORDER BY line_no) AS unit_above,
        first_value(CASE WHEN lay = 'header' THEN lower({_sql(header, 1)}) END IGNORE NULLS) OVER (PARTITION BY log_file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS unit_any,
        bool_or(lay = 'perf' AND contains({_sql(perf, 1)}, '.')) OVER (PARTITION BY log_file) AS pointed,
        {has(r'^\}')} OR (lay = 'json' AND {has(r'\}\s*$')}) AS closes FROM laid
), ends AS (
    SELECT *, min(CASE WHEN closes THEN line_no END) OVER (PARTITION BY log_file, owner) AS closed FROM owned
), entry AS (
    SELECT log_file, owner AS line_no, CAST(count(*) AS INTEGER) AS n_lines, max(CASE WHEN line_no = owner THEN lay END) AS lay, max(CASE WHEN line_no = owner THEN t END) AS t,
        max(CASE WHEN line_no = owner THEN o END) AS o, max(CASE WHEN line_no = owner THEN coalesce(unit_above, unit_any, CASE WHEN pointed THEN 's' ELSE 'ms' END) END) AS unit,
        string_agg(CASE WHEN line_no <= coalesce(closed, line_no) THEN t END, chr(10) ORDER BY line_no) AS j FROM ends WHERE owner IS NOT NULL GROUP BY 1, 2
), told AS (
    SELECT * REPLACE (CASE WHEN lay = 'json' AND json_valid(j) THEN j END AS j) FROM entry WHERE lay <> 'header'
), cut AS (
    SELECT *, CASE lay WHEN 'iso' THEN {_sql(rf"^({iso})", 1)} WHEN 'bracket' THEN {_sql(rf"^\[({iso})", 1)} WHEN 'glog' THEN {_sql(glog, 2)} WHEN 'syslog' THEN {_sql(syslog, 1)}
            WHEN 'pairs' THEN {_sql(r"(?:^|\s)ts=(-?\d+(?:\.\d+)?)(?:\s|$)", 1)} WHEN 'perf' THEN {_sql(perf, 1)} ELSE {named(("time", "t", "ts", "timestamp"))} END AS stamp,
        CASE lay WHEN 'iso' THEN {_sql(rf"^{iso} ?({zone})", 1)} WHEN 'bracket' THEN {_sql(rf"^\[{iso} ?({zone})\]", 1)} WHEN 'json' THEN coalesce(regexp_extract({named(("time", "timestamp"))}, '(Z|[+-]\d\d:?\d\d)$', 1), '') ELSE '' END AS zone,
        CASE lay WHEN 'iso' THEN coalesce(nullif({_sql(rf"{isohead}({level})\s", 1)}, ''), {_sql(rf"{isohead}\[{comp}\]\s({level})\s+-\s", 1)})
            WHEN 'bracket' THEN regexp_extract({_sql(rf"{brackethead}({bracketlevel})", 1)}, '[A-Za-z]+') WHEN 'glog' THEN {_sql(glog, 1)}
            WHEN 'syslog' THEN regexp_extract({_sql(rf"{syslog}(<{level}>|{level}:\s)", 3)}, '[A-Za-z]+') WHEN 'pairs' THEN {pair("lvl|level|severity")} WHEN 'perf' THEN '' ELSE {named(("level", "sev", "severity", "lvl"))} END AS level,
        CASE lay WHEN 'iso' THEN {_sql(rf"{isohead}(?:{level}\s+)?\[({comp})\]\s?", 1)} WHEN 'bracket' THEN {_sql(rf"{brackethead}(?:{bracketlevel})?({comp}):\s", 1)} WHEN 'glog' THEN {_sql(glog, 3)} WHEN 'syslog' THEN {_sql(syslog, 2)}
            WHEN 'pairs' THEN {pair("comp|component|src")} WHEN 'perf' THEN coalesce(nullif({_sql(perf, 2)}, ''), {_sql(perf, 3)}) ELSE {named(("component", "src", "comp"))} END AS component FROM told
), timed AS (
    SELECT *, strftime(make_timestamp(o * 1000), '%Y') AS y, regexp_extract(stamp, '[.,](\d+)', 1) AS fraction, regexp_matches(stamp, '^-?\d+(\.\d+)?$') AS is_number,
        split_part(stamp, '.', 1) AS whole, rpad(substr(split_part(stamp, '.', 2), 1, 3), 3, '0') AS thousandths FROM cut
), clocked AS (
    SELECT *, CASE lay WHEN 'syslog' THEN y || '-' || lpad(CAST((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', substr(stamp, 1, 3)) + 2) // 3 AS VARCHAR), 2, '0') || '-' || replace(substr(stamp, 5, 2), ' ', '0') || ' ' || substr(stamp, 8, 8)
        WHEN 'glog' THEN y || '-' || substr(stamp, 1, 2) || '-' || substr(stamp, 3, 2) || ' ' || substr(stamp, 6, 8) ELSE substr(stamp, 1, 10) || ' ' || substr(stamp, 12, 8) END AS clock FROM timed
)
SELECT log_file, CAST(line_no AS INTEGER) AS line_no, n_lines,
    CASE WHEN lay = 'perf' THEN o + CASE WHEN unit IN ('s', 'sec', 'seconds') THEN CAST(whole || thousandths AS BIGINT) WHEN unit IN ('us', 'usec') THEN CAST(whole AS BIGINT) // 1000 ELSE CAST(whole AS BIGINT) END
        WHEN lay = 'pairs' OR (lay = 'json' AND is_number AND length(whole) < 12) THEN CAST(whole || thousandths AS BIGINT) WHEN lay = 'json' AND is_number THEN CAST(whole AS BIGINT)
        ELSE {clock} + CAST(rpad(substr(fraction, 1, 3), 3, '0') AS BIGINT)
            - CASE WHEN zone LIKE '+%' OR zone LIKE '-%' THEN (CAST(substr(zone, 2, 2) AS BIGINT) * 60 + CAST(right(zone, 2) AS BIGINT)) * CASE WHEN zone LIKE '-%' THEN -60000 ELSE 60000 END ELSE 0 END END AS ts_ms,
    CASE upper(substr(level, 1, 1)) WHEN 'D' THEN 'DEBUG' WHEN 'T' THEN 'DEBUG' WHEN 'I' THEN 'INFO' WHEN 'N' THEN 'INFO' WHEN 'W' THEN 'WARN' WHEN 'E' THEN 'ERROR' WHEN 'F' THEN 'FATAL' WHEN 'C' THEN 'FATAL' ELSE 'NONE' END AS log_level,
    coalesce(component, '') AS component FROM clocked
"""
