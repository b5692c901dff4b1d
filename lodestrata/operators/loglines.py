"""Semi-structured log lines into entries with timestamp, level, component and message.

Record starts are found by header expressions, line by line, without a shuffle; the ordered cascade of patterns with
named fields is applied there, too, with one match per header that yields all its fields. Continuation lines are
then grouped cumulatively: within a block of consecutive lines of a file the header lines part the entries. A file may
hold a third of all lines, so the group is (file, block), not the file; what stands ahead of a block's first header is a
loose end, and only it and the last entry of each block, at most two rows for 20,000 lines, are gathered by file to be tied together.

All expressions are built-in ones, so no line passes through Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 20_000

# Spellings of levels.
LEVELS = {
    "DEBUG": ("d", "dbg", "debug", "trace", "trc", "verbose"),
    "INFO": ("i", "inf", "info", "information", "notice"),
    "WARN": ("w", "wrn", "warn", "warning"),
    "ERROR": ("e", "err", "error"),
    "FATAL": ("f", "ftl", "fatal", "crit", "critical", "c", "panic", "emerg", "alert"),
}

# Month names as loggers abbreviate them.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_LEVEL_WORDS = "|".join(sorted((w for ws in LEVELS.values() for w in ws), key=lambda w: (-len(w), w)))
_NAME = r"[\w.:/-]+"

#: The ordered cascade: layout -> pattern of the header of an entry. Groups are named date, time, frac,
#: zone, level and component where the layout has them; the rest of the line is the message.
LAYOUTS: dict[str, str] = {
    # {"time": 1766872802753, "lvl": "Error", "logger": "llm.agent", "msg": "..."}, keys in any order
    "json": r'^\{(?=.*"(?:lvl|level|severity)"\s*:).*"msg"\s*:.*\}$',
    # ts=2025-09-17T22:00:40.445+08:00 level=info component=llm.retry msg="..."
    "pairs": r"^(?:ts|time|level)=\S+ (?=.*\bmsg=)",
    # 2025-12-31 23:41:50,712 - component - WARNING - ...
    "dashed": r"^(?<date>\d{4}-\d\d-\d\d)[ T](?<time>\d\d:\d\d:\d\d)[,.](?<frac>\d+) - (?<component>[^ ]+) - (?<level>[A-Za-z]+) - ",
    # [2025-12-13T00:00:29.840Z] [INFO] [component] ...
    "bracketed": r"^\[(?<date>\d{4}-\d\d-\d\d)[T ](?<time>\d\d:\d\d:\d\d)(?:[.,](?<frac>\d+))?(?<zone>Z|[+-]\d\d:?\d\d)?\] \[(?<level>[A-Za-z]+)\] \[(?<component>[^\]]+)\] ?",
    # [2025-10-09T21:22:34Z INFO  rust_ast::emit] ...
    "enclosed": r"^\[(?<date>\d{4}-\d\d-\d\d)[T ](?<time>\d\d:\d\d:\d\d)(?:[.,](?<frac>\d+))?(?<zone>Z|[+-]\d\d:?\d\d)? (?<level>[A-Za-z]+) +(?<component>[^ \]]+)\] ?",
    # E0226 13:24:44.558522    1023 topo_order.cc:696] ...
    "prefixed": r"^(?<level>[DIWEFC])(?<month>\d\d)(?<day>\d\d) (?<time>\d\d:\d\d:\d\d)\.(?<frac>\d+) +\d+ (?<component>[^ \]]+?):\d+\] ?",
    # 01:36:05.873<TAB>WRN<TAB>registry<TAB>...
    "tabbed": r"^(?<time>\d\d:\d\d:\d\d)(?:[.,](?<frac>\d+))?\t(?<level>[A-Za-z]+)\t(?<component>[^\t]+)\t",
    # Dec 12 23:52:49 runner[1042]: <err> ...
    "system": r"^(?<month>" + "|".join(MONTHS) + r") +(?<day>\d{1,2}) (?<time>\d\d:\d\d:\d\d)(?:\.(?<frac>\d+))? (?<component>[^ \[:]+)(?:\[\d+\])?: <(?<level>[A-Za-z]+)> ?",
    # [mapping] warning: ...
    "tagged": r"^\[(?<component>" + _NAME + r")\] (?<level>(?i:" + _LEVEL_WORDS + r")): ?",
}


def clean_line(line: Column) -> Column:
    """The line without terminal control sequences, byte order mark and trailing carriage returns."""
    bare = F.regexp_replace(line, r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|^\x{FEFF}+", "")
    # Most lines hold none of these and are left as they are.
    bare = F.when(line.contains("\x1b") | line.startswith("\ufeff"), bare).otherwise(line)
    return F.when(bare.endswith("\r") | bare.endswith("\n"), F.regexp_replace(bare, r"[\r\n]+$", "")).otherwise(bare)


def layout_of(text: Column) -> Column:
    """The first layout of the cascade whose header the line shows, else null."""
    out = None
    for name, pattern in LAYOUTS.items():
        out = F.when(text.rlike(_plain(pattern)), name) if out is None else out.when(text.rlike(_plain(pattern)), name)
    # Most lines that open no entry start with a blank or a letter run that no layout allows.
    return F.when(text.rlike(r'^[\[{0-9A-Zlt]'), out)


def _plain(pattern: str) -> str:
    """Named groups as plain ones: Spark numbers groups."""
    return re.sub(r"\(\?<[a-z]+>", "(", pattern)


FIELDS = ("date", "time", "frac", "zone", "level", "component", "month", "day")
_BETWEEN = "\x1e\x1f"


def _fields(layout: str) -> str:
    """The replacement that turns a header into its fields, in order; fields that the layout lacks are empty."""
    opens = [m for m in re.finditer(r"\\.|\((?!\?)|\(\?<([a-z]+)>|\[(?:\\.|[^\]\\])*\]", LAYOUTS[layout]) if m.group().startswith("(")]
    places = {m.group(1): i for i, m in enumerate(opens, 1)}
    return "".join((f"${places[f]}" if f in places else "") + _BETWEEN for f in FIELDS)


def normal_level(word: Column) -> Column:
    """DEBUG, INFO, WARN, ERROR or FATAL; an unknown word stays, in capitals."""
    pairs = [x for level, ws in LEVELS.items() for w in ws for x in (F.lit(w), F.lit(level))]
    return F.coalesce(F.create_map(*pairs)[F.lower(word)], F.upper(word))


def _millis(frac: Column) -> Column:
    """Three digits: missing ones are zeros, further ones are dropped."""
    return F.rpad(F.substring(F.coalesce(frac, F.lit("")), 1, 3), 3, "0")


def _epoch(text: Column, per_second: int = 1000) -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmm`` of milliseconds since 1970, whatever the session's zone."""
    ms = text.try_cast("bigint")
    days = F.floor(ms / F.lit(86_400_000))
    rest = ms - days * F.lit(86_400_000)
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string"), F.lit(" "), _clock(rest))


def _clock(ms: Column) -> Column:
    ms = ms.cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("0") + F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def _shifted(date: Column, time: Column, frac: Column, zone: Column) -> Column:
    """The stamp in UTC; without an offset it is in UTC already."""
    minutes = (F.substring(F.translate(zone, ":", ""), 2, 2).try_cast("int") * 60 + F.substring(F.translate(zone, ":", ""), 4, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    secs = F.substring(time, 1, 2).try_cast("int") * 3600 + F.substring(time, 4, 2).try_cast("int") * 60 + F.substring(time, 7, 2).try_cast("int")
    ms = F.datediff(date.try_cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000 + (secs - minutes * 60).cast("bigint") * 1000 + _millis(frac).try_cast("bigint")
    plain = F.concat(date, F.lit(" "), time, F.lit("."), _millis(frac))
    return F.when(zone.rlike(r"^[+-]\d\d:?\d\d$"), _epoch(ms)).otherwise(plain)


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')


def _taken(text: Column, layout: Column, with_body: bool) -> Column:
    """The fields of a header and the rest of its line as one text: one match per header."""
    out = None
    for name in LAYOUTS:
        if name == "json":
            j = F.from_json(text, "time string, ts string, timestamp string, lvl string, level string, severity string, logger string, component string, name string, msg string")
            stamp = F.coalesce(j["time"], j["ts"], j["timestamp"])
            at = F.coalesce(_epoch(F.when(stamp.rlike(r"^\d{9,11}$"), F.concat(stamp, F.lit("000"))).otherwise(stamp)), F.lit(""))
            parts = [F.substring(at, 1, 10), F.substring(at, 12, 8), F.substring(at, 21, 3), F.lit(""), F.coalesce(j["lvl"], j["level"], j["severity"]), F.coalesce(j["logger"], j["component"], j["name"]), F.lit(""), F.lit(""), j["msg"] if with_body else F.lit("")]
            made = F.concat_ws(_BETWEEN, *[F.coalesce(x, F.lit("")) for x in parts])
        elif name == "pairs":
            bare = _unquoted(text)
            stamp = F.regexp_extract(bare, r"(?:^| )(?:ts|time)=(\S+)", 1)
            p = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:?\d\d)?$"
            at = F.when(stamp.rlike(p), F.regexp_replace(stamp, p, _BETWEEN.join(f"${i}" for i in (1, 2, 3, 4)))).otherwise(_BETWEEN * 3)
            level, component = F.regexp_extract(bare, r"(?:^| )level=(\S+)", 1), F.regexp_extract(bare, r"(?:^| )(?:component|logger)=(\S+)", 1)
            body = F.regexp_replace(F.regexp_extract(text, r'\bmsg="((?:[^"\\]|\\.)*)"', 1), r'\\(.)', "$1") if with_body else F.lit("")
            made = F.concat_ws(_BETWEEN, at, level, component, F.lit(""), F.lit(""), body)
        else:
            made = F.regexp_replace(text, _plain(LAYOUTS[name]), _fields(name))
        out = F.when(layout == name, made) if out is None else out.when(layout == name, made)
    return out


def parse_header(taken: Column, file_stamp: Column) -> dict[str, Column]:
    """logged_at, log_level, component and body of what ``_taken`` gives; ``file_stamp`` is YYYYMMDDHHMMSS of the run's begin.

    logged_at is '' for layouts without time. A missing year or date follows from the file's name: a run
    lasts less than a day, so a stamp belongs to the day the run began or to the next one.
    """
    parts = F.split(taken, _BETWEEN, len(FIELDS) + 1)
    g = {f: parts[i] for i, f in enumerate(FIELDS)}
    day = F.to_date(F.substring(file_stamp, 1, 8), "yyyyMMdd")
    began = F.concat_ws(":", F.substring(file_stamp, 9, 2), F.substring(file_stamp, 11, 2), F.substring(file_stamp, 13, 2))
    month = F.when(F.length(g["month"]) == 3, F.lpad(F.array_position(F.lit(list(MONTHS)), g["month"]).cast("string"), 2, "0")).otherwise(g["month"])
    md = F.concat(month, F.lit("-"), F.lpad(g["day"], 2, "0"))
    next_day = F.date_add(day, 1)
    year = F.when(F.date_format(next_day, "MM-dd") == md, F.year(next_day)).otherwise(F.year(day)).cast("string")
    on = F.when(g["time"] < began, next_day).otherwise(day)
    clock = F.concat(F.lit(" "), g["time"], F.lit("."), _millis(g["frac"]))
    at = F.when(g["time"] == "", "").when(g["date"] != "", _shifted(g["date"], g["time"], g["frac"], g["zone"])).when(g["month"] != "", F.concat(year, F.lit("-"), md, clock)).otherwise(F.concat(on.cast("string"), clock))
    return {"logged_at": F.coalesce(at, F.lit("")), "log_level": normal_level(g["level"]), "component": g["component"], "body": parts[len(FIELDS)]}


def log_entries(logs: DataFrame, block: int = BLOCK, with_message: bool = True) -> DataFrame:
    """(log_file, first_line, last_line, logged_at, log_level, component[, message]): one row per entry.

    A line that opens no entry belongs to the entry before it; lines ahead of a file's first entry belong to
    none; blank lines at the end of an entry don't count for last_line nor for the message. Lines shipped
    more than once count once (the first shipment). Rows without log_file or line_no have no place and are
    left out; a null line is a blank one. A file whose name tells no time yields '' where the date is needed.
    An empty table gives no rows; further columns are ignored.
    """
    text = clean_line(F.coalesce(F.col("line"), F.lit("")))
    rows = logs.where("log_file is not null and line_no is not null").select(
        "log_file", F.col("line_no").cast("int").alias("line_no"), F.floor(F.col("line_no") / block).cast("int").alias("block"), "shipped_at", text.alias("text")
    )
    rows = rows.withColumn("layout", layout_of(F.col("text")))
    filled = F.col("layout").isNotNull() | ~F.col("text").rlike(r"^[\s\x00-\x20]*$")
    rows = rows.select("log_file", "block", "line_no", "shipped_at", filled.alias("filled"), _taken(F.col("text"), F.col("layout"), with_message).alias("head"), *(["text"] if with_message else []))

    in_block = Window.partitionBy("log_file", "block").orderBy("line_no", F.col("shipped_at").asc_nulls_last())
    running, before, whole = in_block.rowsBetween(Window.unboundedPreceding, 0), in_block.rowsBetween(Window.unboundedPreceding, -1), in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("prior", F.lag("line_no").over(in_block)).where("prior is null or prior <> line_no")
    is_head = F.col("head").isNotNull()
    filled_line = F.when(F.col("filled"), F.col("line_no"))
    if with_message:
        rows = rows.withColumn("first_line", F.max(F.when(is_head, F.col("line_no"))).over(running))
        more = F.sort_array(F.collect_list(F.when(~is_head, F.struct("line_no", "text"))))
        parts = rows.groupBy("log_file", "block", "first_line").agg(F.max(filled_line).alias("last_line"), F.max("head").alias("head"), more.alias("more"))
        edge = F.col("first_line").isNull() | (F.col("first_line") == F.max("first_line").over(Window.partitionBy("log_file", "block")))
        parts = parts.withColumn("edge", edge)
    else:
        # An entry ends with the last filled line ahead of the next header, or of the block; a block's first line stands for a loose end.
        rows = rows.select("log_file", "block", "line_no", "shipped_at", "head", "prior", F.max(filled_line).over(before).alias("filled_before"), F.max(filled_line).over(whole).alias("filled_last"))
        kept = rows.where(is_head | F.col("prior").isNull())
        last = F.lead("line_no").over(in_block).isNull()
        parts = kept.select(
            "log_file", "block", F.when(is_head, F.col("line_no")).alias("first_line"), F.when(last, F.col("filled_last")).otherwise(F.lead("filled_before").over(in_block)).alias("last_line"), "head", (last | ~is_head).alias("edge")
        )

    # A loose end belongs to the last entry of an earlier block.
    so_far = Window.partitionBy("log_file").orderBy("block", F.col("first_line").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    edges = parts.where("edge").withColumn("owner", F.last("first_line", ignorenulls=True).over(so_far)).where("owner is not null")
    tied = edges.groupBy("log_file", F.col("owner").alias("first_line")).agg(F.max("last_line").alias("last_line"), F.max("head").alias("head"), *([F.flatten(F.sort_array(F.collect_list("more"))).alias("more")] if with_message else []))
    cols = ["log_file", "first_line", "last_line", "head", *(["more"] if with_message else [])]
    entries = parts.where("not edge").select(*cols).unionByName(tied.select(*cols))

    stamp = F.regexp_extract(F.col("log_file"), r"run-(\d{8})-(\d{6})", 0)
    stamp = F.when(stamp != "", F.translate(F.substring(stamp, 5, 15), "-", ""))
    h = parse_header(F.col("head"), stamp)
    out = ["log_file", "first_line", "last_line", *[h[c].alias(c) for c in ("logged_at", "log_level", "component")]]
    if with_message:
        lines = F.filter("more", lambda x: x["line_no"] <= F.col("last_line"))
        out.append(F.concat_ws("\n", h["body"], F.transform(lines, lambda x: x["text"])).alias("message"))
    return entries.select(*out)
