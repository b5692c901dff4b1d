from datetime import datetime

import pytest

from lodestrata.operators.loglines import log_entries

LOG = "log_file string, line_no int, line string, shipped_at timestamp_ntz, component string"
F1 = "run-20251231-235000-7.log"


def frame(spark, lines, name=F1):
    return spark.createDataFrame([(name, i, t, datetime(2026, 1, 1), "clash") for i, t in enumerate(lines, 1)], LOG)


LAYOUTS = [
    ('{"time": 1767225000123, "lvl": "Error", "logger": "llm.agent", "msg": "a: \\"lvl\\""}', "2025-12-31 23:50:00.123", "ERROR", "llm.agent", 'a: "lvl"'),
    ('{"lvl": "Information", "logger": "x", "time": 1767225000999, "msg": "m"}', "2025-12-31 23:50:00.999", "INFO", "x", "m"),
    ('ts=2026-01-01T07:55:00.445+08:00 level=warn component=llm.retry msg="level=info is \\"old\\"" took_ms=3', "2025-12-31 23:55:00.445", "WARN", "llm.retry", 'level=info is "old"'),
    ('level=fatal ts=2025-12-31T18:55:00.4-05:00 component=k msg="x"', "2025-12-31 23:55:00.400", "FATAL", "k", "x"),
    ("2025-12-31 23:51:00,712 - fill - CRITICAL - boom", "2025-12-31 23:51:00.712", "FATAL", "fill", "boom"),
    ("[2025-12-31T23:52:00.840Z] [INFO] [skeleton] hi", "2025-12-31 23:52:00.840", "INFO", "skeleton", "hi"),
    ("[2025-12-31T23:53:00Z \x1b[32mWARN\x1b[0m  rust_ast::emit] hi", "2025-12-31 23:53:00.000", "WARN", "rust_ast::emit", "hi"),
    ("E1231 23:54:44.558922    1023 topo.cc:696] hi", "2025-12-31 23:54:44.558", "ERROR", "topo.cc", "hi"),
    ("I0101 00:04:44.5    1023 topo.cc:696] hi", "2026-01-01 00:04:44.500", "INFO", "topo.cc", "hi"),
    ("23:59:05.873\tWRN\tregistry\thi there", "2025-12-31 23:59:05.873", "WARN", "registry", "hi there"),
    ("00:01:05.873\tFTL\tfile-scan\thi", "2026-01-01 00:01:05.873", "FATAL", "file-scan", "hi"),
    ("Jan  1 00:02:49 runner[1042]: <err> hi", "2026-01-01 00:02:49.000", "ERROR", "runner", "hi"),
    ("Dec 31 23:52:49 sandboxd[1042]: <crit> hi\r", "2025-12-31 23:52:49.000", "FATAL", "sandboxd", "hi"),
    ("[mapping] \x1b[33mwarning\x1b[0m: hi: there", "", "WARN", "mapping", "hi: there"),
]


@pytest.mark.parametrize("line,at,level,component,message", LAYOUTS)
def test_layouts(spark, line, at, level, component, message):
    r = log_entries(frame(spark, ["noise", line])).collect()
    assert [(x.first_line, x.last_line, x.logged_at, x.log_level, x.component, x.message) for x in r] == [(2, 2, at, level, component, message)]


LINES = ["﻿using config", "", "[a] info: one", "  more", "    | 2026-01-02 03:04:05,006 - b - INFO - quoted", "", "[b] error: two", "\r", " ", "[a] info: three", "{", '  "name": 1', "}"]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_blocks(spark, block):
    """Entries come out the same however the file is cut into blocks."""
    df = frame(spark, LINES)
    df = df.unionByName(df.where("line_no % 2 = 0"))
    r = sorted((x.first_line, x.last_line, x.component, x.message) for x in log_entries(df, block=block).collect())
    assert r == [(3, 5, "a", "one\n  more\n" + LINES[4]), (7, 7, "b", "two"), (10, 13, "a", 'three\n{\n  "name": 1\n}')]
    bare = sorted((x.first_line, x.last_line) for x in log_entries(df, block=block, with_message=False).collect())
    assert bare == [(3, 5), (7, 7), (10, 13)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, "[a] info: x", None, None), (F1, None, "[a] info: x", None, None), (F1, 1, None, None, None), ("other.log", 1, "10:00:00.5\tINF\tx\ty", None, None)], LOG)
    r = log_entries(df).collect()
    assert [(x.log_file, x.logged_at, x.component) for x in r] == [("other.log", "", "x")]
    assert log_entries(spark.createDataFrame([], LOG)).collect() == []


def test_no_header(spark):
    assert log_entries(frame(spark, ["a", "b"])).collect() == []
    long = "[a] info: " + "x" * 200_000
    assert len(log_entries(frame(spark, [long])).first().message) == 200_000
