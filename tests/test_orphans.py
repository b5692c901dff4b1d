import random
from datetime import datetime, timedelta

import pytest

from lodestrata.operators.orphans import current_orphans, orphan_references, orphan_report
from lodestrata.operators.skew import heavy_keys

EDGE = "edge_id bigint, source string, target string, recorded_at timestamp_ntz, key string"
SYM = "symbol_id bigint, symbol_key string, name string, type string, file_path string, extracted_at timestamp_ntz, deleted_at timestamp_ntz, at string"
T0 = datetime(2026, 1, 1)


def norm(k):
    if k is None or not k.strip():
        return None
    a, b, c = k.split(":", 2)
    b = {"function": "functions", "functions": "functions"}.get(b.strip(" '").lower(), b)
    c = c.replace("\\", "/")
    return f"{a}:{b}:{c[2:] if c.startswith('./') else c}"


def brute(edges, symbols):
    out = set()
    for i, s, t, at, _ in edges:
        for side, k in (("source", s), ("target", t)):
            if norm(k) is None or at is None:
                continue
            live = any(norm(y[1]) == norm(k) and y[5] and y[5] <= at and (y[6] is None or at < y[6]) for y in symbols)
            if not live:
                out.add((i, side))
    return out


@pytest.mark.parametrize("seed,heavy_rows", [(1, 20), (2, 60), (1, 10_000), (3, 0)])
def test_random(spark, seed, heavy_rows):
    """The same however many keys count as heavy and are cut into slots."""
    r = random.Random(seed)
    keys = ["a:functions:x.c", "a:'Function':.\\x.c", "b:macros:y/z.h", "b:macros:./y/z.h", "c:functions:q.c", None, "", " "]
    when = lambda: r.choice([None] + [T0 + timedelta(hours=r.randint(0, 2000)) for _ in range(12)])
    symbols = []
    for i in range(30):
        k = r.choice(keys[:5])
        symbols.append((i, k, None, None, None, when(), when(), "x"))
    symbols += symbols[:5]
    edges = [(i, r.choice(keys), r.choice(keys), when(), "clash") for i in range(150)]
    edges += edges[:20]
    got = orphan_references(spark.createDataFrame(edges, EDGE), spark.createDataFrame(symbols, SYM), heavy_rows=heavy_rows)
    pairs = [(x.edge_id, x.side) for x in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(edges, symbols)


def test_hot_key(spark):
    """One key with all rows, most of them at one moment."""
    sym = [(i, "a:functions:x.c", None, None, None, T0 + timedelta(hours=2 * i), T0 + timedelta(hours=2 * i + 1), None) for i in range(200)]
    edges = [(i, "a:functions:x.c", None, T0 + timedelta(minutes=30 * (i % 900) if i % 3 else 60), None) for i in range(2000)]
    got = orphan_references(spark.createDataFrame(edges, EDGE), spark.createDataFrame(sym, SYM), heavy_rows=100)
    want = {i for i, _, _, at, _ in edges if at >= T0 + timedelta(hours=400) or int((at - T0).total_seconds() // 3600) % 2}
    assert {x.edge_id for x in got.collect()} == want


def test_heavy_keys(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k")
    assert set(heavy_keys(df, "k", 100)) == {"hot"} and heavy_keys(df.where("false"), "k") == {}


def test_bounds(spark, rows):
    sym = [(1, "a:functions:x.c", None, None, None, T0, T0 + timedelta(days=1), None)]
    at = [T0 - timedelta(microseconds=1), T0, T0 + timedelta(days=1) - timedelta(microseconds=1), T0 + timedelta(days=1)]
    edges = [(i, "a:functions:x.c", None, t, None) for i, t in enumerate(at)]
    got = orphan_references(spark.createDataFrame(edges, EDGE), spark.createDataFrame(sym, SYM))
    assert rows(got, "edge_id", "side") == [(0, "source"), (3, "source")]


def test_key_from_parts(spark, rows):
    sym = [(1, None, "a", "function", "./x.c", T0, None, None)]
    edges = [(1, "a:functions:x.c", "b:functions:x.c", T0, None)]
    assert rows(orphan_references(spark.createDataFrame(edges, EDGE), spark.createDataFrame(sym, SYM)), "edge_id", "side") == [(1, "target")]


def test_empty(spark, rows):
    none_e, none_s = spark.createDataFrame([], EDGE), spark.createDataFrame([], SYM)
    one = spark.createDataFrame([(1, "a:functions:x.c", " ", T0, None)], EDGE)
    assert rows(orphan_references(none_e, none_s)) == []
    assert rows(orphan_references(one, none_s), "edge_id", "side") == [(1, "source")]
    assert rows(orphan_report(one, none_s)) == [("source", "2026-01", 1, 1)]
    assert rows(current_orphans(one, none_s)) == [("a:functions:x.c", 1)]
    assert rows(current_orphans(none_e, none_s)) == []
