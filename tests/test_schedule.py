import random

import pytest

from lodestrata.operators import schedule as B

ROW = "grp string, pos int, cost int"


def items(seed, n=120):
    r = random.Random(seed)
    return [(r.choice("ab"), i, r.choice([0, 1, 3, 5, 9, 10, 11, 30])) for i in range(n)]


def fold(data, opens):
    out = {}
    for g in "ab":
        total, k, first = 0, 0, True
        for _, i, c in sorted((x for x in data if x[0] == g), key=lambda x: x[1]):
            if not first and opens(total, c):
                k, total = k + 1, 0
            first, total = False, total + c
            out[g, i] = k
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_folds(spark, seed):
    data = items(seed)
    df = spark.createDataFrame(data, ROW)
    got = {(x.grp, x.pos): x.batch for x in B.batch_by_chars(df, "grp", ["pos"], "cost", 10).collect()}
    assert got == fold(data, lambda t, c: t + c > 10)
    got = {(x.grp, x.pos): x.chunk for x in B.chunk_by_chars(df, "grp", ["pos"], "cost", 10).collect()}
    assert got == fold(data, lambda t, c: t + c > 10 or t >= 10)


def test_oversize_places(spark):
    for costs, want in [([99, 1, 1], [0, 1, 1]), ([1, 99, 1], [0, 1, 2]), ([1, 1, 99], [0, 0, 1]), ([5, 5, 0], [0, 0, 1])]:
        df = spark.createDataFrame([("g", i, c) for i, c in enumerate(costs)], ROW)
        assert [x.chunk for x in B.chunk_by_chars(df, "grp", ["pos"], "cost", 10).orderBy("pos").collect()] == want


def test_cycles_stay_together(spark):
    data = [("g", 1, 4, 7), ("g", 2, 4, None), ("g", 3, 4, 7), ("g", 4, 4, None)]
    df = spark.createDataFrame(data, "grp string, pos int, cost int, cyc int")
    got = {x.pos: x.batch for x in B.batch_with_cycles(df, "grp", ["pos"], "cost", "cyc", 10).collect()}
    assert got == {1: 0, 3: 0, 2: 1, 4: 1}


def test_file_batches(spark, rows):
    order = spark.createDataFrame([(f, i) for i, f in enumerate("abcde")], "file string, rank int")
    m = spark.createDataFrame([("b", "x"), ("d", "x"), ("nowhere", "x")], "file string, scc string")
    assert rows(B.file_batches(order, m)) == [(1, "a", None), (2, "b", "x"), (3, "d", "x"), (4, "c", None), (5, "e", None)]


def test_in_file_order(spark):
    s = [("p", "a", "a", 1), ("p", "b", "b", 2), ("p", "c", "c", 3), ("q", "d", "d", 1), ("q", "e", "e", 2), ("r", "f", "", 1), ("r", "g", "g", 2)]
    e = [("a", "b"), ("b", "c"), ("a", "e"), ("d", "e"), ("e", "d"), ("f", "g")]
    got = B.in_file_order(spark.createDataFrame(s, "path string, key string, name string, pos int"), spark.createDataFrame(e, "src string, dst string"))
    assert {x.key: x.place for x in got.collect()} == {"c": 0, "b": 1, "a": 2, "d": 0, "e": 1, "f": 0, "g": 1}


def test_small(spark, rows):
    assert rows(B.by_file(spark.createDataFrame([("a",), ("",), (None,)], "p string"), "p")) == [("<unknown>", 2), ("a", 1)]
    g = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "group int, m array<string>")
    assert rows(B.group_members(g, "m")) == [("a", 1), ("b", 2)]
    assert B.batch_by_chars(spark.createDataFrame([], ROW), "grp", ["pos"], "cost").collect() == []
