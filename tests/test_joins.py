import random

from pyspark.sql import functions as F

from lodestrata.operators import joins as J


def test_ranked(spark, rows):
    reg = [("f", "f:functions:a/x.c", "functions", "a/x.c", 1), ("f", "f:functions:a/x.h", "functions", "a/x.h", 2), ("f", "f:macros:test/x.h", "macros", "test/x.h", 3), ("f", "f:functions:b/q/x.h", "functions", "b/q/x.h", 4), ("g", "g:variables:z.c", "variables", "z.c", 5)]
    registry = spark.createDataFrame(reg, "name string, key string, type string, path string, reg_order int")
    uses = [
        (1, "f", "s", "a/x.c", "function_call"),  # same file
        (2, "f", "s", "b/x.c", "function_call"),  # no sibling: longest suffix, first registered of equals
        (3, "f", "s", "test/y.c", "macro_use"),  # a test file may use test files
        (4, "f", "s", "c/q/x.h", "function_call"),  # longest common suffix
        (5, "g", "s", "y.c", "function_call"),  # no type fits: the filter is dropped
        (6, "h", "s", "y.c", "function_call"),  # unknown
        (7, "f", "f:functions:a/x.c", "a/x.c", "function_call"),  # itself
        (8, "f", "s", "b/q/x.c", "function_call"),  # sibling header
    ]
    got = rows(J.ranked_resolution(spark.createDataFrame(uses, "use_id int, name string, src string, path string, dep_type string"), registry))
    assert got == [(1, "f:functions:a/x.c"), (2, "f:functions:a/x.c"), (3, "f:macros:test/x.h"), (4, "f:functions:b/q/x.h"), (5, "g:variables:z.c"), (8, "f:functions:b/q/x.h")]


def spans(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randint(1, 40)
        out.append((i, r.choice("pq"), r.choice(["functions", "structs", "typedefs", "macros"]), a, a + r.choice([0, 0, 1, 2, 5, 20])))
    return out


def test_outermost(spark):
    els = spans(3)
    got = {x.id for x in J.outermost(spark.createDataFrame(els, "id int, path string, type string, start_line int, end_line int")).collect()}

    def inside(a):
        return any(b[1] == a[1] and b[3] <= a[3] and b[4] >= a[4] and (b[3], b[4]) != (a[3], a[4]) and not (a[2] == "structs" and b[2] in ("structs", "typedefs")) for b in els)

    assert got == {a[0] for a in els if not inside(a)}


def test_enclosing(spark):
    els = [(p, f"k{i}", a, b) for i, p, _, a, b in spans(4)]
    points = [(i, "p" if i % 2 else "q", i % 45) for i in range(90)]
    got = {x.point_id: x.key for x in J.enclosing(spark.createDataFrame(points, "point_id int, path string, line int"), spark.createDataFrame(els, "path string, key string, start_line int, end_line int"), bucket=4).collect()}
    want = {}
    for i, p, line in points:
        for shift in (0, 1):
            c = [(b - a, a, k) for q, k, a, b in els if q == p and a <= line + shift <= b]
            if c:
                want[i] = min(c)[2]
                break
    assert got == want


def test_preceding_notes(spark, rows):
    notes = [("a", 1, 2, "far"), ("a", 10, 10, "one"), ("a", 12, 13, "two"), ("a", 30, 31, "late"), ("b", 10, 10, "other")]
    targets = [(1, "a", 14), (2, "a", 17), (3, "a", 32), (4, "a", 31), (5, "b", 11)]
    got = rows(J.preceding_notes(spark.createDataFrame(targets, "target_id int, path string, start_line int"), spark.createDataFrame(notes, "path string, start_line int, end_line int, text string")))
    assert got == [(1, "one two"), (3, "late"), (5, "other")]


def test_as_of(spark, rows):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, at int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 3, 2.0), ("b", 10, 3.0)], "k string, at int, v double")
    assert rows(J.as_of(left, right, ["k"], "at", "v"), "id", "v") == [(1, 1.0), (2, None), (3, None)]


def test_lookup(spark, rows):
    m = spark.createDataFrame([("f", "b.c", "t1"), ("f", "a.c", "t2"), ("g", None, "t3")], "name string, path string, target string")
    left = spark.createDataFrame([("f", "b.c"), ("f", "z.c"), ("g", "z.c"), ("h", "z.c")], "name string, path string")
    assert rows(J.coalesced_lookup(left, m), "name", "path", "target") == [("f", "b.c", "t1"), ("f", "z.c", "t2"), ("g", "z.c", "t3"), ("h", "z.c", None)]


def test_snippets(spark, rows):
    texts = spark.createDataFrame([("a", ["1", "2", "3"])], "path string, lines array<string>")
    s = spark.createDataFrame([(1, "a", 2, 2), (2, "a", 1, 9), (3, "a", 9, 9), (4, "a", 2, None)], "span_id int, path string, start_line int, end_line int")
    assert rows(J.snippets(s, texts)) == [(1, "2"), (2, "1\n2\n3"), (4, "2")]
    assert rows(J.snippets(s, texts, 1).where(F.col("span_id") == 1)) == [(1, "1\n2\n3")]


def test_groups(spark, rows):
    e = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "a")], "dest string, source string")
    c = spark.createDataFrame([("d", "a"), ("e", "a")], "dest string, source string")
    assert rows(J.complete_groups(e, c)) == [("e",)]
    links = J.batch_links(spark.createDataFrame([("x", "y"), ("x", "z")], "src string, dst string"), spark.createDataFrame([("x", 1), ("y", 2), ("z", 1)], "key string, batch int"))
    assert rows(links) == [(1, 2)]
