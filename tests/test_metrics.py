import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import metrics as M
from lodestrata.operators import reports as R


def brute(text):
    total = unsafe = inline = depth = 0
    armed = False
    for line in re.split(r"\r\n|\r|\n", text):
        line = re.sub(r"//.*|/\*.*?\*/", "", line)
        line = re.sub(r"'(?:\\'|.)*?'", "''", re.sub(r'"(?:\\"|.)*?"', '""', line)).strip()
        if not line:
            continue
        total += 1
        if re.search(r"\bunsafe\b", line) and depth == 0:
            armed = True
        opened = False
        for c in line:
            if c == "{" and armed:
                depth, armed, opened = 1, False, True
            elif c == "{" and depth:
                depth += 1
            elif c == "}" and depth:
                depth -= 1
        unsafe += depth > 0
        inline += opened and depth == 0
    return total, unsafe, inline


def test_unsafe_fold(spark):
    r = random.Random(5)
    parts = ["unsafe", "{", "}", "fn f()", "\n", "\n", "// {", "\"{\"", "x;", "unsafe {", "/* } */", "\r\n"]
    texts = [" ".join(r.choice(parts) for _ in range(40)) for _ in range(40)] + ["", "unsafe { x }", "unsafe {\n x\n}\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {x.id: (x.total_lines, x.unsafe_lines, x.inline_unsafe) for x in M.safety_by_file(df, "id", "t").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_report(spark):
    df = spark.createDataFrame([("a", "let x: Vec<u8> = &y;\nunsafe {\n *p;\n}"), ("b", ""), ("c", None)], "f string, t string")
    rep = {x.f: x for x in M.safety_report(M.safety_by_file(df, "f", "t"), "f").collect()}
    assert set(rep) == {"a", "b", "Overall"}
    assert (rep["a"].total_lines, rep["a"].unsafe_lines, rep["a"].safe_refs) == (4, 2, 2)
    assert rep["b"].safe_line_share == 0.0 and rep["b"].safe_ref_share == 1.0 and rep["Overall"].safe_line_share == 0.5


@pytest.mark.parametrize("v,want", [(0.42595, "42.59%"), (1.0, "100.00%"), (None, None), (0.9844, "98.44%")])
def test_percent(spark, v, want):
    assert spark.createDataFrame([(v,)], "x double").select(R.percent_text(F.col("x"))).first()[0] == want


def test_reports(spark, rows):
    df = spark.createDataFrame([("b", 1), ("a", 0), ("b", 0)], "g string, ok int")
    r = R.pass_rates(df, "g", F.col("ok") == 1)
    assert [tuple(x) for x in R.overall_last(r, "g").collect()] == [("a", 0, 1, 0.0), ("b", 1, 2, 0.5), ("Overall", 1, 3, 1 / 3)]
    d = spark.createDataFrame([("57.75%", "97.6%"), ("1%", "1%")], "a string, b string")
    from lodestrata.functions.text import percent_value as p

    assert [x[0] for x in d.select(R.improvement(p(F.col("a")), p(F.col("b")))).collect()] == ["+39.8", "+0.0"]
    t = spark.createDataFrame([("3",), ("4.9",), ("x",), (None,)], "v string")
    assert [x[0] for x in t.select(R.tolerant_number(F.col("v"))).collect()] == [3, 4, None, None]
    two = R.united({"m2": df.limit(1), "m1": df.limit(1).withColumn("more", F.lit(1))})
    assert sorted(x.Method for x in two.collect()) == ["m1", "m2"] and "more" in two.columns
    assert rows(R.unweighted_mean(spark.createDataFrame([(52.76,), (32.43,)], "x double"), ["x"]))[0][0] == pytest.approx(42.595)
    g = R.merged_groups(spark.createDataFrame([("hash_a", 1), ("hash_b", 2), ("lib", 4), ("x_y", 8)], "k string, n int"), "k", [(F.col("k").startswith("hash_"), "hash-functions")], ["lib"], ["n"])
    assert rows(g, "k", "place", "n") == [("Overall", 1, 15), ("hash-functions", 2, 3), ("x-y", 0, 8)]
