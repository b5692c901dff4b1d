import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.operators import parse as X


def rows_of(spark, text, fields, fn=X.value_rows):
    return [tuple(r) for r in spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"), fields).alias("r")).first().r]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{ {"A",1}, {"B",2} }', [("A", 1), ("B", 2)]), ("{a, 1} {b} {c, x} {d, 2,}", [("a", 1), ("d", 2)]), ('{"a, b", 3}', [("a, b", 3)]), ("{'it', 4}", [("it", 4)]),
        ("", []), ("none", []), ("<think>{z, 1}</think>{a, -2}", [("a", -2)]), ("{a, 1.5}", []),
    ],
)
def test_value_rows(spark, text, want):
    assert rows_of(spark, text, {"foo": "str", "num": "int"}) == want


def test_three_columns(spark):
    f = {"name": "str", "age": "int", "score": "float"}
    assert rows_of(spark, "{Ann, 3, 1.5}, {Bob, x, 2}, {Cy, 4, 2}", f) == [("Ann", 3, 1.5), ("Cy", 4, 2.0)]
    got = rows_of(spark, '{"rows": [{"name": "Ann", "age": 3, "score": 1.5}, {"name": "B"}]}', f, lambda c, q: X.json_rows(c, "rows", q))
    assert got == [("Ann", 3, 1.5)]
    assert rows_of(spark, "no json", f, lambda c, q: X.json_rows(c, "rows", q)) == []


def test_renderings(spark):
    df = spark.createDataFrame([([("a", 1), ('b,"c', 2)],), ([],)], "r array<struct<foo:string,num:int>>")
    r = df.select(X.to_tsv(F.col("r"), ["foo", "num"]), X.to_csv(F.col("r"), ["foo", "num"]), X.to_markdown(F.col("r"), ["foo", "num"]), X.to_json_table(F.col("r"), "rows")).collect()
    assert tuple(r[0]) == ("foo\tnum\na\t1\nb,\"c\t2", 'foo,num\r\na,1\r\n"b,""c",2', '| foo | num |\n| --- | --- |\n| a | 1 |\n| b,"c | 2 |', '{"rows":[{"foo":"a","num":1},{"foo":"b,\\"c","num":2}]}')
    assert tuple(r[1]) == ("", "", "", '{"rows":[]}')


@pytest.mark.parametrize(
    "template,text,want",
    [
        ("label={x:json}suffix", 'label={"foo": "}", "bar": 1}suffix', {"x": {"foo": "}", "bar": 1}}),
        ("a={a:int}; b={b}.", "say a=x; a=3; b=hi. there.", {"a": 3, "b": "hi. there"}),
        ("f={f:bool}", "f=True", {"f": True}), ("f={f:bool}", "f=0", {"f": False}), ("f={f:bool}", "f=maybe", None),
        ("l={l:list[str]}", 'l=["A"]', {"l": ["A"]}), ("l={l:list[int]}", "l=[1, true]", None), ("d={d:dict}", "d={}", {"d": {}}), ("v={v:any}", "v=free text", {"v": "free text"}),
        ("c={c:str:regex=[A-Z]+}", "c=abc", None), ("c={c:str:regex=[A-Z]+}", "c=ABC", {"c": "ABC"}), ("b={b};a={a}", "a=1;b=2", None), ("x={x:int}", "nothing", None),
        ("l={l:list[int]}", "l=__import__('os')", None),
    ],
)
def test_templates(template, text, want):
    assert X.parse_template(text, template) == want


def test_parse_texts(spark, rows):
    df = spark.createDataFrame([(1, "<think>n=9</think>n=1"), (2, "x"), (3, None)], "id int, t string")
    assert rows(X.parse_texts(df, "id", "t", "n={n:int}")) == [(1, True, '{"n": 1}'), (2, False, None), (3, False, None)]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(max_size=8), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8))
def test_balanced_json(data):
    text = json.dumps({"k": data}, ensure_ascii=True).replace("'", "\\u0027")
    assert X.balanced(text + "} tail", 0) == len(text)


def test_code_spans():
    code = "use a::b;\n#[cfg(test)]\nuse c;\nfn foo(x: &str) -> i32 { if x == \"}\" { 1 } else { 2 } }\nfn bar() {}"
    a, b = X.function_span(code, "foo")
    assert code[a:b].endswith("else { 2 } }") and X.function_span(code, "nope") is None
    assert X.header_body_tail("fn f() { a } rest") == ("fn f() ", " a ", " rest") and X.header_body_tail("x") is None
    assert X.use_blocks(code) == ["use a::b;", "#[cfg(test)]\nuse c;"]


def test_segments(spark):
    df = spark.createDataFrame([(60, [(30, 50), (10, 40)]), (5, []), (0, []), (8, [(2, 20)])], "n int, s array<struct<start:int,end:int>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(X.segments(F.col("n"), F.col("s"))).collect()]
    assert got == [[(0, 10, True), (10, 40, False), (40, 50, False), (50, 60, True)], [(0, 5, True)], [], [(0, 2, True), (2, 8, False)]]


def test_diff(spark):
    d = {x.id: x["diff"] for x in X.unified_diff(spark.createDataFrame([(1, "a\nb", "a\nc"), (2, None, None)], "id int, x string, y string"), "id", "x", "y").collect()}
    assert "-b" in d[1] and "+c" in d[1] and d[2] == ""


def test_tools(spark, rows):
    tools = X.Tools()

    @tools.register
    def add(a: int, b: int = 2):
        return a + b

    assert tools.call("add", {"a": "3"}) == 5
    for bad in [("nope", {}), ("add", {}), ("add", {"a": 1, "z": 2})]:
        with pytest.raises(ValueError):
            tools.call(*bad)
    df = spark.createDataFrame([(1, '{"tool_call": {"name": "add", "args": {"a": 1}}}'), (2, "hi"), (3, '{"name": "zzz", "args": {}}')], "id int, t string")
    assert rows(tools.interpret(df, "id", "t")) == [(1, "add", "3"), (2, None, None), (3, "zzz", "error: unknown tool 'zzz'")]


def test_validated(spark):
    assert X.validate_text("a n=1; n=x; n=2.", "n={n:int}.") == ({"n": 2}, "n=2.", None)
    data, matched, reason = X.validate_text("n=1; n=x.", "n={n:int}.")
    assert data is None and matched == "n=x." and reason.startswith("n: ")
    assert X.validate_text("nothing", "n={n:int}.")[:2] == (None, None)
    df = spark.createDataFrame([(1, "n=3."), (2, None), (3, "<think>n=9.</think>n=y.")], "id int, t string")
    got = {x.id: x for x in X.validated_texts(df, "id", "t", "n={n:int}.").collect()}
    assert (got[1].success, got[1].data, got[1].matched) == (True, '{"n": 3}', "n=3.") and not got[2].success and (got[3].raw, got[3].matched) == ("n=y.", "n=y.")
