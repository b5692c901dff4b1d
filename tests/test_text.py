import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import predicates as P


def val(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in cols.items()))
    r = df.select(expr(*[F.col(n) for n in names]).alias("y")).first()[0]
    return r


@pytest.mark.parametrize(
    "fn,text,want",
    [
        (T.token_estimate, "", 1), (T.token_estimate, "abcd", 1), (T.token_estimate, "abcde", 2), (T.token_estimate, None, 1),
        (T.strip_comment_marks, "/** hi\n * you */", "hi\nyou"), (T.strip_comment_marks, "// hi", "hi"),
        (T.scrub_code, '  let s = "a{"; // {', 'let s = "";'), (T.scrub_code, "c = '{' /* x */ ;", "c = ''  ;"),
        (T.safe_ref_count, "&x &mut y &  mut z Vec<String>", 5), (T.safe_ref_count, "&mutable", 1),
        (T.unsafe_ref_count, "x: *mut T, y as *const U", 0), (T.raw_pointer_count, "x: *mut T, y as *const U", 2),
        (T.line_count, "", 0), (T.line_count, "a", 1), (T.line_count, "a\n", 1), (T.line_count, "a\r\nb\rc", 3), (T.line_count, "\n\n", 2),
        (T.function_name, "static int *foo_bar(int a);", "foo_bar"), (T.signature, "int f(void) { return 1; }", "int f(void)"),
        (T.typedef_name, "typedef void (*cb)(int);", "cb"), (T.typedef_name, "typedef struct { int a; } thing_t;", "thing_t"), (T.typedef_name, "typedef int arr[4];", "arr"),
        (T.include_name, '#include "a/b.h"', "a/b.h"), (T.include_name, "# include <stdio.h>", "stdio.h"),
        (T.strip_think, "<think>a\nb</think> x </THINK>", "x"), (T.strip_dots, "../x\\y", "x/y"), (T.strip_dots, ".hidden", "hidden"),
        (T.rust_path, "src/a.c", "src/a_c.rs"), (T.rust_path, "src/a.h", "src/a_h.rs"), (T.rust_path, "a.rs", "a.rs"), (T.module_name, "9-a.b", "m_9_a_b"),
        (T.percent_value, "12.34%", 12.34), (T.percent_value, "N/A", None), (T.canonical_json, '{"b": 1, "a": "x"}', '{"a":"x","b":"1"}'),
        (T.severity, "Warning", 2), (T.severity, "3", 3), (T.severity, "9", None), (T.severity, None, None),
    ],
)
def test_scalars(spark, fn, text, want):
    assert val(spark, fn, x=text) == want


def test_pairs(spark):
    assert val(spark, T.pair_encode, a="f", b="./x\\y.c") == "f|x/y.c"
    assert val(spark, T.pair_encode, a="f", b="") == "f"
    assert tuple(val(spark, T.pair_decode, a="f|x|y.c")) == ("f", "x|y.c")
    assert tuple(val(spark, T.pair_decode, a="f")) == ("f", None)


def test_similarity(spark):
    for a, b, n in [("a/b/c.c", "x/b/c.c", 2), ("a/c.c", "a/d.c", 0), ("c.c", "c.c", 1), ("x/c.c", "c.c", 1)]:
        assert val(spark, T.common_suffix, a=a, b=b) == n


def test_truncation(spark):
    assert val(spark, lambda c: T.truncate(c, 3), x="abcdef") == "abc..."
    assert val(spark, lambda c: T.truncate(c, 6), x="abcdef") == "abcdef"
    assert val(spark, lambda c: T.clip(c, 4), x="abcdef") == "abcd... [2 more]"


def test_error_locations(spark):
    r = val(spark, T.error_locations, x="e\n  --> src/a.rs:3:4\n --> b.rs:10:2 x")
    assert [tuple(x) for x in r] == [("src/a.rs", 3, 4), ("b.rs", 10, 2)]


def test_output_signature(spark):
    assert val(spark, T.output_signature, x=" a \n\n b") == val(spark, T.output_signature, x="a\nb\n")
    assert val(spark, T.output_signature, x=None) == val(spark, T.output_signature, x="")


def test_replace(spark):
    assert tuple(val(spark, lambda c: T.replace_checked(c, "a", "b"), x="a-a")) == ("a-a", 2, False)
    assert tuple(val(spark, lambda c: T.replace_checked(c, "a", "b", True), x="a-a")) == ("b-b", 2, True)
    assert tuple(val(spark, lambda c: T.replace_checked(c, "a", "b"), x="xay")) == ("xby", 1, True)


def test_tool_call(spark):
    assert tuple(val(spark, T.tool_call, x='```json\n{"tool_call": {"name": "f", "args": {"a": 1}}}\n```')) == ("f", '{"a":1}')
    assert tuple(val(spark, T.tool_call, x='{"name": "g"}')) == ("g", "{}")
    assert val(spark, T.tool_call, x="hello") is None


def test_predicates(spark):
    for n, want in [("MAX_X", True), ("__a", True), ("_a", True), ("A_B", True), ("AB", False), ("API_x", True), ("a_b", False)]:
        assert val(spark, P.looks_like_macro, x=n) is want
    assert val(spark, P.is_test_path, x="src/MyTest.c") is True
    assert val(spark, P.declares_function, x="int f(int a);") is True
    assert val(spark, P.declares_function, x="int a = f(1);") is False
    assert val(spark, lambda c: P.under_path(c, "a/b/"), x="a/b/c") is True
    assert val(spark, lambda c: P.under_path(c, "a/b"), x="a/bc") is False


def test_paths():
    assert P.inside_root("x/../y", "/r") == "/r/y"
    with pytest.raises(ValueError):
        P.inside_root("../y", "/r")
    import re

    assert re.search(P.glob_pattern("**/*.c"), "a/b/x.c") and re.search(P.glob_pattern("**/*.c"), "x.c")
    assert not re.search(P.glob_pattern("*.c"), "a/x.c") and re.search(P.glob_pattern("a?.c"), "ab.c")


def test_declared_text(spark):
    assert val(spark, lambda a, b: T.declared_text(a, definition=b), a=" ", b="\n int f()\n{") == " int f()"
    assert val(spark, lambda a, b: T.declared_text(a, definition=b), a=None, b=None) == ""
