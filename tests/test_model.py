from pyspark.sql import functions as F

from lodestrata.model import SYMBOL_TYPES, is_blank, normal_key, normal_path, normal_type


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()[0]


def test_types(spark):
    for raw, want in [(" 'Function' ", "functions"), ("UNION_declaration", "structs"), ('"macro_definition"', "macros"), ("TYPEDEFS", "typedefs"), (" strange ", "strange"), ("", "")]:
        assert one(spark, raw, normal_type) == want
    assert one(spark, None, normal_type) is None
    assert set(SYMBOL_TYPES.values()) == {"functions", "typedefs", "macros", "variables", "structs", "enums"}


def test_paths(spark):
    for raw, want in [(".\\a\\b.c", "a/b.c"), ("./a/b.c", "a/b.c"), ("../a.c", "../a.c"), (".hidden/a.c", ".hidden/a.c"), ("a\\b.c", "a/b.c")]:
        assert one(spark, raw, normal_path) == want


def test_keys(spark):
    assert one(spark, "Foo:function_proto:.\\x\\y.c", normal_key) == "Foo:functions:x/y.c"
    assert one(spark, "foo:functions:x/y.c", normal_key) != one(spark, "Foo:functions:x/y.c", normal_key)
    for blank in (None, "", " ", "\t　"):
        assert one(spark, blank, normal_key) is None
    assert one(spark, " odd ", normal_key) == "odd"


def test_blank(spark):
    for x, want in [(None, True), ("", True), (" \n\t", True), ("　﻿", True), ("a", False), (" 。", False)]:
        assert one(spark, x, is_blank) is want
