from lodestrata.operators import extraction as E

SYM = "key string, type string, path string, start_line int, text string"
REG = "name string, key string, type string, path string, reg_order int"

REGISTRY = [
    ("run", "run:functions:a.c", "functions", "a.c", 1), ("help_it", "help_it:functions:b.c", "functions", "b.c", 2), ("node", "node:structs:a.h", "structs", "a.h", 3), ("item_t", "item_t:typedefs:a.h", "typedefs", "a.h", 4),
    ("MAX_N", "MAX_N:macros:a.h", "macros", "a.h", 5), ("total", "total:variables:b.c", "variables", "b.c", 6), ("color", "color:enums:a.h", "enums", "a.h", 7), ("size", "size:variables:b.c", "variables", "b.c", 8),
    ("printf", "printf:functions:c.c", "functions", "c.c", 9), ("assert", "assert:macros:c.h", "macros", "c.h", 10), ("next", "next:functions:b.c", "functions", "b.c", 11),
]
TEXT = """void run(int size, struct node *n)
{
    item_t it = make(MAX_N);
    int total = 0;
    /* help_it is not called */
    help_it(n->next, "color"); // color
    total += size;
    n->next(color);
    x = sizeof(item_t) + MAX_N(3);
    printf("%d", 1);
    assert(total);
 * help_it in a comment
    run(1, n);
}"""


def frames(spark, text=TEXT):
    return spark.createDataFrame([("run:functions:a.c", "functions", "a.c", 10, text), ("none:functions:a.c", "functions", "a.c", 1, None), (None, "functions", "a.c", 1, "help_it();")], SYM), spark.createDataFrame(REGISTRY, REG)


def test_uses(spark, rows):
    got = rows(E.extracted_uses(*frames(spark)), "name", "line_no", "dep_type")
    assert got == sorted(
        [
            ("run", 10, "function_call"), ("node", 10, "type_reference"), ("item_t", 12, "type_reference"), ("help_it", 15, "function_call"), ("next", 15, "struct_member"),
            ("next", 17, "function_call"), ("next", 17, "struct_member"), ("color", 17, "enum_use"), ("item_t", 18, "type_reference"), ("MAX_N", 18, "function_call"), ("MAX_N", 18, "macro_use"), ("run", 22, "function_call"),
            ("assert", 20, "function_call"), ("assert", 20, "macro_use"),
        ],
        key=lambda t: tuple((x is not None, str(x)) for x in t),
    )


def test_edges(spark, rows):
    got = rows(E.extracted_edges(*frames(spark)), "dst", "dep_type", "start_line")
    # No edge of a symbol to itself, none to the C library.
    assert {g[0] for g in got} == {"node:structs:a.h", "item_t:typedefs:a.h", "help_it:functions:b.c", "next:functions:b.c", "color:enums:a.h", "MAX_N:macros:a.h"}
    assert len(got) == len(set(got)) == 10
    counts = {x.dep_type: (x.found, x.added) for x in E.extraction_counts(*frames(spark)).collect()}
    assert counts["function_call"] == (6, 3) and counts["struct_member"] == (2, 2)


def test_empty(spark, rows):
    sym, reg = frames(spark)
    assert rows(E.extracted_edges(sym.where("false"), reg)) == [] and rows(E.extracted_edges(sym, reg.where("false"))) == []
    long = "void f(void)\n{\n" + "    help_it();\n" * 20_000 + "}"
    assert len(rows(E.extracted_uses(*frames(spark, long)), "line_no")) == 20_000
