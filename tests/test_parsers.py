from lodestrata.operators.windows import merge_impls
from lodestrata.sources import parsers as P

C = '''#include <stdio.h>
#include "a/b.h"
/* #include "no.h" */
#define MAX_A 3
#define LONG(x) \\
    do { x; } while (0)

// Adds two.
static int add(int a, /* b; */ int b)
{
    if (a) { return '}'; }
    return a + b;
}
int proto(char *s);
struct node { int v; struct node *next; };
enum { RED, BLUE };
union u { int a; };
typedef struct { int x; } thing_t;
typedef void (*callback)(int);
int counter = 3, other;
static const char *names[] = { "a;", "b" };
extern struct node *head;
'''


def test_c():
    got = [(r[0], r[1]) for r in P.parse_c("a.c", C)]
    assert got == [
        ("includes", "stdio.h"), ("includes", "a/b.h"), ("macros", "MAX_A"), ("macros", "LONG"), ("functions", "add"), ("functions", "proto"), ("structs", "node"), ("enums", "anonymous_enum"),
        ("structs", "u"), ("typedefs", "thing_t"), ("typedefs", "callback"), ("variables", "counter"), ("variables", "names"), ("variables", "head"),
    ]
    add = next(r for r in P.parse_c("a.c", C) if r[1] == "add")
    assert add[2:4] == (9, 13) and add[6] == "static int add(int a, /* b; */ int b)" and add[7].endswith("return a + b;\n}") and add[8] == "// Adds two."
    assert C.encode()[add[4] : add[5]].decode() == add[7]
    assert [r[:2] for r in P.parse_c("a.c", "int f( {")] == [("functions", "f")] and P.parse_c("a.c", "") == []


R = '''pub fn f(x: &str) -> i32 { "}"; 1 }
struct S { a: i32 }
impl<T> Trait for S<T> {
    fn inner(&self) {}
}
mod m { pub const A: i32 = 1; static mut B: u8 = 2; }
type Alias = Vec<u8>;
macro_rules! mac { () => {} }
'''


def test_rust():
    got = [(r[0], r[1], r[2], r[3]) for r in P.parse_rust("a.rs", R)]
    assert got == [("Function", "f", 1, 1), ("Struct", "S", 2, 2), ("Impl", "S", 3, 5), ("Function", "inner", 4, 4), ("Module", "m", 6, 6), ("TypeAlias", "Alias", 7, 7), ("Macro", "mac", 8, 8)]


def test_files(spark):
    df = spark.createDataFrame([("x.C", C), ("y.rs", R), ("z.py", "x"), ("n.c", None), (None, C), ("bad.c", "int f(")], "path string, text string")
    rows = P.parse_files(df).collect()
    assert {r.path for r in rows} == {"x.C", "y.rs", "bad.c"}
    own = P.parse_files(df, lambda p, t: [("functions", p, 1, 1, 0, 1, t[:3], "", "")]).collect()
    assert len(own) == 4
    m = P.parse_files(df).where("path = 'y.rs' and name = 'S'").selectExpr("path as file", "name", "type as kind", "start_line", "end_line", "full_definition as code")
    assert [(r.name, r.kind, r.end_line) for r in merge_impls(m).collect()] == [("S", "Struct", 5)]
