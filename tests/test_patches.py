from lodestrata.operators import patches as P

GOOD = "--- a\n+++ b\n@@ -1,2 +1,2 @@ f\n a\n-b\n+c\n"
BAD = "--- a\n+++ b\n@@ -1,9 +1 @@ f\n a\n-b\n+c\n@@ -8 +8,4 @@\n-x\n@@ odd @@\n y"


def test_recounted(spark, rows):
    df = spark.createDataFrame([(1, GOOD), (2, BAD), (3, None), (4, "")], "patch_id int, text string")
    fixed = "--- a\n+++ b\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n@@ -8 +8,0 @@\n-x\n@@ odd @@\n y"
    assert rows(P.recounted_patches(df)) == [(1, GOOD, False), (2, fixed, True), (4, "", False)]


def test_summaries(spark, rows):
    c = spark.createDataFrame([("a",), ("b",)], "candidate string")
    d = spark.createDataFrame([("a", 2, "y.rs", None, True), ("a", 1, "x.rs", ["f", "g"], False), ("a", 3, "z.rs", [], False), ("a", 4, "w.rs", ["h"], True)], "candidate string, pos int, file string, symbols array<string>, imports boolean")
    assert rows(P.change_summaries(c, d)) == [("a", "x.rs (符号: f, g); y.rs (调整导入); z.rs; w.rs (符号: h; 调整导入)"), ("b", "无显著变更")]


def test_paths(spark, rows):
    w = spark.createDataFrame([("a.c", ["/p", "/q/"]), ("b.c", ["/p", "/q/"]), ("c.c", ["/p"]), ("/x/d.c", ["/p"]), ("/y/e.c", ["/p"]), ("f.c", None), (None, ["/p"])], "name string, bases array<string>")
    e = spark.createDataFrame([("/p/src/a.c",), ("/q/a.c",), ("/q/b.c",), ("/x/d.c",)], "path string")
    assert rows(P.resolved_paths(w, e)) == sorted([("a.c", "/p/src/a.c"), ("b.c", "/q/b.c"), ("c.c", "/p/c.c"), ("/x/d.c", "/x/d.c"), ("/y/e.c", "/y/e.c"), ("f.c", "f.c")], key=str)
    assert rows(P.resolved_paths(w.where("false"), e)) == []
