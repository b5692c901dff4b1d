import json

from lodestrata.operators import context as C
from lodestrata.sources.config import Config, load_config
from lodestrata.sources.documents import mapping_document, read_symbol_rows


def test_contexts(spark, rows):
    sym = spark.createDataFrame([("f:functions:a.c", "f", 2), ("f:functions:b.c", "f", 1), ("_G:macros:a.c", "_G", 3)], "key string, name string, reg_order int")
    items = spark.createDataFrame([(1, 0, "f"), (1, 1, "f:functions:b.c"), (1, 2, "f:functions:a.c"), (1, 3, "zzz"), (2, 0, None)], "batch int, pos int, ref string")
    ctx = spark.createDataFrame([("f:functions:b.c", "text b")], "key string, text string")
    got = rows(C.batch_contexts(items.where("ref is not null"), sym, ctx), "batch", "key", "found", "text")
    assert got == [(1, "f:functions:a.c", True, ""), (1, "f:functions:b.c", True, "text b"), (1, "zzz", False, "")]
    refs = spark.createDataFrame([("f:functions:a.c",), ("f",), ("__g",), ("nope",), ("f",)], "ref string")
    assert rows(C.triple_lookup(refs, sym), "ref", "key") == [("__g", "_G:macros:a.c"), ("f", "f:functions:b.c"), ("f:functions:a.c", "f:functions:a.c"), ("nope", None)]
    m = spark.createDataFrame([("f", "b.c", None), ("f", "a.c", "rf"), ("x", None, "rx")], "name string, path string, target string")
    assert rows(C.mapped_symbols(m, sym)) == [("f", "f:functions:b.c", "rf")]
    hops = spark.createDataFrame([("s", "s", 0), ("s", "f:functions:b.c", 1), ("s", "q:macros:z", 2)], "start string, node string, depth int")
    code = spark.createDataFrame([("rf", "fn f")], "target string, code string")
    assert rows(C.dependency_context(hops, m.where("target is not null"), code)) == [("s", "f:functions:b.c", "rf", "fn f")]


def test_snippets(spark, rows):
    e = spark.createDataFrame([(2, "s:functions:a.c", "d", 2, 2), (1, "s:functions:a.c", "d", 1, 1), (3, "s:functions:a.c", "e", None, None), (4, "s:functions:a.c", "f", 3, 3)], "edge_id int, src string, dst string, start_line int, end_line int")
    t = spark.createDataFrame([("a.c", ["one", "two", " "])], "path string, lines array<string>")
    assert rows(C.in_edge_snippets(e, t)) == [("d", ["one", "two"])]


def test_lists(spark, rows):
    a = spark.createDataFrame([("x", "n2", 1), ("x", "n1", 2)], "file string, name string, pos int")
    b = spark.createDataFrame([("x", "n1", 0), ("x", "n0", 5), ("y", "n9", 1)], "file string, name string, pos int")
    assert rows(C.fix_targets([a, b])) == [("x", ["n2", "n1", "n0"]), ("y", ["n9"])]
    assert rows(C.module_lines(spark.createDataFrame([("d/b-x.rs",), ("d/1.rs",), ("d/b-x.rs",)], "path string"))) == [("d", "pub mod b_x;\npub mod m_1;")]
    g = spark.createDataFrame([(1, [("a", "t"), (None, "u"), ("", "v")])], "group int, i array<struct<name:string,content:string>>")
    assert rows(C.prompt_items(g, "i")) == [(1, 1, "a", "t"), (1, 2, "item_2", "u"), (1, 3, "item_3", "v")]
    c = spark.createDataFrame([("c", i, "f", "{}", str(i)) for i in range(3)], "conv string, pos int, name string, args string, result string")
    assert rows(C.numbered_trace(c, 2)) == [("c", "1. f({}) -> 1\n2. f({}) -> 2")]
    m = spark.createDataFrame([("k1", "t1"), ("k2", "t2"), ("k3", None)], "key string, target string")
    e = spark.createDataFrame([("k1", "k2"), ("k2", "k3"), ("k1", "k1")], "src string, dst string")
    assert rows(C.reverse_dependencies(m.select("target"), m, e)) == [("t1", "t2")]


def test_config_and_documents(spark, tmp_path, rows):
    (tmp_path / "c.yaml").write_text("project_root: 'p'  # here\noutput_dir: o2\nmax_chars_per_batch: 9\nother: x\n")
    assert load_config(str(tmp_path / "c.yaml")) == Config("p", "o2", 9, 3000)
    (tmp_path / "c.json").write_text(json.dumps({"output_path": "o3", "output_dir": ""}))
    assert load_config(str(tmp_path / "c.json")).output_root == "o3"
    (tmp_path / "l.json").write_text(json.dumps([{"name": "a", "type": "t", "file": "f"}, {"symbol": "b", "source_path": "g"}, {}]))
    (tmp_path / "m.json").write_text(json.dumps({"k": {"id": "c", "path": "h"}}))
    assert rows(read_symbol_rows(spark, str(tmp_path / "l.json"))) == [("a", "t", "f"), ("b", None, "g")]
    assert rows(read_symbol_rows(spark, str(tmp_path / "m.json"))) == [("c", None, "h")]
    m = spark.createDataFrame([("f", "a.c", "g", None)], "c_name string, c_path string, rust_name string, rust_path string")
    assert rows(mapping_document(m)) == [("f|a.c", "g")]
