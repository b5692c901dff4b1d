import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import predicates as P
from lodestrata.operators import sets as U
from lodestrata.operators import sorts as S
from lodestrata.operators import windows as W
from lodestrata.sources import documents as D
from lodestrata.sources import files as FS


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.C").write_bytes(b"int a;\nint b;\n")
    (tmp_path / "src/b.h").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "note.md").write_text("# hi\n")
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    return tmp_path


def test_scans(spark, project, rows):
    f = FS.scan_files(spark, str(project), ["c", ".h"])
    got = f.select(F.regexp_extract("path", "([^/]+)$", 1), FS.decoded(F.col("content"))).collect()
    assert sorted(map(tuple, got)) == [("a.C", "int a;\nint b;\n"), ("b.h", "café")]
    with pytest.raises(FileNotFoundError):
        FS.scan_files(spark, str(project), ["zig"])
    docs = {x.kind: x.text for x in FS.read_documents(spark, str(project), ["md", "docx"]).collect()}
    assert docs == {"md": "# hi\n", "docx": "## Title\nBody"}
    assert rows(FS.directory_listing(f), "name", "length", "lines") == [("a.C", 14, 2), ("b.h", 4, 1)]


def test_json_sources(spark, tmp_path, rows):
    sym = {"name": "f", "type": "function", "start_line": 1}
    doc = {"a.c": {"file_path": "a.c", "parse_success": True, "functions": [sym, {"text": "g"}], "macros": []}, "b.c": {"parse_success": False, "error": "bad", "functions": [sym]}}
    (tmp_path / "an.json").write_text(json.dumps(doc))
    files = D.read_analysis_json(spark, str(tmp_path / "an.json"))
    assert rows(files, "path", "parse_success", "error") == [("a.c", True, None), ("b.c", False, "bad")]
    assert rows(D.analysis_symbols(files), "path", "type", "name", "start_line", "comment") == [("a.c", "function", "f", 1, ""), ("a.c", "functions", "g", 0, "")]
    end = {"name": "f", "type": "function", "file": "./a.c"}
    edges = {"dependencies": [{"edge_id": 1, "source": end, "target": end, "dependency_type": "x", "occurrence": {"start_line": 3}}, {"edge_id": 2, "source": {"name": "f"}, "target": end, "dependency_type": "x"}, "junk"]}
    (tmp_path / "e.json").write_text(json.dumps(edges))
    assert rows(D.read_edges_file(spark, str(tmp_path / "e.json")), "edge_id", "src", "start_line") == [(1, "f:functions:a.c", 3)]
    (tmp_path / "o.json").write_text(json.dumps({"ordered_depth": [["x", 2], ["y", 1]]}))
    assert rows(D.read_order_json(spark, str(tmp_path / "o.json"))) == [("x", 0), ("y", 1)]
    (tmp_path / "o2.json").write_text(json.dumps({"ordered_names": ["z"], "ordered_depth": [["x", 2]]}))
    assert rows(D.read_order_json(spark, str(tmp_path / "o2.json"))) == [("z", 0)]
    assert rows(D.read_order_json(spark, str(tmp_path / "none.json"))) == []
    (tmp_path / "m.json").write_text(json.dumps({"f|a.c": "g|src/a.rs", "h": "h", "n": None}))
    assert rows(D.read_mapping_json(spark, str(tmp_path / "m.json"))) == [("f", "a.c", "g", "src/a.rs"), ("h", None, "h", None)]


def test_csv(spark, tmp_path, rows):
    (tmp_path / "t.csv").write_text('k,v,w\n"a ""q"" \\",1,\n,2,3\n')
    got = D.read_key_value_csv(spark, str(tmp_path / "t.csv"), ["k"]).collect()
    assert [(x.key, x.value) for x in got] == [({"k": 'a "q" \\'}, {"v": "1"})]
    df = spark.createDataFrame([("a", 'x,"y"')], "k string, v string")
    assert FS.write_csv(df, str(tmp_path / "out")) and rows(FS.read_metrics(spark, str(tmp_path / "out"))) == [("a", 'x,"y"')]
    FS.append_csv(df, str(tmp_path / "out"))
    assert len(rows(FS.read_metrics(spark, str(tmp_path / "out")))) == 2
    assert not FS.write_csv(df.where("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    FS.write_json(df, str(tmp_path / "j"))
    assert rows(spark.read.json(str(tmp_path / "j"))) == [("a", 'x,"y"')]


def test_round_trip_of_edges(spark, rows):
    e = spark.createDataFrame([(1, "f:functions:a.c", "g:macros:b.h", "macro_use", 1, 2)], "edge_id bigint, src string, dst string, dep_type string, start_line int, end_line int")
    assert rows(D.read_edge_json(D.dependency_document(None, e))) == rows(e)
    s = spark.createDataFrame([("k1", "a.c"), ("k2", "a.c")], "key string, path string")
    assert rows(D.document_totals(s, e)) == [(2, 1, 1)]


def test_rebuild(spark, rows):
    el = spark.createDataFrame([("a", "macros", 1, "#define A"), ("a", "macros", 2, "#define B"), ("a", "functions", 3, "f();")], "path string, type string, start_line int, text string")
    assert rows(FS.reconstruct(el)) == [("a", "/* macros */\n#define A\n\n#define B\n\n/* functions */\nf();")]
    sp = spark.createDataFrame([("a", "0123456789", 2, 4, "XY"), ("a", "0123456789", 3, 6, "PQR")], "path string, content string, start int, end int, piece string")
    assert rows(FS.reassemble(sp)) == [("a", "01XYQR6789")]
    assert FS.relative_path("/a/b/c", "/a/x") == "../b/c"
    lines = P.text_lines(spark.createDataFrame([(1, "a\nb\nc")], "id int, t string"), "id", "t")
    assert rows(FS.line_range(lines, -5, 2), "line") == [("a",), ("b",)] and rows(FS.line_range(lines, 3), "line") == [("c",)]
    assert spark.createDataFrame([("x" * 10,)], "t string").select(FS.capped_text(F.col("t"), 4)).first()[0] == "xxxx\n... [truncated]"


def test_windows_and_sets(spark, rows):
    m = [("f", "S", "Struct", 1, 2, "struct S;"), ("f", "S", "Impl", 3, 4, "impl S1\n"), ("f", "S", "Impl", 5, 9, "impl S2"), ("f", "T", "Impl", 10, 11, "impl T"), ("f", "T", "Impl", 12, 13, "impl T2"), ("g", "S", "Impl", 1, 2, "x")]
    got = rows(W.merge_impls(spark.createDataFrame(m, "file string, name string, kind string, start_line int, end_line int, code string")))
    assert got == [("f", "S", "Struct", 1, 9, "struct S;\nimpl S1\nimpl S2"), ("f", "T", "Impl", 10, 11, "impl T"), ("f", "T", "Impl", 12, 13, "impl T2"), ("g", "S", "Impl", 1, 2, "x")]
    calls = spark.createDataFrame([(i, "u", c) for i, c in enumerate("aabbbb")], "i int, u string, c string")
    assert rows(W.repeated_calls(calls, ["u"], ["c"], 3, F.col("i")), "i") == [(4,), (5,)]
    assert rows(W.last_n(calls, ["u"], 2, F.col("i")), "i") == [(4,), (5,)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "d")], "k int, v string")
    assert rows(U.merge_last_wins(old, new, ["k"])) == [(1, "a"), (2, None), (3, "d")]
    p = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"b":2,"a":1}'), (3, "{}")], "i int, p string")
    assert rows(U.distinct_payloads(p, "p", F.col("i")), "i") == [(1,), (3,)]
    e, c = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "a")], "dest string, source string"), spark.createDataFrame([("d", "a")], "dest string, source string")
    assert rows(U.covered_sources(e, c)) == [("d", ["b"]), ("e", ["a"])]
    n = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    assert rows(U.added_rows(n, n.where("i = 1"), ["k"]), "i") == [(2,)]
    best = spark.createDataFrame([("g", 1, True, 0.5), ("g", 2, True, 0.5 + 1e-9), ("g", 3, False, 9.0), ("h", 4, False, 1.0), ("h", 5, False, 2.0)], "g string, idx int, success boolean, score double")
    assert rows(S.best_candidate(best, ["g"])) == [("g", 1), ("h", 5)]
