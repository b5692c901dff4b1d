"""Queries: documents and tables written and read again, texts made of rows, reconstruction, references (S, F, X, H of the inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import context as C
from lodestrata.operators import memory as M
from lodestrata.operators import parse as X
from lodestrata.operators import patches as P
from lodestrata.operators import references as R
from lodestrata.plans import views as V
from lodestrata.session import checkpoint_folder, table
from lodestrata.sources import documents as D
from lodestrata.sources import files as W

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            S[name] = sql
        return fn

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_text(df: DataFrame, name: str) -> str:
    """One text file with the single column of ``df`` as its one line."""
    path = _folder(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return path


# Sinks and sources -----------------------------------------------------------------------------------------


@query("s12_appended_csv", "SELECT n_name AS name, n_regionkey::VARCHAR AS region, 2::BIGINT AS n FROM nation")
def _(spark, sf):
    path = _folder(spark, "appended")
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    for _ in range(2):
        W.append_csv(rows, path)
    return W.read_metrics(spark, path).groupBy("name", "region").agg(F.count("*").alias("n"))


@query("s13_csv_sink", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")
def _(spark, sf):
    path = _folder(spark, "csv")
    W.write_csv(table(spark, sf, "part"), path, ["p_partkey", "p_name", "p_size"])
    return W.read_metrics(spark, path)


@query("s14_metrics_scan", "SELECT lang, count(*)::VARCHAR AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(spark, sf):
    path = _folder(spark, "metrics")
    W.write_csv(table(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")), path)
    return W.read_metrics(spark, path)


@query("s15_dependency_sink", f"WITH {V.edge_sql()} SELECT edge_id, src, dst, dep_type, start_line, end_line FROM edg WHERE split_part(src, ':', 3) <> '' AND split_part(dst, ':', 3) <> '' AND dep_type IS NOT NULL")
def _(spark, sf):
    path = _folder(spark, "edges")
    D.dependency_document(V.symbols(spark, sf), V.edges(spark, sf)).write.text(path)
    return D.read_edge_json(spark.read.text(path))


@query("s16_order_document", "SELECT name, (row_number() OVER (ORDER BY name) - 1)::INT AS rank FROM (SELECT DISTINCT project AS name FROM file_analysis WHERE project IS NOT NULL)")
def _(spark, sf):
    names = table(spark, sf, "file_analysis").where("project is not null").select("project").distinct().agg(F.array_sort(F.collect_list("project")).alias("ordered_names"))
    return D.read_order_json(spark, _as_text(names.select(F.to_json(F.struct("ordered_names")).alias("value")), "order"))


@query("s17_batch_sink", "SELECT DISTINCT batch_id, project, file_count, len(symbols)::INT AS listed FROM symbol_batches")
def _(spark, sf):
    path = _folder(spark, "batches")
    W.write_json(table(spark, sf, "symbol_batches").dropDuplicates(["batch_id"]), path)
    back = spark.read.schema("batch_id bigint, project string, file_count int, symbols array<struct<symbol_id:bigint>>").json(path)
    return back.select("batch_id", "project", "file_count", F.when(F.col("symbols").isNotNull(), F.size("symbols")).alias("listed"))


@query("s18_mapping_document", "SELECT n_name AS c_name, r_name AS c_path, lower(n_name) AS rust_name, 'src/' || r_name AS rust_path FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    m = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = m.select(F.col("n_name").alias("c_name"), F.col("r_name").alias("c_path"), F.lower("n_name").alias("rust_name"), F.concat(F.lit("src/"), F.col("r_name")).alias("rust_path"))
    doc = D.mapping_document(m).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return D.read_mapping_json(spark, _as_text(doc.select(F.to_json("m").alias("value")), "mapping"))


@query("s9_symbol_rows", "SELECT n_name AS name, 'functions' AS type, r_name || '.c' AS file FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'macros', r_name || '.h' FROM region")
def _(spark, sf):
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.lit("functions").alias("type"), F.concat("r_name", F.lit(".c")).alias("file_path"))
    listed = _as_text(n.agg(F.to_json(F.collect_list(F.struct("name", "type", "file_path"))).alias("value")), "list")
    m = r.select(F.struct(F.col("r_name").alias("symbol"), F.lit("macros").alias("type"), F.concat("r_name", F.lit(".h")).alias("path")).alias("s"))
    mapped = _as_text(m.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s.symbol"), F.col("s"))))).alias("value")), "map")
    return D.read_symbol_rows(spark, listed).unionByName(D.read_symbol_rows(spark, mapped))


# Texts -----------------------------------------------------------------------------------------------------


@query("f8_clean_comments", f"WITH {V.sym_sql('comment')} SELECT symbol_id, md5(trim(regexp_replace(regexp_replace(comment, '^\\s*//[/!]*|^\\s*/\\*+<?|\\*+/\\s*$', '', 'g'), '\\n\\s*\\*+ ?', chr(10), 'g'), ' ')) AS digest FROM sym WHERE comment IS NOT NULL")
def _(spark, sf):
    return V.symbols(spark, sf, "comment").where("comment is not null").select("symbol_id", F.md5(T.strip_comment_marks(F.col("comment"))).alias("digest"))


@query("f17_output_signatures", "SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))) AS signature FROM documents WHERE kind = 'build_report'")
def _(spark, sf):
    return table(spark, sf, "documents").where("kind = 'build_report'").select("doc_id", T.output_signature(F.col("text")).alias("signature"))


@query("f2_percent_values", "SELECT p_partkey, round(p_size * 1.0 / 2, 1) AS value FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat((F.col("p_size") / 2.0).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "%").otherwise(" % ")).alias("t"))
    return p.select("p_partkey", F.round(T.percent_value(F.col("t")), 1).alias("value"))


def _tables(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_comment"))), lambda r: F.struct(r["n_nationkey"].alias("id"), r["n_name"].alias("name"), F.concat(F.lit('a "b", '), r["n_name"]).alias("note")))
    return table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit("").alias("n_comment")).groupBy(F.col("n_regionkey").alias("region")).agg(rows.alias("rows"))


@query("x10_csv_text", "SELECT n_regionkey AS region, 'id,name,note' || chr(13) || chr(10) || string_agg(n_nationkey || ',' || n_name || ',\"a \"\"b\"\", ' || n_name || '\"', chr(13) || chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def _(spark, sf):
    return _tables(spark, sf).select("region", X.to_csv(F.col("rows"), ["id", "name", "note"]).alias("text"))


@query("x13_json_text", """SELECT n_regionkey AS region, '{"rows":[' || string_agg('{"id":' || n_nationkey || ',"name":"' || n_name || '","note":"a \\"b\\", ' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS text FROM nation GROUP BY 1""")
def _(spark, sf):
    return _tables(spark, sf).select("region", X.to_json_table(F.col("rows"), "rows").alias("text"))


@query(
    "x7_validated",
    """WITH t AS (SELECT event_id, event_id % 7 AS k, CASE WHEN event_id % 7 = 0 THEN 'user=none;' || event_type WHEN event_id % 7 = 1 THEN 'user=x; user=none; kind=' || event_type || '.' ELSE 'note: user=' || user_id || '; kind=' || event_type || '.' END AS raw FROM events)
       SELECT event_id, k > 1 AS success, CASE WHEN k = 1 THEN substring(raw, 9) WHEN k > 1 THEN substring(raw, 7) END AS matched, raw, k <= 1 AS failed FROM t""",
)
def _(spark, sf):
    i = F.col("event_id") % 7
    text = F.when(i == 0, F.concat(F.lit("user=none;"), F.col("event_type"))).when(i == 1, F.concat(F.lit("user=x; user=none; kind="), F.col("event_type"), F.lit(".")))
    text = text.otherwise(F.concat(F.lit("note: user="), F.col("user_id").cast("string"), F.lit("; kind="), F.col("event_type"), F.lit(".")))
    v = X.validated_texts(table(spark, sf, "events").select("event_id", text.alias("text")), "event_id", "text", "user={user:int}; kind={kind}.")
    return v.select("event_id", "success", "matched", "raw", F.col("reason").isNotNull().alias("failed"))


@query("f28_recounted_patches", "SELECT p_partkey AS patch_id, '@@ -' || p_partkey || ',2 +' || p_partkey || ',' || CASE WHEN p_size % 3 = 0 THEN '3' ELSE '2' END || ' @@' || CASE WHEN p_size % 3 = 0 AND p_size % 4 = 3 THEN ' f' WHEN p_size % 3 <> 0 AND p_size % 4 = 2 THEN ' f' ELSE '' END || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+c' || CASE WHEN p_size % 3 = 0 THEN chr(10) || '+d' ELSE '' END AS text, p_size % 4 <> CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS changed FROM part")
def _(spark, sf):
    k, n = F.col("p_partkey").cast("string"), F.col("p_size")
    text = F.concat(F.lit("@@ -"), k, F.lit(",2 +"), k, F.lit(","), (n % 4).cast("string"), F.lit(" @@ f\n a\n-b\n+c"), F.when(n % 3 == 0, "\n+d").otherwise(""))
    return P.recounted_patches(table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), text.alias("text")))


@query("f37_change_summaries", "WITH b AS (SELECT DISTINCT batch_id, files, symbols FROM symbol_batches), c AS (SELECT batch_id, files[1] AS file, list_transform(coalesce(symbols, []), lambda s: s.name) AS names, len(files) > 1 AS more FROM b) SELECT batch_id AS candidate, CASE WHEN file IS NULL THEN '无显著变更' ELSE file || CASE WHEN len(names) > 0 AND more THEN ' (符号: ' || array_to_string(names, ', ') || '; 调整导入)' WHEN len(names) > 0 THEN ' (符号: ' || array_to_string(names, ', ') || ')' WHEN more THEN ' (调整导入)' ELSE '' END END AS text FROM c")
def _(spark, sf):
    b = table(spark, sf, "symbol_batches").dropDuplicates(["batch_id"])
    rows = b.select(F.col("batch_id").alias("candidate"), F.lit(0).alias("pos"), F.get("files", F.lit(0)).alias("file"), F.transform("symbols", lambda s: s["name"]).alias("symbols"), (F.size("files") > 1).alias("imports"))
    return P.change_summaries(rows.select("candidate"), rows)


@query("f7_resolved_paths", "WITH e AS (SELECT DISTINCT file_path AS path, project, regexp_extract(file_path, '([^/]+)$', 1) AS name FROM file_analysis WHERE project IS NOT NULL), w AS (SELECT DISTINCT project || '/' || name AS full, project, name FROM e), c AS (SELECT name, project, [project || '/lib/core/' || name, project || '/lib/core/src/' || name, project || '/src/core/' || name, project || '/src/core/src/' || name] AS tried FROM w), t AS (SELECT project, name, unnest(tried) AS path, generate_subscripts(tried, 1) AS pos FROM c), f AS (SELECT project, name, arg_min(path, pos) AS path FROM t WHERE path IN (SELECT path FROM e) GROUP BY ALL) SELECT w.project, w.name, coalesce(f.path, w.project || '/lib/core/' || w.name) AS path FROM w LEFT JOIN f ON f.project = w.project AND f.name = w.name")
def _(spark, sf):
    e = table(spark, sf, "file_analysis").where("project is not null").select(F.col("file_path").alias("path"), "project", F.regexp_extract("file_path", r"([^/]+)$", 1).alias("name")).distinct()
    # A name is told apart by its project, which is taken off again.
    w = e.select("project", "name").distinct().select(F.concat_ws("\t", "project", "name").alias("name"), F.array(F.concat("project", F.lit("/lib/core")), F.concat("project", F.lit("/src/core"))).alias("bases"))
    tagged = e.select(F.regexp_replace(F.col("path"), r"[^/]+$", "").alias("dir"), F.concat_ws("\t", "project", "name").alias("n")).select(F.concat("dir", "n").alias("path"))
    r = P.resolved_paths(w, tagged)
    return r.select(F.split("name", "\t")[0].alias("project"), F.split("name", "\t")[1].alias("name"), F.regexp_replace("path", r"[^/\t]+\t", "").alias("path"))


# Reconstruction --------------------------------------------------------------------------------------------


@query(
    "x37_reconstructed",
    f"""WITH {V.sym_sql('full_declaration')}, e AS (SELECT path, type, start_line, full_declaration AS text, lag(type) OVER w AS before, row_number() OVER w AS pos FROM sym WHERE full_declaration IS NOT NULL AND start_line IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY start_line, type, full_declaration))
        SELECT path, md5(string_agg(CASE WHEN before IS NULL OR before <> type THEN '/* ' || type || ' */' || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY pos)) AS digest FROM e GROUP BY path""",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "full_declaration").where("full_declaration is not null and start_line is not null").select("path", "type", "start_line", F.col("full_declaration").alias("text"))
    return W.reconstruct(s).select("path", F.md5("text").alias("digest"))


@query("x38_reassembled", "SELECT doc_id::VARCHAR AS path, md5(left(text, 2) || 'XX' || substring(text, 6, 5) || 'YYY' || substring(text, 13)) AS digest FROM documents WHERE length(text) >= 20")
def _(spark, sf):
    pieces = F.array(F.struct(F.lit(10).alias("start"), F.lit(12).alias("end"), F.lit("YYY").alias("piece")), F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit("XX").alias("piece")))
    d = table(spark, sf, "documents").where(F.length("text") >= 20).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.inline(pieces))
    return W.reassemble(d).select("path", F.md5("text").alias("digest"))


# References and histories ----------------------------------------------------------------------------------


@query("h5_symbol_refs", f"WITH {V.sym_sql()}, {V.edge_sql()} SELECT dst AS ref, min(symbol_id) AS symbol_id FROM (SELECT DISTINCT dst FROM edg) JOIN sym ON sym.key = dst GROUP BY dst")
def _(spark, sf):
    refs = V.edges(spark, sf).select("dst").distinct().select(F.col("dst").alias("ref"), *[F.split("dst", ":", 3)[i].alias(c) for i, c in enumerate(("name", "type", "path"))])
    return R.symbols_of_refs(refs, V.symbols(spark, sf)).select("ref", "symbol_id")


@query(
    "h8_spans",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, a AS (SELECT key, arg_min({{'s': start_line, 'e': end_line}}, symbol_id) AS own FROM sym GROUP BY key), b AS (SELECT name, path, arg_min({{'s': start_line, 'e': end_line}}, (symbol_id)) AS other FROM sym GROUP BY name, path)
        SELECT dst AS ref, coalesce(own.s, other.s) AS start_line, coalesce(own.e, other.e) AS end_line FROM (SELECT DISTINCT dst FROM edg) LEFT JOIN a ON a.key = dst LEFT JOIN b ON b.name = split_part(dst, ':', 1) AND b.path = split_part(dst, ':', 3)""",
)
def _(spark, sf):
    refs = V.edges(spark, sf).select("dst").distinct().select(F.col("dst").alias("ref"), *[F.split("dst", ":", 3)[i].alias(c) for i, c in enumerate(("name", "type", "path"))])
    return R.resolved_spans(refs, V.symbols(spark, sf))


@query(
    "x24_usages",
    f"""WITH {V.edge_sql()}, u AS (SELECT DISTINCT dst AS symbol, split_part(src, ':', 3) AS uri, start_line AS line, end_line AS "character" FROM edg WHERE start_line IS NOT NULL)
        SELECT symbol, uri, line, "character", truncated FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY uri, line, "character") AS rn, count(*) OVER (PARTITION BY symbol) > 20 AS truncated FROM u) WHERE rn <= 20""",
)
def _(spark, sf):
    u = V.edges(spark, sf).where("start_line is not null").select(F.col("dst").alias("symbol"), F.split("src", ":", 3)[2].alias("uri"), F.col("start_line").alias("line"), F.col("end_line").alias("character"))
    return R.usages(u, 20)


@query(
    "x25_diagnostics",
    """SELECT log_file AS uri, line_no AS line, CASE regexp_extract(line, '^\\[\\w+\\] (\\w+):', 1) WHEN 'fatal' THEN 1 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 END AS severity FROM (SELECT DISTINCT log_file, line_no, line FROM run_logs)
       WHERE regexp_extract(line, '^\\[\\w+\\] (\\w+):', 1) IN ('fatal', 'error', 'warning')""",
)
def _(spark, sf):
    r = table(spark, sf, "run_logs").select("log_file", "line_no", "line").distinct().select(F.col("log_file").alias("uri"), F.col("line_no").alias("line"), F.regexp_extract("line", r"^\[\w+\] (\w+):", 1).alias("word")).where("word <> ''")
    return R.diagnostics(r.withColumn("severity", T.severity(F.col("word"))).where("severity is not null"), "warning").select("uri", "line", "severity")


@query("h13_entries", f"WITH {V.edge_sql()} SELECT edge_id, '- ' || split_part(src, ':', 3) || ':' || start_line || '-' || end_line || chr(10) || dst_name AS entry FROM edg WHERE start_line IS NOT NULL AND end_line IS NOT NULL")
def _(spark, sf):
    e = V.edges(spark, sf).where("start_line is not null and end_line is not null")
    return e.select("edge_id", C.entry_text(F.split("src", ":", 3)[2], F.col("start_line"), F.col("end_line"), F.col("dst_name")).alias("entry"))


@query(
    "h17_call_traces",
    """WITH c AS (SELECT user_id AS conv, event_id AS pos, event_type AS name, coalesce(props, '') AS args, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
       k AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos) AS i FROM c WHERE back <= 5) SELECT conv, string_agg(i || '. ' || name || '(' || args || ') -> ok', chr(10) ORDER BY i) AS text FROM k GROUP BY conv""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.coalesce("props", F.lit("")).alias("args"), F.lit("ok").alias("result"))
    return C.numbered_trace(e, 5)


@query(
    "h19_model_input",
    """WITH c AS (SELECT user_id AS conv, event_id AS pos, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
       SELECT conv, string_agg('user=' || event_type, ';' ORDER BY pos) AS input FROM c WHERE back <= 4 GROUP BY conv""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("pos"), F.lit("user").alias("role"), F.col("event_type").alias("content"))
    m = M.pre_model_messages(e, "sliding_window", most=4)
    return m.select("conv", F.array_join(F.transform("llm_input_messages", lambda x: F.concat(x["role"], F.lit("="), x["content"])), ";").alias("input"))


QUERIES, ORACLE_SQL = Q, S
