"""Queries: retrieval, parsing, metrics and streams (T5 to T7, B11 to B14, X, A9 and A10 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import metrics as M
from lodestrata.operators import parse as X
from lodestrata.operators import retrieval as R
from lodestrata.session import table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            S[name] = sql
        return fn

    return add


_DIST = "list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _queries(v):
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(
    "t5_search",
    f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS rn FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
        SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS rank FROM d WHERE rn <= 30 AND coalesce(label::VARCHAR, '') = '2') WHERE rank <= 10""",
)
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    return R.search(v, _queries(v), 10, {"label": "2"})


@query(
    "t5_prefiltered",
    f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.label = 2) WHERE rank <= 10",
)
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    return R.search(v, _queries(v), 10, {"label": "2"}, prefilter=True)


@query("t6_nearest", f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    return R.nearest(v, _queries(v), 5).select("query_id", "vec_id", "rank")


@query(
    "t7_reranked",
    f"""WITH h AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 8)
        SELECT query_id, vec_id, rank, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN vec_id % 2 = 0 THEN label END DESC NULLS LAST, rank) AS new_rank FROM h) WHERE new_rank <= 5""",
)
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    hits = R.nearest(v, _queries(v), 8).select("query_id", "vec_id", "rank")
    scores = hits.join(v.select("vec_id", "label"), "vec_id").where("vec_id % 2 = 0").select("query_id", "vec_id", F.col("label").cast("double").alias("score"))
    return R.rerank(hits, scores, 5)


@query("h10_experience", f"WITH h AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS rn FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rn <= 6) SELECT query_id, rank, 'item ' || vec_id AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS rank FROM h WHERE vec_id % 3 <> 0) WHERE rank <= 3")
def _(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("note", F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("item "), F.col("vec_id").cast("string"))).otherwise(" "))
    return R.experience_hits(v, _queries(v), 3, "note")


@query("b11_embedding_batches", "SELECT doc_id, (floor((row_number() OVER (ORDER BY doc_id) - 1) / 10))::BIGINT AS batch FROM documents")
def _(spark, sf):
    return R.embedding_batches(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "batch")


@query("b12_split_texts")
def _(spark, sf):
    return R.split_texts(table(spark, sf, "documents"), "doc_id", "text")


@query("b13_headings", "WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS i FROM documents WHERE kind = 'design_doc'), g AS (SELECT *, sum(CASE WHEN starts_with(trim(line), '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT doc_id, k::INT AS part, min(trim(line)) FILTER (starts_with(trim(line), '#')) AS heading, count(*) AS lines FROM g WHERE k > 0 GROUP BY ALL")
def _(spark, sf):
    d = table(spark, sf, "documents").where("kind = 'design_doc'")
    # Trimming a paragraph drops blank lines at its end, so lines are counted on the untrimmed number of line ends.
    p = d.select("doc_id", F.posexplode(R.heading_paragraphs(F.concat("text", F.lit("\x01")))).alias("k", "p"))
    text = F.replace("p", F.lit("\x01"), F.lit(""))
    return _untrimmed(spark, sf).join(p.select("doc_id", (F.col("k") + 1).alias("part"), F.trim(F.substring_index(text, "\n", 1)).alias("heading")), ["doc_id", "part"]).select("doc_id", "part", "heading", "lines")


def _untrimmed(spark, sf):
    from pyspark.sql import Window

    lines = table(spark, sf, "documents").where("kind = 'design_doc'").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    g = lines.withColumn("part", F.sum(F.trim("line").startswith("#").cast("int")).over(w).cast("int")).where("part > 0")
    return g.groupBy("doc_id", "part").agg(F.count("*").alias("lines"))


# Parsing ---------------------------------------------------------------------------------------------------

_NATION = {"key": "int", "name": "str"}


def _nation_text(spark, sf):
    n = table(spark, sf, "nation")
    group = F.concat(F.lit('{ "'), F.col("n_nationkey").cast("string"), F.lit('", "'), F.col("n_name"), F.lit('" }'))
    return n.groupBy("n_regionkey").agg(F.concat(F.lit("<think>{1,x}</think>{ "), F.array_join(F.array_sort(F.collect_list(group)), ", "), F.lit(", {bad}, {x, y} }")).alias("text"))


@query("x8_value_rows", "SELECT n_regionkey AS region, n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def _(spark, sf):
    t = _nation_text(spark, sf)
    return t.select(F.col("n_regionkey").alias("region"), F.inline(X.value_rows(F.col("text"), _NATION)))


@query("x9_json_rows", "SELECT n_regionkey AS region, n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def _(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))).alias("rows"))).alias("text"))
    return n.select(F.col("n_regionkey").alias("region"), F.inline(X.json_rows(F.col("text"), "rows", _NATION)))


@query("x11_tsv", "SELECT n_regionkey AS region, 'key' || chr(9) || 'name' || chr(10) || string_agg(n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey) AS tsv FROM nation GROUP BY 1")
def _(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(rows.alias("r")).select("region", X.to_tsv(F.col("r"), ["key", "name"]).alias("tsv"))


@query("x12_markdown", "SELECT n_regionkey AS region, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY 1")
def _(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(rows.alias("r")).select("region", X.to_markdown(F.col("r"), ["key", "name"]).alias("md"))


@query("x6_templates", "SELECT event_id, event_id % 7 <> 0 AS success, CASE WHEN event_id % 7 <> 0 THEN user_id END AS \"user\" FROM events")
def _(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 7 == 0, F.concat(F.lit("user=none;"), F.col("event_type"))).otherwise(F.concat(F.lit("note: user="), F.col("user_id").cast("string"), F.lit("; kind="), F.col("event_type"), F.lit(".")))
    e = table(spark, sf, "events").select("event_id", text.alias("text"))
    p = X.parse_texts(e, "event_id", "text", "user={user:int}; kind={kind}.")
    return p.select("event_id", "success", F.get_json_object("data", "$.user").cast("bigint").alias("user"))


@query("f32_tool_calls", "SELECT event_id, 'track' AS name, user_id::VARCHAR AS u FROM events WHERE event_id % 2 = 0")
def _(spark, sf):
    from lodestrata.functions.text import tool_call

    plain = F.concat(F.lit('{"tool_call": {"name": "track", "args": {"u": '), F.col("user_id").cast("string"), F.lit("}}}"))
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(F.col("event_id") % 2 == 0, plain).otherwise("no call")
    c = table(spark, sf, "events").select("event_id", tool_call(text).alias("c")).where("c is not null")
    return c.select("event_id", "c.name", F.get_json_object("c.args", "$.u").alias("u"))


@query("f25_segments", "WITH s AS (SELECT doc_id, n_chars::INT AS n FROM documents WHERE n_chars >= 100), p AS (SELECT doc_id, 0 AS s, 10 AS e, true AS gap FROM s UNION ALL SELECT doc_id, 10, 40, false FROM s UNION ALL SELECT doc_id, 40, 50, false FROM s UNION ALL SELECT doc_id, 50, n, true FROM s WHERE n > 50) SELECT doc_id, s AS start, e AS \"end\", gap FROM p")
def _(spark, sf):
    spans = F.array(F.struct(F.lit(30).alias("start"), F.lit(50).alias("end")), F.struct(F.lit(10).alias("start"), F.lit(40).alias("end")))
    d = table(spark, sf, "documents").where("n_chars >= 100")
    return d.select("doc_id", F.inline(X.segments(F.col("n_chars").cast("int"), spans)))


@query("f29_replacements", "SELECT doc_id, (length(text) - length(replace(text, 'exit code', ''))) // 9 AS hits, (length(text) - length(replace(text, 'exit code', ''))) // 9 = 1 AS done FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    from lodestrata.functions.text import replace_checked

    d = table(spark, sf, "documents").where("text is not null").select("doc_id", replace_checked(F.col("text"), "exit code", "status").alias("r"))
    return d.select("doc_id", "r.hits", "r.done")


# Parser plug-in ------------------------------------------------------------------------------------------


def _sources(spark, sf, kind, ext):
    d = table(spark, sf, "documents").where(F.col("kind") == kind)
    return d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(ext)).alias("path"), "text")


@query("x33_c_elements")
def _(spark, sf):
    from lodestrata.sources.parsers import parse_files

    return parse_files(_sources(spark, sf, "c_source", ".c"))


@query("s25_rust_items")
def _(spark, sf):
    from lodestrata.operators.windows import merge_impls
    from lodestrata.sources.parsers import parse_files

    items = parse_files(_sources(spark, sf, "rust_source", ".rs"))
    return merge_impls(items.select(F.col("path").alias("file"), "name", F.col("type").alias("kind"), "start_line", "end_line", F.col("full_definition").alias("code")))


@query("x36_function_counts", "SELECT doc_id, len(regexp_extract_all(text, '(?m)^(?:pub )?fn '))::BIGINT AS functions FROM documents WHERE kind = 'rust_source' AND text IS NOT NULL AND regexp_matches(text, '(?m)^(?:pub )?fn ')")
def _(spark, sf):
    d = table(spark, sf, "documents").where("kind = 'rust_source' and text is not null")
    n = F.regexp_count("text", F.lit(r"(?m)^(?:pub )?fn "))
    return d.select("doc_id", n.cast("bigint").alias("functions")).where("functions > 0")


# Metrics ---------------------------------------------------------------------------------------------------


@query("a9_safety")
def _(spark, sf):
    return M.safety_by_file(table(spark, sf, "documents").where("kind = 'rust_source'"), "doc_id", "text")


@query("a10_safety_report")
def _(spark, sf):
    return M.safety_report(M.safety_by_file(table(spark, sf, "documents").where("kind = 'rust_source'"), "doc_id", "text"), "doc_id")


# Streams -----------------------------------------------------------------------------------------------------


@query("st_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    from lodestrata.streaming import facade

    return facade.run_to_table(spark, sf, "events", lambda s: facade.windowed_counts(s, "ts", "6 hours", ["event_type"], late="40 days"), "append_last")


@query("st_deduplicated", "SELECT count(DISTINCT edge_id) AS n FROM edges")
def _(spark, sf):
    from lodestrata.streaming import facade

    out = facade.run_to_table(spark, sf, "edges", lambda s: facade.distinct_events(s, ["edge_id"]).select("edge_id"), "append")
    return out.agg(F.count("*").alias("n"))


QUERIES, ORACLE_SQL = Q, S
