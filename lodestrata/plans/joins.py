"""Queries: joins (J of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import joins as J
from lodestrata.operators import predicates as P
from lodestrata.plans import views as V
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


_REGISTRY = "reg AS (SELECT DISTINCT name, key, type, path, min(symbol_id) OVER (PARTITION BY key) AS reg_order FROM sym)"
_FITS = """CASE dep_type WHEN 'function_call' THEN c.type = 'functions' WHEN 'type_reference' THEN c.type IN ('structs', 'typedefs') WHEN 'macro_use' THEN c.type = 'macros'
    WHEN 'enum_use' THEN c.type = 'enums' WHEN 'variable_use' THEN c.type = 'variables' ELSE true END"""


def _registry(spark, sf):
    s = V.symbols(spark, sf)
    return s.groupBy("key").agg(F.min("symbol_id").alias("reg_order"), F.first("name").alias("name"), F.first("type").alias("type"), F.first("path").alias("path"))


def _uses(spark, sf):
    e = V.edges(spark, sf)
    return e.select(F.col("edge_id").alias("use_id"), F.col("dst_name").alias("name"), "src", F.split("src", ":", 3)[2].alias("path"), "dep_type")


_SUFFIX = """(SELECT count(*) FROM (SELECT unnest(generate_series(1, least(len(string_split(c.path, '/')), len(string_split(u.path, '/'))))) AS i)
    WHERE list_reverse(string_split(c.path, '/'))[:i] = list_reverse(string_split(u.path, '/'))[:i])"""


def ranked_sql(use: str) -> str:
    """Tables up to d (rn = 1 is the choice) over uses (name, src, path, dep_type, ...) and reg; ``use`` lists the columns that tell a use from others."""
    return f"""cand AS (SELECT u.*, c.key, c.reg_order, c.path = u.path AS same, ends_with(u.path, '.c') AND c.path = replace(u.path, '.c', '.h') AS sib,
                   contains(lower(c.path), 'test') AND NOT contains(lower(u.path), 'test') AS tested, {_FITS} AS fits, {_SUFFIX} AS suffix FROM uses u JOIN reg c ON c.name = u.name),
        a AS (SELECT *, bool_and(tested) OVER (PARTITION BY {use}) AS all_tested FROM cand),
        b AS (SELECT *, all_tested OR NOT tested AS pooled FROM a),
        c AS (SELECT *, max((pooled AND fits)::INT) OVER (PARTITION BY {use}) = 0 AS none_fits FROM b),
        d AS (SELECT *, row_number() OVER (PARTITION BY {use} ORDER BY CASE WHEN same THEN 0 WHEN sib THEN 1 WHEN pooled AND (fits OR none_fits) THEN 2 ELSE 3 END,
                   CASE WHEN same OR sib THEN 0 ELSE -suffix END, reg_order) AS rn FROM c)"""


@query(
    "j1_ranked_resolution",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, {_REGISTRY},
        uses AS (SELECT edge_id AS use_id, dst_name AS name, src, split_part(src, ':', 3) AS path, dep_type FROM edg), {ranked_sql('use_id')}
        SELECT use_id, key AS target FROM d WHERE rn = 1 AND key <> src""",
)
def _(spark, sf):
    return J.ranked_resolution(_uses(spark, sf), _registry(spark, sf))


@query("j3_path_similarity", f"WITH {V.edge_sql()}, u AS (SELECT edge_id, split_part(src, ':', 3) AS path, split_part(dst, ':', 3) AS cpath FROM edg), c AS (SELECT edge_id, path, cpath FROM u) SELECT edge_id, {_SUFFIX.replace('c.path', 'c.cpath').replace('u.path', 'c.path')}::INT AS shared FROM c")
def _(spark, sf):
    from lodestrata.functions.text import common_suffix

    return V.edges(spark, sf).select("edge_id", common_suffix(F.split("src", ":", 3)[2], F.split("dst", ":", 3)[2]).alias("shared"))


@query("j4_known_edges", f"WITH {V.sym_sql()}, {V.edge_sql()} SELECT edge_id, src, dst FROM edg WHERE src IN (SELECT key FROM sym) AND dst IN (SELECT key FROM sym)")
def _(spark, sf):
    return J.known_edges(V.edges(spark, sf).select("edge_id", "src", "dst"), V.symbols(spark, sf)).select("edge_id", "src", "dst")


@query(
    "j5_snippets",
    """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), s AS (SELECT o_orderkey AS span_id, o_custkey % 1000 + 1 AS doc_id, (o_orderkey % 20)::INT + 1 AS a, (o_orderkey % 20)::INT + 2 AS b FROM orders)
       SELECT DISTINCT span_id, array_to_string(lines[greatest(a - 1, 1):least(b + 1, len(lines))], chr(10)) AS snippet FROM s JOIN t USING (doc_id) WHERE greatest(a - 1, 1) <= len(lines)""",
)
def _(spark, sf):
    texts = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.split("text", "\n").alias("lines"))
    k = (F.col("o_orderkey") % 20).cast("int")
    spans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("span_id"), (F.col("o_custkey") % 1000 + 1).alias("path"), (k + 1).alias("start_line"), (k + 2).alias("end_line")).distinct()
    return J.snippets(spans, texts, offset=1)


@query(
    "j8_batch_links",
    f"""WITH {V.edge_sql()}, m AS (SELECT DISTINCT s.name || ':' || s.type || ':' || s.file_path AS key, batch_id AS batch FROM (SELECT batch_id, unnest(symbols) AS s FROM symbol_batches))
        SELECT DISTINCT a.batch AS src_batch, b.batch AS dst_batch FROM edg JOIN m a ON a.key = src JOIN m b ON b.key = dst WHERE a.batch <> b.batch""",
)
def _(spark, sf):
    m = table(spark, sf, "symbol_batches").select(F.col("batch_id").alias("batch"), F.explode("symbols").alias("s")).select(F.concat_ws(":", "s.name", "s.type", "s.file_path").alias("key"), "batch")
    return J.batch_links(V.edges(spark, sf), m)


@query(
    "j9_mapping_fallback",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, m AS (SELECT name, path, min(symbol_id) AS target FROM sym GROUP BY name, path), n AS (SELECT name, arg_min(target, (path, target)) AS t2 FROM m GROUP BY name)
        SELECT e.edge_id, coalesce(m.target, n.t2) AS target FROM (SELECT edge_id, dst_name AS name, split_part(dst, ':', 3) AS path FROM edg) e LEFT JOIN m USING (name, path) LEFT JOIN n USING (name)""",
)
def _(spark, sf):
    m = V.symbols(spark, sf).groupBy("name", "path").agg(F.min("symbol_id").alias("target"))
    uses = V.edges(spark, sf).select("edge_id", F.col("dst_name").alias("name"), F.split("dst", ":", 3)[2].alias("path"))
    return J.coalesced_lookup(uses, m).select("edge_id", "target")


@query("j11_reverse_mapping", f"WITH {V.sym_sql()} SELECT replace(path, '.c', '_c.rs') || '|' || name AS target, list_sort(list_distinct(list(key))) AS keys FROM sym GROUP BY ALL")
def _(spark, sf):
    s = V.symbols(spark, sf).select("key", F.concat_ws("|", F.replace("path", F.lit(".c"), F.lit("_c.rs")), "name").alias("target"))
    return J.reverse_mapping(s)


@query(
    "j13_enclosing_symbol",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, p AS (SELECT edge_id AS point_id, split_part(src, ':', 3) AS path, start_line AS line FROM edg WHERE start_line IS NOT NULL),
        hit AS (SELECT point_id, key, shift, end_line - sym.start_line AS width, sym.start_line FROM (SELECT *, 0 AS shift, line AS at FROM p UNION ALL SELECT *, 1, line + 1 FROM p) q JOIN sym ON sym.path = q.path AND q.at BETWEEN sym.start_line AND sym.end_line)
        SELECT point_id, arg_min(key, (shift, width, start_line, key)) AS key FROM hit GROUP BY point_id""",
)
def _(spark, sf):
    p = V.edges(spark, sf).where("start_line is not null").select(F.col("edge_id").alias("point_id"), F.split("src", ":", 3)[2].alias("path"), F.col("start_line").alias("line"))
    return J.enclosing(p, V.symbols(spark, sf).select("path", "key", "start_line", "end_line"))


@query(
    "j14_outermost",
    f"""WITH {V.sym_sql()} SELECT symbol_id AS id, path, type, start_line, end_line FROM sym a WHERE NOT EXISTS (
          SELECT 1 FROM sym b WHERE b.path = a.path AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND (b.start_line < a.start_line OR b.end_line > a.end_line)
          AND NOT (a.type = 'structs' AND b.type IN ('structs', 'typedefs')))""",
)
def _(spark, sf):
    return J.outermost(V.symbols(spark, sf).select(F.col("symbol_id").alias("id"), "path", "type", "start_line", "end_line"))


@query(
    "j15_preceding_notes",
    f"""WITH {V.sym_sql()}, n AS (SELECT path, start_line, end_line, min(name) AS text FROM sym WHERE type = 'macros' GROUP BY ALL),
        b AS (SELECT *, sum(opened) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS block FROM (
              SELECT *, CASE WHEN start_line - lag(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line) > 200 THEN 1 WHEN lag(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line) IS NULL THEN 1 ELSE 0 END AS opened FROM n)),
        e AS (SELECT *, array_to_string(list(text) OVER (PARTITION BY path, block ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING), ' ') AS note FROM b)
        SELECT symbol_id AS target_id, arg_max(note, (e.end_line, e.start_line)) AS note FROM sym JOIN e ON e.path = sym.path AND e.end_line BETWEEN sym.start_line - 40 AND sym.start_line - 1
        WHERE type = 'functions' GROUP BY symbol_id""",
)
def _(spark, sf):
    s = V.symbols(spark, sf)
    notes = s.where("type = 'macros'").groupBy("path", "start_line", "end_line").agg(F.min("name").alias("text"))
    return J.preceding_notes(s.where("type = 'functions'").select(F.col("symbol_id").alias("target_id"), "path", "start_line"), notes, most=40, gap=200)


@query("j17_report_merge", "SELECT n_name AS Source, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) USING (k) JOIN nation ON n_nationkey = k")
def _(spark, sf):
    from lodestrata.operators.reports import merge_reports

    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("Source"))
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("Source", "customers")
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("Source", "suppliers")
    return merge_reports(c, s)


@query(
    "j20_destinations",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, miss AS (SELECT DISTINCT dst, dst_name, split_part(dst, ':', 3) AS path FROM edg WHERE dst NOT IN (SELECT key FROM sym))
        SELECT dst AS key, coalesce(m.rust, regexp_replace(miss.path, '\\.([chCH])$', '_\\1.rs')) AS destination FROM miss LEFT JOIN (SELECT name, min(regexp_replace(path, '\\.([chCH])$', '_\\1.rs')) AS rust FROM sym GROUP BY name) m ON m.name = miss.dst_name""",
)
def _(spark, sf):
    from lodestrata.functions.text import rust_path

    s = V.symbols(spark, sf)
    e = V.edges(spark, sf).select(F.col("dst").alias("key"), F.col("dst_name").alias("name"), F.split("dst", ":", 3)[2].alias("path")).distinct()
    by_name = s.groupBy("name").agg(F.min(rust_path(F.col("path"))).alias("rust"))
    return e.join(s.select("key").distinct(), "key", "left_anti").join(by_name, "name", "left").select("key", F.coalesce("rust", rust_path(F.col("path"))).alias("destination"))


@query(
    "j21_complete_files",
    f"""WITH {V.sym_sql('deleted_at')} SELECT DISTINCT path AS dest FROM sym WHERE path NOT IN (SELECT path FROM sym WHERE deleted_at IS NOT NULL)""",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "deleted_at").select(F.col("path").alias("dest"), F.col("symbol_id").alias("source"), "deleted_at")
    return J.complete_groups(s, s.where("deleted_at is null"))


@query("j_as_of_price", "SELECT e.event_id, arg_max(o.o_totalprice, (o.o_orderdate, o.o_totalprice)) AS price FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.max("o_totalprice").alias("price"))
    return J.as_of(table(spark, sf, "events").select("event_id", "user_id", "ts"), o, ["user_id"], "ts", "price").select("event_id", "price")


@query("x32_unresolved_targets", f"WITH {V.sym_sql()}, {V.edge_sql()} SELECT DISTINCT dst AS key FROM edg WHERE dst NOT IN (SELECT key FROM sym)")
def _(spark, sf):
    e = V.edges(spark, sf).select(F.col("dst").alias("key")).distinct()
    return e.join(V.symbols(spark, sf).select("key").distinct(), "key", "left_anti")


@query(
    "h4_ref_rows",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, a AS (SELECT name, start_line, min(symbol_id) AS s1 FROM sym GROUP BY ALL), b AS (SELECT name, min(symbol_id) AS s2 FROM sym GROUP BY ALL)
        SELECT edge_id, coalesce(s1, s2) AS symbol_id FROM (SELECT edge_id, dst_name AS name, start_line FROM edg) LEFT JOIN a USING (name, start_line) LEFT JOIN b USING (name)""",
)
def _(spark, sf):
    s = V.symbols(spark, sf)
    a = s.groupBy("name", "start_line").agg(F.min("symbol_id").alias("s1"))
    b = s.groupBy("name").agg(F.min("symbol_id").alias("s2"))
    u = V.edges(spark, sf).select("edge_id", F.col("dst_name").alias("name"), "start_line")
    return u.join(a, ["name", "start_line"], "left").join(b, "name", "left").select("edge_id", F.coalesce("s1", "s2").alias("symbol_id"))


@query(
    "h7_locations",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, d AS (SELECT DISTINCT dst, dst_name FROM edg)
        SELECT dst AS key, coalesce(dst_name || ' -> ' || path || ':' || start_line || '-' || end_line, dst_name || ' -> not found') AS location FROM d LEFT JOIN (SELECT key, arg_min(path, symbol_id) AS path, arg_min(start_line, symbol_id) AS start_line, arg_min(end_line, symbol_id) AS end_line FROM sym GROUP BY key) s ON s.key = d.dst""",
)
def _(spark, sf):
    s = V.symbols(spark, sf).groupBy("key").agg(F.min_by(F.struct("path", "start_line", "end_line"), "symbol_id").alias("at"))
    d = V.edges(spark, sf).select(F.col("dst").alias("key"), "dst_name").distinct().join(s, "key", "left")
    place = F.concat(F.col("dst_name"), F.lit(" -> "), F.col("at.path"), F.lit(":"), F.col("at.start_line").cast("string"), F.lit("-"), F.col("at.end_line").cast("string"))
    return d.select("key", F.coalesce(place, F.concat(F.col("dst_name"), F.lit(" -> not found"))).alias("location"))


# Contexts ------------------------------------------------------------------------------------------------


# The source texts are made up; a file has as many lines as the edges from it reach.
_REACHED = "SELECT split_part(src, ':', 3) AS path, max(greatest(start_line, coalesce(end_line, start_line))) AS n FROM edg WHERE start_line IS NOT NULL GROUP BY 1"


@query(
    "j6_in_edge_snippets",
    f"""WITH {V.edge_sql()}, t AS (SELECT path, list_transform(generate_series(1, n), lambda i: path || ' ' || i) AS lines FROM ({_REACHED})),
        c AS (SELECT dst, edge_id, array_to_string(lines[start_line:coalesce(end_line, start_line)], chr(10)) AS snippet FROM edg JOIN t ON t.path = split_part(src, ':', 3) WHERE start_line IS NOT NULL AND split_part(dst, ':', 2) = 'macros')
        SELECT dst, md5(array_to_string(list(snippet ORDER BY edge_id), '|')) AS digest, count(*) AS n FROM c GROUP BY dst""",
)
def _(spark, sf):
    from lodestrata.operators.context import in_edge_snippets

    e = V.edges(spark, sf)
    t = e.where("start_line is not null").groupBy(F.split("src", ":", 3)[2].alias("path")).agg(F.max(F.greatest("start_line", F.coalesce("end_line", "start_line"))).alias("n"))
    t = t.select("path", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.col("path"), F.lit(" "), i.cast("string"))).alias("lines"))
    return in_edge_snippets(e.where(F.split("dst", ":", 3)[1] == "macros"), t).select("dst", F.md5(F.array_join("snippets", "|")).alias("digest"), F.size("snippets").cast("bigint").alias("n"))


def _reg(spark, sf):
    return V.symbols(spark, sf).groupBy("key").agg(F.min("symbol_id").alias("reg_order"), F.first("name").alias("name"), F.first("path").alias("path"))


@query(
    "j7_batch_contexts",
    f"""WITH {V.sym_sql()}, r AS (SELECT key, name, min(symbol_id) AS o FROM sym GROUP BY key, name), f AS (SELECT name, arg_min(key, (o, key)) AS key FROM r GROUP BY name),
        i AS (SELECT DISTINCT batch_id AS batch, name FROM (SELECT batch_id, unnest(symbols).name AS name FROM symbol_batches))
        SELECT DISTINCT batch, coalesce(f.key, i.name) AS key, f.key IS NOT NULL AS found, coalesce('of ' || f.key, '') AS text FROM i LEFT JOIN f ON f.name = i.name""",
)
def _(spark, sf):
    from lodestrata.operators.context import batch_contexts

    items = table(spark, sf, "symbol_batches").select(F.col("batch_id").alias("batch"), F.posexplode("symbols").alias("pos", "s")).select("batch", "pos", F.col("s.name").alias("ref"))
    reg = _reg(spark, sf)
    return batch_contexts(items, reg, reg.select("key", F.concat(F.lit("of "), F.col("key")).alias("text")))


@query("j10_mapped_symbols", f"WITH {V.sym_sql()}, r AS (SELECT key, name, path, min(symbol_id) AS o FROM sym GROUP BY ALL) SELECT name, arg_min(key, (o, key)) AS key, arg_min(replace(path, '.c', '_c.rs'), (path, replace(path, '.c', '_c.rs'))) FILTER (ends_with(path, '.c')) AS target FROM r GROUP BY name HAVING bool_or(ends_with(path, '.c'))")
def _(spark, sf):
    from lodestrata.operators.context import mapped_symbols

    reg = _reg(spark, sf)
    m = reg.select("name", "path", F.when(F.col("path").endswith(".c"), F.replace("path", F.lit(".c"), F.lit("_c.rs"))).alias("target"))
    return mapped_symbols(m, reg)


@query(
    "j12_reverse_dependencies",
    f"WITH {V.sym_sql()}, {V.edge_sql()}, m AS (SELECT DISTINCT key, replace(path, '.c', '_c.rs') AS target FROM sym) SELECT DISTINCT a.target, b.target AS dep FROM edg JOIN m a ON a.key = src JOIN m b ON b.key = dst WHERE a.target <> b.target",
)
def _(spark, sf):
    from lodestrata.operators.context import reverse_dependencies

    m = V.symbols(spark, sf).select("key", F.replace("path", F.lit(".c"), F.lit("_c.rs")).alias("target")).distinct()
    return reverse_dependencies(m.select("target").distinct(), m, V.edges(spark, sf))


@query(
    "j16_triple_lookup",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, r AS (SELECT key, name, min(symbol_id) AS o FROM sym GROUP BY key, name), q AS (SELECT DISTINCT CASE edge_id % 3 WHEN 0 THEN dst WHEN 1 THEN dst_name ELSE '__' || upper(dst_name) END AS ref FROM edg),
        a AS (SELECT name, arg_min(key, (o, key)) AS k FROM r GROUP BY name), b AS (SELECT lower(regexp_replace(name, '^_+', '')) AS low, arg_min(key, (o, key)) AS k FROM r GROUP BY 1)
        SELECT ref, coalesce(r.key, a.k, b.k) AS key FROM q LEFT JOIN (SELECT DISTINCT key FROM r) r ON r.key = ref LEFT JOIN a ON a.name = ref LEFT JOIN b ON b.low = lower(regexp_replace(ref, '^_+', ''))""",
)
def _(spark, sf):
    from lodestrata.operators.context import triple_lookup

    k = F.col("edge_id") % 3
    refs = V.edges(spark, sf).select(F.when(k == 0, F.col("dst")).when(k == 1, F.col("dst_name")).otherwise(F.concat(F.lit("__"), F.upper("dst_name"))).alias("ref"))
    return triple_lookup(refs, _reg(spark, sf))


@query(
    "j18_dependency_context",
    f"""WITH {V.sym_sql()}, {V.edge_sql()}, m AS (SELECT name, path, min(replace(path, '.c', '_c.rs') || '/' || name) AS target FROM sym GROUP BY ALL), n AS (SELECT name, arg_min(target, (path, target)) AS t2 FROM m GROUP BY name)
        SELECT DISTINCT src AS start, dst AS node, coalesce(m.target, n.t2) AS target, 'fn ' || coalesce(m.target, n.t2) AS code FROM (SELECT DISTINCT src, dst, dst_name, split_part(dst, ':', 3) AS path FROM edg WHERE src <> dst) e
        LEFT JOIN m ON m.name = dst_name AND m.path = e.path LEFT JOIN n ON n.name = dst_name WHERE coalesce(m.target, n.t2) IS NOT NULL""",
)
def _(spark, sf):
    from lodestrata.operators.context import dependency_context

    m = V.symbols(spark, sf).groupBy("name", "path").agg(F.min(F.concat(F.replace("path", F.lit(".c"), F.lit("_c.rs")), F.lit("/"), F.col("name"))).alias("target"))
    hops = V.edges(spark, sf).select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct()
    return dependency_context(hops, m, m.select("target", F.concat(F.lit("fn "), F.col("target")).alias("code")).distinct())


@query("h9_fix_targets", f"WITH {V.sym_sql()}, a AS (SELECT path AS file, name, min((CASE WHEN type = 'functions' THEN 0 ELSE 1 END, symbol_id)) AS first_place FROM sym GROUP BY ALL) SELECT file, list(name ORDER BY first_place) AS names FROM a GROUP BY file")
def _(spark, sf):
    from lodestrata.operators.context import fix_targets

    s = V.symbols(spark, sf).select(F.col("path").alias("file"), "name", F.col("symbol_id").alias("pos"), "type")
    return fix_targets([s.where("type = 'functions'"), s.where("type <> 'functions'")])


@query("h27_module_lines", f"WITH {V.sym_sql()}, m AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS dir, regexp_replace(regexp_extract(path, '([^/]+?)(?:\\.[^./]*)?$', 1), '[-.]', '_', 'g') AS m FROM sym) SELECT dir, string_agg('pub mod ' || CASE WHEN regexp_matches(m, '^\\d') THEN 'm_' || m ELSE m END || ';', chr(10) ORDER BY m) AS text FROM m GROUP BY dir")
def _(spark, sf):
    from lodestrata.operators.context import module_lines

    return module_lines(V.symbols(spark, sf).select("path"))


@query("h28_prompt_items", "SELECT DISTINCT batch_id AS \"group\", i AS idx, coalesce(nullif(symbols[i].name, ''), 'item_' || i) AS name, symbols[i].type AS content FROM (SELECT *, unnest(generate_series(1, len(symbols)))::INT AS i FROM symbol_batches)")
def _(spark, sf):
    from lodestrata.operators.context import prompt_items

    b = table(spark, sf, "symbol_batches").dropDuplicates(["batch_id"]).select(F.col("batch_id").alias("group"), F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["type"].alias("content"))).alias("i"))
    return prompt_items(b, "i")


QUERIES, ORACLE_SQL = Q, S
