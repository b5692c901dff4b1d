"""Queries: graph operators and scheduling (G, B of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import char_cost
from lodestrata.operators import extraction as E
from lodestrata.operators import graph as G
from lodestrata.operators import schedule as B
from lodestrata.operators import sorts as T
from lodestrata.plans import views as V
from lodestrata.plans.filters import BUILTIN_LIST, KEYWORD_LIST, LIBRARY_LIST
from lodestrata.plans.joins import ranked_sql
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


# The query set of the traversals: the symbols whose id is divisible by 100; each walks over all edges.
_QUERY_SET = "symbol_id % 100 = 0"
_STARTS = f"{V.sym_sql()}, st AS (SELECT DISTINCT key AS start FROM sym WHERE {_QUERY_SET} AND key IS NOT NULL)"
_FILES = "fe AS (SELECT DISTINCT split_part(src, ':', 3) AS src, split_part(dst, ':', 3) AS dst FROM edg WHERE split_part(src, ':', 3) <> split_part(dst, ':', 3))"


def _starts(spark, sf, what: str = "key"):
    return V.symbols(spark, sf).where(_QUERY_SET).select(F.col(what).alias("start")).where("start is not null").distinct()


def _file_graph(spark, sf):
    return V.edges(spark, sf).select(F.split("src", ":", 3)[2].alias("src"), F.split("dst", ":", 3)[2].alias("dst")).where("src <> dst").distinct()


def _hops(step: str, depth: int, start: str = "st") -> str:
    return f"""walk AS (SELECT start, start AS node, 0 AS depth FROM {start} UNION SELECT w.start, s.b, w.depth + 1 FROM walk w JOIN ({step}) s ON s.a = w.node WHERE w.depth < {depth})"""


@query("g1_two_hops", f"WITH RECURSIVE {V.edge_sql()}, {_STARTS}, {_hops('SELECT src AS a, dst AS b FROM edg', 2)} SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL")
def _(spark, sf):
    e = V.edges(spark, sf).select("src", "dst")
    return G.k_hop(e, _starts(spark, sf), 2)


@query(
    "g1_filtered_hops",
    f"WITH RECURSIVE {V.edge_sql()}, {_STARTS}, {_hops('SELECT src AS a, dst AS b FROM edg', 3)} SELECT start, node, min(depth) AS depth FROM walk WHERE node IN (SELECT key FROM sym WHERE type = 'macros') GROUP BY ALL",
)
def _(spark, sf):
    e = V.edges(spark, sf).select("src", "dst")
    return G.k_hop(e, _starts(spark, sf), 3, kinds=V.symbols(spark, sf).where("type = 'macros'").select(F.col("key").alias("node")))


@query("g1_incoming", f"WITH RECURSIVE {V.edge_sql()}, {_STARTS}, {_hops('SELECT dst AS a, src AS b FROM edg', 2)} SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL")
def _(spark, sf):
    e = V.edges(spark, sf).select("src", "dst")
    return G.k_hop(e, _starts(spark, sf), 2, "in")


@query("g1_reach", f"WITH RECURSIVE {V.edge_sql()}, {_FILES}, {V.sym_sql()}, st AS (SELECT DISTINCT path AS start FROM sym WHERE {_QUERY_SET}), walk AS (SELECT start, start AS node FROM st UNION SELECT w.start, fe.dst FROM walk w JOIN fe ON fe.src = w.node) SELECT start, node FROM walk")
def _(spark, sf):
    return G.k_hop(_file_graph(spark, sf), _starts(spark, sf, "path"), None).select("start", "node")


@query(
    "g3_related_names",
    f"WITH RECURSIVE {V.edge_sql()}, {V.sym_sql()}, st AS (SELECT DISTINCT name AS start FROM sym WHERE {_QUERY_SET}), {_hops('SELECT src_name AS a, dst_name AS b FROM edg UNION SELECT dst_name, src_name FROM edg', 2)} SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL",
)
def _(spark, sf):
    e = V.edges(spark, sf).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
    return G.k_hop(e, _starts(spark, sf, "name"), 2, "both")


@query("g4_neighbours", f"WITH {V.edge_sql()} SELECT DISTINCT src, dst, dep_type FROM edg WHERE split_part(src, ':', 2) = 'functions'")
def _(spark, sf):
    e = V.edges(spark, sf).where(F.split("src", ":", 3)[1] == "functions")
    return e.select("src", "dst", "dep_type").distinct()


@query("g5_callers", f"WITH {V.edge_sql()} SELECT dst, count(DISTINCT src) AS callers FROM edg WHERE dep_type = 'function_call' GROUP BY dst")
def _(spark, sf):
    return V.edges(spark, sf).where("dep_type = 'function_call'").groupBy("dst").agg(F.countDistinct("src").alias("callers"))


_VIEW = "SELECT node, min(depth) AS depth FROM {0} WHERE depth > 0 AND node NOT IN (SELECT start FROM st) GROUP BY node ORDER BY depth, node LIMIT 50"


@query(
    "g6_bounded_view",
    f"""WITH RECURSIVE {V.edge_sql()}, st AS (SELECT min(src) AS start FROM edg WHERE src IN (SELECT dst FROM edg)), {_hops('SELECT src AS a, dst AS b FROM edg', 2)}, {_hops('SELECT dst AS a, src AS b FROM edg', 2).replace('walk', 'back')}
        SELECT 'out' AS side, * FROM ({_VIEW.format('walk')}) UNION ALL SELECT 'in', * FROM ({_VIEW.format('back')})""",
)
def _(spark, sf):
    e = V.edges(spark, sf).select("src", "dst")
    start = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").agg(F.min("src")).first()[0]
    return G.bounded_view(e, start or "", 2, 50)


_REACH = "r AS (SELECT src AS a, dst AS b FROM fe UNION SELECT r.a, fe.dst FROM r JOIN fe ON fe.src = r.b)"
_SCC = "n AS (SELECT src AS node FROM fe UNION SELECT dst FROM fe), scc AS (SELECT node, least(node, coalesce((SELECT min(x.b) FROM r x WHERE x.a = n.node AND EXISTS (SELECT 1 FROM r y WHERE y.a = x.b AND y.b = n.node)), node)) AS scc FROM n)"


@query("g7_components", f"WITH RECURSIVE {V.edge_sql()}, {_FILES}, {_REACH}, {_SCC} SELECT node, scc FROM scc")
def _(spark, sf):
    return G.strong_components(_file_graph(spark, sf))


@query("g7_cycle_groups", f"WITH RECURSIVE {V.edge_sql()}, {_FILES}, {_REACH}, {_SCC} SELECT scc, count(*) AS size, list_sort(list(node)) AS nodes FROM scc GROUP BY scc HAVING count(*) > 1")
def _(spark, sf):
    return G.cycle_groups(_file_graph(spark, sf))


_LAYERS = f"""{_REACH}, {_SCC}, dag AS (SELECT DISTINCT a.scc AS u, b.scc AS v FROM fe JOIN scc a ON a.node = src JOIN scc b ON b.node = dst WHERE a.scc <> b.scc),
    lv AS (SELECT DISTINCT scc AS node, 0 AS depth FROM scc UNION SELECT dag.v, lv.depth + 1 FROM lv JOIN dag ON dag.u = lv.node), mx AS (SELECT node, max(depth) AS depth FROM lv GROUP BY node)"""


@query("g8_layers", f"WITH RECURSIVE {V.edge_sql()}, {_FILES}, {_LAYERS} SELECT scc.node, scc.scc, mx.depth FROM scc JOIN mx ON mx.node = scc.scc")
def _(spark, sf):
    return G.layers(_file_graph(spark, sf))


@query("g9_order", f"WITH RECURSIVE {V.edge_sql()}, {_FILES}, {_LAYERS} SELECT scc.node, mx.depth, row_number() OVER (ORDER BY mx.depth DESC, scc.scc, scc.node) - 1 AS rank FROM scc JOIN mx ON mx.node = scc.scc")
def _(spark, sf):
    return G.topological_order(_file_graph(spark, sf))


@query("g10_filtered_load", f"WITH {V.sym_sql()}, {V.edge_sql()}, ok AS (SELECT DISTINCT name FROM sym WHERE type = 'functions'), e AS (SELECT DISTINCT src_name AS src, dst_name AS dst FROM edg WHERE dep_type = 'function_call' AND src_name IN (FROM ok) AND dst_name IN (FROM ok)) SELECT src, dst FROM e UNION ALL SELECT name, NULL FROM ok WHERE name NOT IN (SELECT src FROM e) AND name NOT IN (SELECT dst FROM e)")
def _(spark, sf):
    from lodestrata.operators.predicates import edges_between

    s = V.symbols(spark, sf).select("name", "type")
    e = V.edges(spark, sf).where("dep_type = 'function_call'").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")).distinct()
    e = edges_between(e, s, "functions").select("src", "dst")
    linked = e.select("src").union(e.select("dst")).select(F.col("src").alias("name"))
    lone = s.where("type = 'functions'").select("name").distinct().join(linked, "name", "left_anti")
    return e.unionByName(lone.select(F.col("name").alias("src"), F.lit(None).cast("string").alias("dst")))


@query("g11_file_graph", f"WITH {V.sym_sql()}, {V.edge_sql()}, {_FILES} SELECT src, dst FROM fe WHERE src IN (SELECT path FROM sym WHERE type = 'functions') ORDER BY src, dst")
def _(spark, sf):
    f = V.symbols(spark, sf).where("type = 'functions'").select(F.col("path").alias("src")).distinct()
    return _file_graph(spark, sf).join(f, "src", "left_semi").select("src", "dst").orderBy("src", "dst")


@query(
    "g13_identifier_uses",
    f"""WITH {V.sym_sql('full_definition')}, s AS (SELECT key, min(start_line) AS start_line, max(full_definition) AS text FROM sym WHERE full_definition <> '' GROUP BY key),
        l AS (SELECT key, start_line + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM s),
        w AS (SELECT key, line, unnest(regexp_extract_all(t, '[A-Za-z_]\\w*')) AS name FROM l) SELECT key, name, min(line) AS line FROM w WHERE name IN (SELECT name FROM sym) GROUP BY key, name""",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "full_definition")
    texts = s.where("full_definition <> ''").groupBy("key").agg(F.min("start_line").alias("start_line"), F.max("full_definition").alias("text"))
    return G.identifier_uses(texts, s.select("name"))


@query(
    "g14_dep_types",
    f"""WITH {V.sym_sql('full_definition')}, k AS (SELECT name, arg_min(type, (symbol_id, type)) AS kind FROM sym GROUP BY name),
        u AS (SELECT DISTINCT regexp_extract(m, '^\\w+') AS name, regexp_extract(m, '^\\w+\\s*(.*)$', 1) AS next_text FROM (SELECT unnest(regexp_extract_all(full_definition, '[A-Za-z_]\\w*(?:\\s*(?:->|[(.;,)]))?')) AS m FROM sym))
        SELECT name, next_text, CASE WHEN kind = 'macros' THEN 'macro_use' WHEN next_text = '(' THEN 'function_call' WHEN next_text IN ('->', '.') THEN 'struct_member' WHEN kind IN ('structs', 'typedefs') THEN 'type_reference'
          WHEN kind = 'enums' THEN 'enum_use' WHEN kind = 'functions' THEN 'function_call' ELSE 'variable_use' END AS inferred FROM u JOIN k USING (name)""",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "full_definition")
    kinds = s.groupBy("name").agg(F.min_by("type", F.struct("symbol_id", "type")).alias("kind"))
    m = s.select(F.explode(F.regexp_extract_all("full_definition", F.lit(r"([A-Za-z_]\w*(?:\s*(?:->|[(.;,)]))?)"), F.lit(1))).alias("m"))
    u = m.select(F.regexp_extract("m", r"^(\w+)", 1).alias("name"), F.regexp_extract("m", r"^\w+\s*(.*)$", 1).alias("next_text")).distinct()
    return u.join(kinds, "name").select("name", "next_text", G.infer_dep_type(F.col("name"), F.col("next_text"), F.col("kind")).alias("inferred"))


# Extraction, over source texts in which the edges are planted: a function per source, a line per edge; the same steps as SQL.
_PLANTED = """CASE WHEN edge_id % 7 = 0 THEN '    int ' || dst_name || ' = 0;' || chr(10) ELSE '' END || CASE dep_type WHEN 'function_call' THEN '    x = ' || dst_name || ' (1, "' || dst_name || '");' WHEN 'struct_member' THEN '    p->' || dst_name || '(n);'
    WHEN 'type_reference' THEN CASE WHEN edge_id % 2 = 0 THEN '    struct ' || dst_name || ' *q;' ELSE '    ' || dst_name || ' q = {0};' END WHEN 'enum_use' THEN '    /* ' || dst_name || ' */ // ' || dst_name ELSE '    y += ' || dst_name || ' * sizeof(' || src_name || ');' END"""
_SCRUB = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '//.*|/\\*.*?\\*/', '', 'g'), '"(?:\\\\"|.)*?"', '""', 'g'), '''(?:\\\\''|.)*?''', '''''', 'g'), '^\\s+|\\s+$', '', 'g')"""
_DECL = r"^\s*(?:(?:static|const|extern|register|volatile|unsigned|signed|struct|union|enum)\s+)*([A-Za-z_]\w*)([\s*]+)([A-Za-z_]\w*)\s*(=|;|,|\[)"
_NO_TYPE = "('return', 'goto', 'else', 'case', 'typedef', 'sizeof')"
_USES = f"""{V.sym_sql()}, {V.edge_sql()}, t AS (SELECT src AS key, 'functions' AS type, split_part(src, ':', 3) AS path, 10 AS start_line, 'void ' || src_name || '(int n, char *p)' || chr(10) || '{{' || chr(10) || string_agg({_PLANTED}, chr(10) ORDER BY edge_id) || chr(10) || '}}' AS text FROM edg GROUP BY src, src_name),
    reg AS (SELECT key, min(symbol_id) AS reg_order, min(name) AS name, min(type) AS type, min(path) AS path FROM sym GROUP BY key),
    l0 AS (SELECT key, type, coalesce(start_line, 0) + unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM t),
    l1 AS (SELECT key, type, line_no, {_SCRUB} AS line FROM l0 WHERE NOT regexp_matches(raw, '^\\s*(?:\\*(?:\\s|/|$)|/\\*[^/]*$)')),
    l2 AS (SELECT *, regexp_extract(line, '{_DECL}', 1) AS o, regexp_extract(line, '{_DECL}', 2) AS apart, regexp_extract(line, '{_DECL}', 3) AS d, regexp_extract(line, '{_DECL}', 4) AS e FROM l1),
    l3 AS (SELECT key, type, line_no, line, CASE WHEN o IN {_NO_TYPE} THEN '' ELSE o END AS of, CASE WHEN o IN {_NO_TYPE} THEN '' ELSE d END AS declared, apart, e FROM l2),
    loc AS (SELECT DISTINCT key, declared AS name FROM l3 WHERE type = 'functions' AND declared <> '' AND NOT contains(apart, '*') AND e <> '['
            UNION SELECT key, regexp_extract(p, '^\\s*(?:(?:const|unsigned|signed|struct|union|enum)\\s+)*[A-Za-z_]\\w*\\s+([A-Za-z_]\\w*)\\s*$', 1) FROM (SELECT key, unnest(string_split(regexp_extract(text, '\\(([^()]*)\\)', 1), ',')) AS p FROM t WHERE type = 'functions')),
    h AS (SELECT DISTINCT key, line_no, of, declared, regexp_extract(m, '^(->|\\.|(?:struct|union|enum)\\b)', 1) AS lead, ends_with(m, '(') AS call, regexp_extract(m, '([A-Za-z_]\\w*)\\s*\\(?$', 1) AS name
          FROM (SELECT *, unnest(regexp_extract_all(line, '(?:\\b(?:struct|union|enum)\\s+|->\\s*|\\.\\s*)?[A-Za-z_]\\w*(?:\\s*\\()?')) AS m FROM l3)),
    kn AS (SELECT name, bool_or(type = 'macros') OR (regexp_matches(name, '[A-Z]') AND upper(name) = name AND contains(name, '_')) OR regexp_matches(name, '^(BINN_|API|MAX_|MIN_|_)') AS macro, arg_min(type, (reg_order, type)) FILTER (type <> 'variables') AS known FROM reg GROUP BY name),
    u0 AS (SELECT h.*, macro, known, loc.key IS NOT NULL AS local FROM h JOIN kn USING (name) LEFT JOIN loc ON loc.key = h.key AND loc.name = h.name WHERE h.name NOT IN ({KEYWORD_LIST}) AND h.name NOT IN ({BUILTIN_LIST})),
    us AS (SELECT DISTINCT key, name, line_no, unnest(CASE WHEN lead IN ('struct', 'union', 'enum') THEN ['type_reference'] WHEN lead <> '' AND call THEN ['function_call', 'struct_member'] WHEN lead <> '' THEN ['struct_member']
            WHEN local THEN [] WHEN call AND macro THEN ['function_call', 'macro_use'] WHEN call THEN ['function_call'] WHEN declared <> '' AND name = of THEN ['type_reference'] WHEN declared <> '' THEN []
            ELSE [CASE WHEN macro THEN 'macro_use' WHEN known = 'functions' THEN 'function_call' WHEN known IN ('structs', 'typedefs') THEN 'type_reference' WHEN known = 'enums' THEN 'enum_use' ELSE 'variable_use' END] END) AS dep_type FROM u0)"""


def _definitions(spark, sf):
    i, to, own = F.col("edge_id"), F.col("dst_name"), F.col("src_name")
    line = (
        F.when(F.col("dep_type") == "function_call", F.concat(F.lit("    x = "), to, F.lit(' (1, "'), to, F.lit('");')))
        .when(F.col("dep_type") == "struct_member", F.concat(F.lit("    p->"), to, F.lit("(n);")))
        .when((F.col("dep_type") == "type_reference") & (i % 2 == 0), F.concat(F.lit("    struct "), to, F.lit(" *q;")))
        .when(F.col("dep_type") == "type_reference", F.concat(F.lit("    "), to, F.lit(" q = {0};")))
        .when(F.col("dep_type") == "enum_use", F.concat(F.lit("    /* "), to, F.lit(" */ // "), to))
        .otherwise(F.concat(F.lit("    y += "), to, F.lit(" * sizeof("), own, F.lit(");")))
    )
    local = F.when(i % 7 == 0, F.concat(F.lit("    int "), to, F.lit(" = 0;\n"))).otherwise("")
    rows = V.edges(spark, sf).select("src", "src_name", F.struct(i.alias("i"), F.concat(local, line).alias("line")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    text = F.concat(F.lit("void "), F.col("src_name"), F.lit("(int n, char *p)\n{\n"), F.col("body"), F.lit("\n}"))
    return rows.groupBy("src", "src_name").agg(body.alias("body")).select(F.col("src").alias("key"), F.lit("functions").alias("type"), F.split("src", ":", 3)[2].alias("path"), F.lit(10).alias("start_line"), text.alias("text"))


def _registered(spark, sf):
    return V.symbols(spark, sf).groupBy("key").agg(F.min("symbol_id").alias("reg_order"), F.min("name").alias("name"), F.min("type").alias("type"), F.min("path").alias("path"))


@query("g12_uses", f"WITH {_USES} SELECT key, name, line_no, dep_type FROM us")
def _(spark, sf):
    return E.extracted_uses(_definitions(spark, sf), _registered(spark, sf))


@query(
    "g16_edges",
    f"""WITH {_USES}, uses AS (SELECT us.key AS src, us.name, t.path, line_no, dep_type FROM us JOIN t USING (key) WHERE us.name NOT IN ({LIBRARY_LIST})), {ranked_sql('src, line_no, dep_type, name')}
        SELECT DISTINCT src, key AS dst, dep_type, line_no AS start_line, line_no AS end_line FROM d WHERE rn = 1 AND key <> src""",
)
def _(spark, sf):
    return E.extracted_edges(_definitions(spark, sf), _registered(spark, sf))


@query("g17_registry", f"WITH {V.sym_sql()}, r AS (SELECT name, key, min(symbol_id) AS o FROM sym GROUP BY name, key) SELECT name, list(key ORDER BY o, key) AS keys FROM r GROUP BY name")
def _(spark, sf):
    r = V.symbols(spark, sf).groupBy("name", "key").agg(F.min("symbol_id").alias("reg_order"))
    return G.registry(r)


@query(
    "g18_closure",
    f"""WITH RECURSIVE {V.edge_sql()}, {_STARTS}, e AS (SELECT DISTINCT src, dst, split_part(dst, ':', 2) = 'functions' AS f, split_part(src, ':', 2) = 'functions' AS sf FROM edg),
        far AS (SELECT st.start, e.dst AS node, 1 AS depth FROM st JOIN e ON e.src = st.start WHERE NOT e.f UNION SELECT far.start, e.dst, far.depth + 1 FROM far JOIN e ON e.src = far.node WHERE NOT e.f AND far.depth < 40),
        b AS (SELECT start, node, min(depth) AS depth FROM (SELECT st.start, e.dst AS node, 1 AS depth FROM st JOIN e ON e.src = st.start WHERE e.f UNION ALL SELECT * FROM far) WHERE node <> start GROUP BY ALL)
        SELECT start, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, node) AS rn FROM b) WHERE rn <= 64""",
)
def _(spark, sf):
    return G.closure_with_limit(V.steps(spark, sf), _starts(spark, sf), lambda node: F.split(node, ":", 3)[1] == "functions", 64)


@query("g_weak_components", f"WITH RECURSIVE {V.edge_sql()}, {_FILES}, n AS (SELECT src AS node FROM fe UNION SELECT dst FROM fe), r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, s.y FROM r JOIN (SELECT src AS x, dst AS y FROM fe UNION SELECT dst, src FROM fe) s ON s.x = r.b) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def _(spark, sf):
    return G.components(_file_graph(spark, sf))


@query("t1_by_rank", f"WITH {V.sym_sql()}, r AS (SELECT name, row_number() OVER (ORDER BY name DESC) AS rank FROM (SELECT DISTINCT name FROM sym WHERE type = 'functions')) SELECT symbol_id, coalesce(rank, 1073741824) AS rank FROM sym LEFT JOIN r USING (name) ORDER BY rank, symbol_id")
def _(spark, sf):
    from pyspark.sql import Window

    s = V.symbols(spark, sf)
    names = s.where("type = 'functions'").select("name").distinct().withColumn("head", F.substring("name", 1, 2))
    # Ranks by blocks of the first two letters, offset by the blocks ahead.
    sizes = names.groupBy("head").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("head")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = names.withColumn("k", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("name")))).join(sizes, "head").select("name", (F.col("base") + F.col("k")).alias("rank"))
    return T.by_rank(s.select("symbol_id", "name"), ranks, "name", "symbol_id").select("symbol_id", "rank")


# Scheduling -------------------------------------------------------------------------------------------------


def _chunks(limit: int, alone: bool) -> str:
    rule = f"f.total + o.cost > {limit}" + (f" OR f.total >= {limit}" if alone else "")
    return f"""o AS (SELECT symbol_id, path, cost, row_number() OVER (PARTITION BY path ORDER BY symbol_id) AS rn FROM (SELECT symbol_id, path, length(coalesce(nullif(full_definition, ''), nullif(full_declaration, ''), name)) AS cost FROM sym)),
        f AS (SELECT symbol_id, path, rn, cost::BIGINT AS total, 0 AS k FROM o WHERE rn = 1
              UNION ALL SELECT o.symbol_id, o.path, o.rn, CASE WHEN {rule} THEN o.cost ELSE f.total + o.cost END, f.k + CASE WHEN {rule} THEN 1 ELSE 0 END FROM f JOIN o ON o.path = f.path AND o.rn = f.rn + 1)"""


def _costs(spark, sf):
    s = V.symbols(spark, sf, "full_declaration", "full_definition")
    return s.select("symbol_id", "path", char_cost(F.col("full_definition"), F.col("full_declaration"), F.col("name")).alias("cost"))


@query("b2_batches", f"WITH RECURSIVE {V.sym_sql('full_declaration', 'full_definition')}, {_chunks(8000, False)} SELECT symbol_id, path, k AS batch FROM f")
def _(spark, sf):
    return B.batch_by_chars(_costs(spark, sf), "path", ["symbol_id"], "cost").select("symbol_id", "path", "batch")


@query("b7_chunks", f"WITH RECURSIVE {V.sym_sql('full_declaration', 'full_definition')}, {_chunks(3000, True)} SELECT symbol_id, path, k AS chunk FROM f")
def _(spark, sf):
    return B.chunk_by_chars(_costs(spark, sf), "path", ["symbol_id"], "cost").select("symbol_id", "path", "chunk")


@query("b1_file_batches", f"WITH RECURSIVE {V.edge_sql()}, {_FILES}, {_LAYERS}, o AS (SELECT scc.node AS file, scc.scc, row_number() OVER (ORDER BY mx.depth DESC, scc.scc, scc.node) - 1 AS rank FROM scc JOIN mx ON mx.node = scc.scc), c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY scc) > 1 THEN scc END AS cycle, min(rank) OVER (PARTITION BY scc) AS lead FROM o) SELECT row_number() OVER (ORDER BY lead, rank) AS batch, file, cycle FROM c")
def _(spark, sf):
    from lodestrata.session import checkpointed

    l = checkpointed(G.layers(_file_graph(spark, sf)))
    order = G.ranked(l).select(F.col("node").alias("file"), "rank")
    big = l.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
    return B.file_batches(order, l.join(big, "scc").select(F.col("node").alias("file"), "scc"))


@query("b4_by_file", "SELECT coalesce(nullif(project, ''), '<unknown>') AS file, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return B.by_file(table(spark, sf, "documents"), "project")


@query("b6_parallel_levels", f"WITH RECURSIVE {V.edge_sql()}, fe AS (SELECT DISTINCT split_part(dst, ':', 3) AS src, split_part(src, ':', 3) AS dst FROM edg WHERE split_part(src, ':', 3) <> split_part(dst, ':', 3)), {_LAYERS} SELECT scc.node, mx.depth AS level FROM scc JOIN mx ON mx.node = scc.scc UNION ALL SELECT DISTINCT p, 0 FROM (SELECT unnest([split_part(src, ':', 3), split_part(dst, ':', 3)]) AS p FROM edg) WHERE p NOT IN (SELECT node FROM scc)")
def _(spark, sf):
    e = V.edges(spark, sf)
    nodes = e.select(F.split("src", ":", 3)[2].alias("node")).union(e.select(F.split("dst", ":", 3)[2])).distinct()
    return G.parallel_levels(_file_graph(spark, sf), nodes)


@query("b8_group_members", "SELECT node, max(batch_id) AS \"group\" FROM (SELECT batch_id, unnest(cycle_group_files) AS node FROM symbol_batches WHERE is_cycle_group) GROUP BY node")
def _(spark, sf):
    b = table(spark, sf, "symbol_batches").where("is_cycle_group").select(F.col("batch_id").alias("group"), "cycle_group_files")
    return B.group_members(b, "cycle_group_files")


@query("b9_symbol_groups", "SELECT node, max(batch_id) AS \"group\" FROM (SELECT batch_id, unnest(symbols).symbol_id AS node FROM symbol_batches) GROUP BY node")
def _(spark, sf):
    b = table(spark, sf, "symbol_batches").select(F.col("batch_id").alias("group"), F.transform("symbols", lambda s: s["symbol_id"]).alias("ids"))
    return B.group_members(b, "ids")


@query("b10_char_cost", f"WITH {V.sym_sql('full_declaration', 'full_definition')} SELECT symbol_id, length(coalesce(nullif(full_definition, ''), nullif(full_declaration, ''), name)) AS cost FROM sym")
def _(spark, sf):
    return _costs(spark, sf).select("symbol_id", "cost")


@query("t3_in_file_order")
def _(spark, sf):
    s = V.symbols(spark, sf)
    one = s.groupBy("key").agg(F.min_by(F.struct("path", "name", "symbol_id"), "symbol_id").alias("s")).select("s.path", "key", "s.name", F.col("s.symbol_id").alias("pos"))
    return B.in_file_order(one, V.edges(spark, sf).select("src", "dst"))


@query("b3_cycle_batches")
def _(spark, sf):
    groups = table(spark, sf, "symbol_batches").where("is_cycle_group").select(F.col("cycle_group_id").alias("cycle"), F.explode("cycle_group_files").alias("path")).groupBy("path").agg(F.max("cycle").alias("cycle"))
    rows = _costs(spark, sf).join(groups, "path", "left").withColumn("project", F.substring_index("path", "/", 1))
    return B.batch_with_cycles(rows, "project", ["path", "symbol_id"], "cost", "cycle").select("project", "symbol_id", "batch")


QUERIES, ORACLE_SQL = Q, S
