"""Queries: scans, projections, filters, predicates and scalar functions (S, P, F, H of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.model import is_blank, normal_path, normal_type
from lodestrata.operators import predicates as P
from lodestrata.plans import views as V
from lodestrata.plans.sqltext import type_sql
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


_T = type_sql("type")


@query("pr1_type_normal", f"SELECT type AS raw, {_T} AS type, count(*) AS n FROM symbols GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "symbols").groupBy(F.col("type").alias("raw")).agg(F.count("*").alias("n")).withColumn("type", normal_type(F.col("raw")))


@query("pr2_parsed_symbols", f"WITH {V.sym_sql()}, {V.FILE_SQL} SELECT symbol_id, name, type FROM sym WHERE path IN (SELECT file_path FROM fil WHERE parse_success)")
def _(spark, sf):
    ok = V.files(spark, sf).where("parse_success").select(F.col("file_path").alias("path"))
    return V.symbols(spark, sf).join(ok, "path", "left_semi").select("symbol_id", "name", "type")


@query("pr3_lookup", f"WITH {V.sym_sql()} SELECT symbol_id, key FROM sym WHERE type = 'macros' AND path = (SELECT max(path) FROM sym)")
def _(spark, sf):
    s = V.symbols(spark, sf)
    last = s.agg(F.max("path")).first()[0]
    return P.lookup(s, kind="macros", path=last or "").select("symbol_id", "key")


@query(
    "pr4_last_by_key",
    f"WITH {V.sym_sql('extracted_at')} SELECT key, arg_max(symbol_id, (extracted_at, symbol_id)) AS symbol_id FROM sym GROUP BY key",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "extracted_at")
    return s.groupBy("key").agg(F.max_by("symbol_id", F.struct("extracted_at", "symbol_id")).alias("symbol_id"))


@query("pr5_locations", f"WITH {V.sym_sql('start_byte', 'end_byte')} SELECT key, path, start_line, end_line, start_byte, end_byte FROM sym")
def _(spark, sf):
    return V.symbols(spark, sf, "start_byte", "end_byte").select("key", "path", "start_line", "end_line", "start_byte", "end_byte")


# The words of all definitions. The lists of the SQL are written out once more, so that a wrong one shows.
_WORDS = f"{V.sym_sql('full_definition')}, w AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(full_definition, '[A-Za-z_]\\w*|\\d+|\"[^\"\\n]*\"')) AS name FROM sym) GROUP BY name)"
KEYWORD_LIST = """'auto', 'break', 'case', 'char', 'const', 'continue', 'default', 'do', 'double', 'else', 'enum', 'extern', 'float', 'for', 'goto', 'if', 'int', 'long', 'register', 'return', 'short',
    'signed', 'sizeof', 'static', 'struct', 'switch', 'typedef', 'union', 'unsigned', 'void', 'volatile', 'while', 'inline', 'restrict', '_Bool', '_Complex', '_Imaginary', 'size_t', 'ssize_t', 'ptrdiff_t', 'NULL'"""
BUILTIN_LIST = "'malloc', 'free', 'calloc', 'realloc', 'printf', 'scanf', 'strlen', 'strcpy', 'strcmp', 'strncmp', 'strcat', 'memcpy', 'memset', 'memcmp'"
LIBRARY_LIST = """'assert', 'printf', 'scanf', 'fprintf', 'sprintf', 'snprintf', 'fopen', 'fclose', 'fread', 'fwrite', 'fgets', 'fputs', 'malloc', 'calloc', 'realloc', 'free', 'strlen', 'strcpy', 'strncpy',
    'strcmp', 'strncmp', 'strcat', 'strncat', 'abs', 'fabs', 'sqrt', 'pow', 'sin', 'cos', 'tan', 'exit', 'abort', 'atexit', 'getenv', 'system'"""


def _words(spark, sf):
    s = V.symbols(spark, sf, "full_definition")
    return s.select(F.explode(F.regexp_extract_all("full_definition", F.lit(r'([A-Za-z_]\w*|\d+|"[^"\n]*")'), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("pr6_valid_refs", f"WITH {_WORDS} SELECT name, n FROM w WHERE name IN (SELECT name FROM sym) AND NOT regexp_matches(name, '^\\d+$') AND NOT starts_with(name, '\"') AND name NOT IN ({KEYWORD_LIST}) AND name NOT IN ({BUILTIN_LIST})")
def _(spark, sf):
    return P.valid_references(_words(spark, sf), V.symbols(spark, sf).select("name"))


@query("pr6_excluded_refs", f"WITH {_WORDS} SELECT name, n FROM w WHERE regexp_matches(name, '^\\d+$') OR starts_with(name, '\"') OR name IN ({KEYWORD_LIST}) OR name IN ({BUILTIN_LIST})")
def _(spark, sf):
    w = _words(spark, sf)
    return w.join(P.valid_references(w, w.select("name")), "name", "left_anti")


@query("pr7_keywords_dropped", f"WITH {_WORDS} SELECT name, n FROM w WHERE name NOT IN ({KEYWORD_LIST})")
def _(spark, sf):
    return _words(spark, sf).where(~P.is_keyword(F.col("name")))


@query("pr8_library_names", f"WITH {_WORDS} SELECT name, n FROM w WHERE name IN ({LIBRARY_LIST})")
def _(spark, sf):
    return _words(spark, sf).where(P.is_library_name(F.col("name")))


@query("pr9_test_paths", f"WITH {V.sym_sql()} SELECT path, count(*) AS n FROM sym WHERE contains(lower(path), 'test') GROUP BY path")
def _(spark, sf):
    return V.symbols(spark, sf).where(P.is_test_path(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@query(
    "pr10_likely_macros",
    f"WITH {V.sym_sql()} SELECT DISTINCT name FROM sym WHERE type = 'macros' OR (regexp_matches(name, '[A-Z]') AND upper(name) = name AND contains(name, '_')) OR regexp_matches(name, '^(BINN_|API|MAX_|MIN_|_)')",
)
def _(spark, sf):
    return V.symbols(spark, sf).where(P.looks_like_macro(F.col("name"), F.col("type"))).select("name").distinct()


@query("pr11_edge_type", f"WITH {V.edge_sql()} SELECT edge_id, dep_type FROM edg WHERE dep_type <> 'function_call'")
def _(spark, sf):
    return P.edges_of_type(V.edges(spark, sf), "non_function_call").select("edge_id", "dep_type")


@query(
    "pr12_node_type",
    f"WITH {V.sym_sql()}, {V.edge_sql()}, ok AS (SELECT DISTINCT name FROM sym WHERE type <> 'functions') SELECT edge_id, src_name AS src, dst_name AS dst FROM edg WHERE src_name IN (FROM ok) AND dst_name IN (FROM ok)",
)
def _(spark, sf):
    e = V.edges(spark, sf).select("edge_id", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
    return P.edges_between(e, V.symbols(spark, sf).select("name", "type"), "non_functions").select("edge_id", "src", "dst")


@query("pr13_metadata", "SELECT doc_id, lang, source FROM documents WHERE coalesce(lang, '') = 'en' AND regexp_matches(coalesce(source, ''), '^git_')")
def _(spark, sf):
    return P.metadata_filter(table(spark, sf, "documents"), {"lang": "en", "source": "re:^git_"}).select("doc_id", "lang", "source")


@query("pr13_missing_field", "SELECT doc_id FROM documents WHERE coalesce(kind, '') = '' AND regexp_matches(coalesce(lang, ''), '^$|^en')")
def _(spark, sf):
    return P.metadata_filter(table(spark, sf, "documents"), {"kind": "", "lang": "re:^$|^en"}).select("doc_id")


@query("pr14_under_path", f"WITH {V.sym_sql()} SELECT symbol_id, path FROM sym WHERE path = 'quillfs/lib' OR starts_with(path, 'quillfs/lib/')")
def _(spark, sf):
    return V.symbols(spark, sf).where(P.under_path(F.col("path"), "quillfs/lib")).select("symbol_id", "path")


@query("pr16_grep", f"WITH {V.LINE_SQL} SELECT doc_id, line_no, line FROM lin WHERE regexp_matches(line, 'E0[0-9]+ shows up') ORDER BY doc_id, line_no LIMIT 50")
def _(spark, sf):
    return P.grep(P.text_lines(table(spark, sf, "documents"), "doc_id", "text"), r"E0[0-9]+ shows up", ["doc_id", "line_no"], 50)


@query("pr16_grep_literal", f"WITH {V.LINE_SQL} SELECT doc_id, line_no, line FROM lin WHERE contains(line, 'exit code') ORDER BY doc_id, line_no LIMIT 30")
def _(spark, sf):
    return P.grep(P.text_lines(table(spark, sf, "documents"), "doc_id", "text"), " exit code ", ["doc_id", "line_no"], 30, literal=True)


@query("pr17_with_body", f"WITH {V.sym_sql('full_definition')} SELECT symbol_id, type FROM sym WHERE NOT (type = 'functions' AND coalesce(full_definition, '') = '')")
def _(spark, sf):
    return P.without_bare_declarations(V.symbols(spark, sf, "full_definition")).select("symbol_id", "type")


@query(
    "pr18_declares_function",
    f"WITH {V.sym_sql('full_declaration')} SELECT symbol_id, NOT contains(full_declaration, '=') AND regexp_matches(full_declaration, '[A-Za-z_]\\w*\\s*\\([^)]*\\)[^;]*;') AS is_function FROM sym WHERE type IN ('functions', 'variables') AND full_declaration IS NOT NULL",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "full_declaration").where("type in ('functions', 'variables') and full_declaration is not null")
    return s.select("symbol_id", P.declares_function(F.col("full_declaration")).alias("is_function"))


@query("pr19_stubs", "SELECT source, max(contains(coalesce(text, ''), 'unimplemented!()')::INT) AS stubbed, count(*) FILTER (contains(coalesce(text, ''), '_ => {}')) AS empty_arms FROM documents GROUP BY source")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.max(P.has_stub(F.col("text")).cast("int")).alias("stubbed"), F.count(F.when(F.col("text").contains("_ => {}"), 1)).alias("empty_arms"))


@query(
    "pr20_severity",
    """SELECT lvl, count(*) AS n FROM (SELECT CASE regexp_extract(line, '^\\[\\w+\\] (\\w+):', 1) WHEN 'fatal' THEN 1 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 WHEN 'debug' THEN 4 END AS lvl
       FROM run_logs WHERE regexp_matches(line, '^\\[\\w+\\] \\w+:')) WHERE lvl IS NULL OR lvl <= 2 GROUP BY lvl""",
)
def _(spark, sf):
    w = F.regexp_extract("line", r"^\[\w+\] (\w+):", 1)
    r = table(spark, sf, "run_logs").where(F.col("line").rlike(r"^\[\w+\] \w+:")).select(T.severity(w).alias("lvl"))
    return r.where(P.at_least_severity(F.col("lvl"), 2)).groupBy("lvl").agg(F.count("*").alias("n"))


@query("pr21_substring", f"WITH {V.sym_sql()} SELECT DISTINCT name FROM sym WHERE contains(lower(name), 'heap') ORDER BY name LIMIT 20")
def _(spark, sf):
    return P.substring_search(V.symbols(spark, sf), "name", "Heap")


@query("pr22_first_names", f"WITH {V.sym_sql()} SELECT DISTINCT name FROM sym ORDER BY name LIMIT 25")
def _(spark, sf):
    return V.symbols(spark, sf).select("name").distinct().orderBy("name").limit(25)


@query("pr23_pairs", "SELECT DISTINCT symbol_id, name || '|' || regexp_replace(replace(file_path, '\\', '/'), '^[./]+', '') AS pair, regexp_replace(replace(file_path, '\\', '/'), '^[./]+', '') AS path FROM symbols")
def _(spark, sf):
    s = table(spark, sf, "symbols").select("symbol_id", T.pair_encode(F.col("name"), F.col("file_path")).alias("pair")).dropDuplicates(["symbol_id"])
    return s.select("symbol_id", "pair", T.pair_decode(F.col("pair"))["path"].alias("path"))


@query("pr24_rust_paths", f"WITH {V.sym_sql()} SELECT DISTINCT path, regexp_replace(path, '\\.([chCH])$', '_\\1.rs') AS rust_path FROM sym")
def _(spark, sf):
    return V.symbols(spark, sf).select("path").distinct().select("path", T.rust_path(F.col("path")).alias("rust_path"))


@query(
    "pr26_module_names",
    """SELECT DISTINCT stem, CASE WHEN regexp_matches(flat, '^\\d') THEN 'm_' || flat ELSE flat END AS module FROM (
         SELECT stem, regexp_replace(stem, '[-.]', '_', 'g') AS flat FROM (SELECT regexp_extract(file_path, '([^/]+)$', 1) AS stem FROM file_analysis))""",
)
def _(spark, sf):
    stem = F.regexp_extract("file_path", r"([^/]+)$", 1)
    return table(spark, sf, "file_analysis").select(stem.alias("stem")).distinct().select("stem", T.module_name(F.col("stem")).alias("module"))


# Scans -------------------------------------------------------------------------------------------------


@query("s1_glob_files", "SELECT DISTINCT file_path FROM file_analysis WHERE regexp_matches(file_path, '^(.*/)?src/[^/]*/[^/]*\\.c$')")
def _(spark, sf):
    return table(spark, sf, "file_analysis").where(F.col("file_path").rlike(P.glob_pattern("**/src/*/*.c"))).select("file_path").distinct()


@query("s2_suffixes", "SELECT project, count(DISTINCT file_path) AS files FROM file_analysis WHERE lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) IN ('.c', '.h') GROUP BY project")
def _(spark, sf):
    ok = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(".c", ".h")
    return table(spark, sf, "file_analysis").where(ok).groupBy("project").agg(F.countDistinct("file_path").alias("files"))


@query(
    "s7_json_edges",
    f"WITH {V.edge_sql()} SELECT edge_id, src, dst, dep_type FROM edg WHERE split_part(src, ':', 3) <> '' AND split_part(dst, ':', 3) <> '' AND dep_type IS NOT NULL",
)
def _(spark, sf):
    from lodestrata.sources.documents import read_edge_json

    e = V.edges(spark, sf)

    def end(c: str):
        p = F.split(c, ":", 3)
        return F.struct(p[0].alias("name"), p[1].alias("type"), p[2].alias("file"))

    doc = F.to_json(F.struct("edge_id", end("src").alias("source"), end("dst").alias("target"), F.col("dep_type").alias("dependency_type"), F.struct("start_line", "end_line").alias("occurrence")))
    return read_edge_json(e.select(doc.alias("value"))).select("edge_id", "src", "dst", "dep_type")


@query(
    "s10_file_symbols",
    f"""WITH {V.sym_sql('full_declaration', 'full_definition')} SELECT path, count(*) AS symbol_count, sum(length(coalesce(nullif(full_definition, ''), nullif(full_declaration, ''), ''))) AS total_chars
        FROM sym GROUP BY path""",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "full_declaration", "full_definition")
    return s.groupBy("path").agg(F.count("*").alias("symbol_count"), F.sum(F.length(T.primary_text(F.col("full_definition"), F.col("full_declaration")))).alias("total_chars"))


@query(
    "s11_key_values",
    """SELECT p_partkey AS id, map_from_entries([('p_brand', trim(p_brand)), ('p_type', trim(p_type))])::VARCHAR IS NOT NULL AS has_key, trim(p_brand) AS brand, trim(p_type) AS kind, trim(p_name) AS name
       FROM part WHERE coalesce(trim(p_brand), '') <> '' AND coalesce(trim(p_type), '') <> ''""",
)
def _(spark, sf):
    from lodestrata.sources.documents import key_value_docs

    d = key_value_docs(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_name"], keep=["p_partkey"])
    return d.select(F.col("p_partkey").alias("id"), F.col("key").isNotNull().alias("has_key"), F.col("key")["p_brand"].alias("brand"), F.col("key")["p_type"].alias("kind"), F.col("value")["p_name"].alias("name"))


@query("s20_limit_then_filter", "SELECT vec_id, label FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 100) WHERE label = 3")
def _(spark, sf):
    return table(spark, sf, "embeddings").orderBy("vec_id").limit(100).where("label = 3").select("vec_id", "label")


@query("s21_line_range", f"WITH {V.LINE_SQL} SELECT doc_id, line_no, line FROM lin WHERE line_no BETWEEN 3 AND 5")
def _(spark, sf):
    from lodestrata.sources.files import line_range

    return line_range(P.text_lines(table(spark, sf, "documents"), "doc_id", "text"), 3, 5)


@query("s22_byte_range", "SELECT doc_id, hex(encode(text)[11:30]) AS piece FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    from lodestrata.sources.files import byte_range

    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.hex(byte_range(F.encode("text", "utf-8"), 10, 30)).alias("piece"))


@query("s23_directories", "SELECT regexp_extract(file_path, '^(.*)/', 1) AS dir, count(DISTINCT file_path) AS files, sum(file_size)::BIGINT AS bytes FROM (SELECT DISTINCT file_path, file_size FROM file_analysis) GROUP BY dir ORDER BY dir")
def _(spark, sf):
    f = table(spark, sf, "file_analysis").select("file_path", "file_size").distinct()
    return f.groupBy(F.regexp_extract("file_path", r"^(.*)/", 1).alias("dir")).agg(F.countDistinct("file_path").alias("files"), F.sum("file_size").alias("bytes")).orderBy("dir")


@query("s24_glob_top", "SELECT DISTINCT file_path FROM file_analysis WHERE regexp_matches(file_path, '^(.*/)?[^/]*_1[^/]*\\.h$') ORDER BY file_path LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "file_analysis").where(F.col("file_path").rlike(P.glob_pattern("**/*_1*.h"))).select("file_path").distinct().orderBy("file_path").limit(10)


# Scalar functions ----------------------------------------------------------------------------------------


@query("f3_scrubbed", f"""WITH {V.LINE_SQL} SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '//.*|/\\*.*?\\*/', '', 'g'), '"(?:\\\\"|.)*?"', '""', 'g'), '''(?:\\\\''|.)*?''', '''''', 'g'), '^\\s+|\\s+$', '', 'g') AS code
    FROM lin WHERE doc_id IN (SELECT doc_id FROM documents WHERE kind = 'c_source')""")
def _(spark, sf):
    d = table(spark, sf, "documents").where("kind = 'c_source'")
    return P.text_lines(d, "doc_id", "text").select("doc_id", "line_no", T.scrub_code(F.col("line")).alias("code"))


@query(
    "f4_ref_counts",
    """WITH d AS (SELECT doc_id, text FROM documents WHERE kind = 'rust_source' AND text IS NOT NULL)
       SELECT doc_id, (len(regexp_extract_all(text, '&\\w+')) - len(regexp_extract_all(text, '&mut\\b')) + len(regexp_extract_all(text, '&\\s*mut\\s+\\w+')) + len(regexp_extract_all(text, '\\b(?:Cell|RefCell|String|str|Vec|Box)\\b'))
                       - len(regexp_extract_all(text, '&(?:Cell|RefCell|String|str|Vec|Box)\\b')) - len(regexp_extract_all(text, '&\\s*mut\\s+(?:Cell|RefCell|String|str|Vec|Box)\\b')))::INT AS safe_refs,
              len(regexp_extract_all(text, '\\*\\s*(?:const|mut)\\b'))::INT AS raw_pointers FROM d""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").where("kind = 'rust_source' and text is not null")
    return d.select("doc_id", T.safe_ref_count(F.col("text")).alias("safe_refs"), T.raw_pointer_count(F.col("text")).alias("raw_pointers"))


@query(
    "f6_line_counts",
    """SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN ends_with(t, chr(10)) THEN 1 ELSE 0 END END::INT AS lines
       FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)""",
)
def _(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.line_count(F.col("text")).alias("lines"))


@query("f9_function_names", f"WITH {V.sym_sql('full_declaration')} SELECT symbol_id, regexp_extract(full_declaration, '([A-Za-z_]\\w*)\\s*\\([^;{{]*', 1) AS found FROM sym WHERE type = 'functions' AND full_declaration IS NOT NULL")
def _(spark, sf):
    s = V.symbols(spark, sf, "full_declaration").where("type = 'functions' and full_declaration is not null")
    return s.select("symbol_id", T.function_name(F.col("full_declaration")).alias("found"))


@query("f11_signatures", f"WITH {V.sym_sql('full_definition')} SELECT symbol_id, trim(split_part(full_definition, '{{', 1), ' ') AS signature FROM sym WHERE type = 'functions' AND full_definition <> ''")
def _(spark, sf):
    s = V.symbols(spark, sf, "full_definition").where("type = 'functions' and full_definition <> ''")
    return s.select("symbol_id", T.signature(F.col("full_definition")).alias("signature"))


@query(
    "f12_typedef_names",
    f"""WITH {V.sym_sql('full_declaration')} SELECT symbol_id, coalesce(nullif(regexp_extract(full_declaration, '\\(\\s*\\*\\s*([A-Za-z_]\\w*)\\s*\\)', 1), ''), regexp_extract(full_declaration, '([A-Za-z_]\\w*)\\s*(?:\\[[^\\]]*\\]\\s*)?;\\s*$', 1)) AS found
        FROM sym WHERE type = 'typedefs' AND full_declaration IS NOT NULL""",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "full_declaration").where("type = 'typedefs' and full_declaration is not null")
    return s.select("symbol_id", T.typedef_name(F.col("full_declaration")).alias("found"))


@query("f13_includes", "SELECT DISTINCT file_path, regexp_replace(regexp_replace(i, '^\\s*#\\s*include\\s*', ''), '^[<\"]|[>\"]\\s*$', '', 'g') AS include FROM (SELECT file_path, unnest(includes) AS i FROM file_analysis)")
def _(spark, sf):
    f = table(spark, sf, "file_analysis").select("file_path", F.explode("includes").alias("i"))
    return f.select("file_path", T.include_name(F.col("i")).alias("include")).distinct()


@query("f14_truncated", "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS short, CASE WHEN length(text) > 40 THEN left(text, 40) || '... [' || (length(text) - 40) || ' more]' ELSE text END AS clipped FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate(F.col("text"), 60).alias("short"), T.clip(F.col("text"), 40).alias("clipped"))


@query(
    "f16_error_locations",
    """SELECT doc_id, regexp_extract(h, '--> ([^\\s:]+):', 1) AS file, regexp_extract(h, ':(\\d+):\\d+$', 1)::INT AS line, regexp_extract(h, ':(\\d+)$', 1)::INT AS col
       FROM (SELECT doc_id, unnest(regexp_extract_all(text, '--> [^\\s:]+:\\d+:\\d+')) AS h FROM documents WHERE kind = 'build_report')""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").where("kind = 'build_report'")
    return d.select("doc_id", F.inline(T.error_locations(F.col("text"))))


@query("f30_event_props", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (props IS NULL OR (props->>'$.k') IS NULL) AS missing FROM events GROUP BY event_type")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count(F.when(k.isNull(), 1)).alias("missing"))


@query("f33_query_text", "SELECT p_partkey, 'brand: ' || p_brand || chr(10) || 'type: ' || p_type AS query FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.query_text([("brand", F.col("p_brand")), ("type", F.col("p_type"))]).alias("query"))


@query("f38_primary_text", f"WITH {V.sym_sql('full_declaration', 'full_definition')} SELECT symbol_id, length(coalesce(nullif(full_definition, ''), nullif(full_declaration, ''), '')) AS by_definition, length(coalesce(full_declaration, '')) AS by_declaration FROM sym")
def _(spark, sf):
    s = V.symbols(spark, sf, "full_declaration", "full_definition")
    return s.select("symbol_id", F.length(T.primary_text(F.col("full_definition"), F.col("full_declaration"))).alias("by_definition"), F.length(F.coalesce("full_declaration", F.lit(""))).alias("by_declaration"))


@query("h2_declared_text", f"WITH {V.sym_sql('full_declaration', 'full_definition')} SELECT symbol_id, md5(CASE WHEN trim(full_declaration) <> '' THEN full_declaration ELSE coalesce(list_filter(string_split(coalesce(full_definition, ''), chr(10)), lambda x: trim(x) <> '')[1], '') END) AS digest FROM sym")
def _(spark, sf):
    s = V.symbols(spark, sf, "full_declaration", "full_definition")
    return s.select("symbol_id", F.md5(T.declared_text(F.col("full_declaration"), definition=F.col("full_definition"))).alias("digest"))


@query("h16_file_keys", "SELECT coalesce(nullif(regexp_replace(replace(project, '\\', '/'), '^\\./', ''), ''), '<unknown>') AS file, count(*) AS n FROM documents GROUP BY file")
def _(spark, sf):
    f = F.coalesce(F.nullif(normal_path(F.col("project")), F.lit("")), F.lit("<unknown>"))
    return table(spark, sf, "documents").groupBy(f.alias("file")).agg(F.count("*").alias("n"))


@query("h24_languages", "SELECT lower(split_part(lang, '-', 1)) AS language, count(*) AS documents FROM documents WHERE contains(text, 'size_t') AND lang IS NOT NULL GROUP BY language")
def _(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").contains("size_t") & F.col("lang").isNotNull())
    return d.groupBy(F.lower(F.substring_index("lang", "-", 1)).alias("language")).agg(F.count("*").alias("documents"))


@query("f_blank_texts", "SELECT count(*) FILTER (text IS NULL) AS nulls, count(*) FILTER (text = '') AS empties, count(*) AS n FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count(F.when(F.col("text").isNull(), 1)).alias("nulls"), F.count(F.when(is_blank(F.col("text")) & (F.length("text") == 0), 1)).alias("empties"), F.count("*").alias("n"))


QUERIES, ORACLE_SQL = Q, S
