"""Queries: aggregates, windows, sorts and set operations (A, W, T, U of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import memory as M
from lodestrata.operators import reports as R
from lodestrata.operators import sets as U
from lodestrata.operators import windows as W
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


# Aggregates --------------------------------------------------------------------------------------------


@query("a1_counts_by_type", f"WITH {V.sym_sql()}, {V.edge_sql()} SELECT 'symbols' AS what, type AS kind, count(*) AS n FROM sym GROUP BY ALL UNION ALL SELECT 'edges', dep_type, count(*) FROM edg GROUP BY ALL")
def _(spark, sf):
    s = V.symbols(spark, sf).groupBy(F.lit("symbols").alias("what"), F.col("type").alias("kind")).agg(F.count("*").alias("n"))
    e = V.edges(spark, sf).groupBy(F.lit("edges").alias("what"), F.col("dep_type").alias("kind")).agg(F.count("*").alias("n"))
    return s.unionByName(e)


@query(
    "a2_file_edges",
    f"""WITH {V.edge_sql()}, f AS (SELECT DISTINCT src, dst, dep_type, split_part(src, ':', 3) AS src_file, split_part(dst, ':', 3) AS dst_file FROM edg)
        SELECT src_file, dst_file, count(*) AS n, count(*) FILTER (dep_type = 'function_call') AS calls, list_sort(list(DISTINCT dep_type)) AS dep_types FROM f WHERE src_file <> dst_file GROUP BY ALL""",
)
def _(spark, sf):
    from lodestrata.operators.graph import file_edges

    return file_edges(V.edges(spark, sf))


@query("a3_degree_top", f"WITH {V.edge_sql()} SELECT * FROM (SELECT 'out' AS side, src_name AS name, count(*) AS n FROM edg GROUP BY ALL ORDER BY n DESC, name LIMIT 10) UNION ALL SELECT * FROM (SELECT 'in', dst_name, count(*) AS n FROM edg GROUP BY ALL ORDER BY n DESC, dst_name LIMIT 10)")
def _(spark, sf):
    from lodestrata.operators.graph import degree_top

    return degree_top(V.edges(spark, sf), 10)


@query("a4_project_totals", f"WITH {V.FILE_SQL} SELECT project, count(*) AS files, count(*) FILTER (parse_success) AS parsed, sum(symbol_count)::BIGINT AS symbols, sum(total_nodes)::BIGINT AS nodes, sum(len(includes))::BIGINT AS includes FROM fil GROUP BY project")
def _(spark, sf):
    f = V.files(spark, sf)
    return f.groupBy("project").agg(
        F.count("*").alias("files"), F.count(F.when(F.col("parse_success"), 1)).alias("parsed"), F.sum("symbol_count").alias("symbols"), F.sum("total_nodes").alias("nodes"),
        F.sum(F.size("includes")).alias("includes"),
    )


@query("a5_parse_report", f"WITH {V.FILE_SQL} SELECT count(*) AS total, sum(parse_success::INT)::BIGINT AS success, sum((NOT parse_success)::INT)::BIGINT AS failed, sum(file_size)::BIGINT AS bytes FROM fil")
def _(spark, sf):
    ok = F.col("parse_success")
    return V.files(spark, sf).agg(F.count("*").alias("total"), F.sum(ok.cast("int")).alias("success"), F.sum((~ok).cast("int")).alias("failed"), F.sum("file_size").alias("bytes"))


@query("a6_neighbours", f"WITH {V.edge_sql()} SELECT src_name AS name, dep_type, list_sort(list(DISTINCT dst_name)) AS names, count(*) AS edges FROM edg GROUP BY ALL")
def _(spark, sf):
    return V.edges(spark, sf).groupBy(F.col("src_name").alias("name"), "dep_type").agg(F.array_sort(F.collect_set("dst_name")).alias("names"), F.count("*").alias("edges"))


@query(
    "a7_file_summary",
    f"""WITH {V.sym_sql()}, d AS (SELECT path, type, name, min((start_line, symbol_id)) AS pos FROM sym GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY path, type ORDER BY pos, name) AS rn, count(*) OVER (PARTITION BY path, type) AS n FROM d)
        SELECT path, type, string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 5) || CASE WHEN max(n) > 5 THEN ', ...' ELSE '' END AS names FROM r GROUP BY path, type""",
)
def _(spark, sf):
    d = V.symbols(spark, sf).groupBy("path", "type", "name").agg(F.min(F.struct("start_line", "symbol_id")).alias("pos"))
    w = Window.partitionBy("path", "type")
    r = d.withColumn("rn", F.row_number().over(w.orderBy("pos", "name"))).withColumn("n", F.count("*").over(w)).where("rn <= 5")
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"])
    return r.groupBy("path", "type").agg(F.concat(F.array_join(names, ", "), F.when(F.max("n") > 5, ", ...").otherwise("")).alias("names"))


@query(
    "a8_pass_rates",
    """WITH g AS (SELECT l_returnflag AS grp, sum((l_linestatus = 'F')::INT)::BIGINT AS passed, count(*) AS total FROM lineitem GROUP BY 1)
       SELECT grp, passed, total, passed / total AS rate FROM (SELECT * FROM g UNION ALL SELECT 'Overall', sum(passed)::BIGINT, sum(total)::BIGINT FROM g)""",
)
def _(spark, sf):
    return R.pass_rates(table(spark, sf, "lineitem").withColumn("grp", F.col("l_returnflag")), "grp", F.col("l_linestatus") == "F")


@query(
    "a10_ratio_rollup",
    f"""WITH {V.FILE_SQL}, g AS (SELECT project, sum(symbol_count)::BIGINT AS symbols, sum(total_nodes)::BIGINT AS nodes FROM fil GROUP BY 1)
        SELECT project, symbols, nodes, CASE WHEN nodes > 0 THEN symbols / nodes ELSE 0 END AS share FROM (SELECT * FROM g UNION ALL SELECT 'Overall', sum(symbols)::BIGINT, sum(nodes)::BIGINT FROM g)""",
)
def _(spark, sf):
    g = V.files(spark, sf).groupBy("project").agg(F.sum("symbol_count").alias("symbols"), F.sum("total_nodes").alias("nodes"))
    return R.with_overall(g, "project", ["symbols", "nodes"]).withColumn("share", R.ratio(F.col("symbols"), F.col("nodes"), 0.0))


@query(
    "a11_merged_groups",
    """WITH p AS (SELECT p_type AS k, p_size FROM part), m AS (SELECT k, CASE WHEN k LIKE 'SMALL%' THEN 'small-parts' WHEN k LIKE '%STEEL' THEN 'steel-parts' END AS m, p_size FROM p)
       SELECT coalesce(m, replace(k, '_', '-')) AS k, CASE WHEN m IS NULL THEN 0 ELSE 2 END AS place, sum(p_size)::BIGINT AS p_size FROM m WHERE k <> 'LARGE BRASS' GROUP BY ALL
       UNION ALL SELECT 'Overall', 1, sum(p_size)::BIGINT FROM m""",
)
def _(spark, sf):
    k = F.col("k")
    p = table(spark, sf, "part").select(F.col("p_type").alias("k"), F.col("p_size").cast("long").alias("p_size"))
    return R.merged_groups(p, "k", [(k.startswith("SMALL"), "small-parts"), (k.endswith("STEEL"), "steel-parts")], ["LARGE BRASS"], ["p_size"])


@query(
    "a12_tolerant_sum",
    """SELECT event_type, sum(CASE WHEN regexp_matches(v, '^\\d+$') THEN v::BIGINT ELSE floor(try_cast(v AS DOUBLE))::BIGINT END)::BIGINT AS total
       FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN (event_id * 2)::VARCHAR WHEN event_id % 3 = 1 THEN event_id || '.5' ELSE 'n/a' END AS v FROM events) GROUP BY event_type""",
)
def _(spark, sf):
    i = F.col("event_id")
    v = F.when(i % 3 == 0, (i * 2).cast("string")).when(i % 3 == 1, F.concat(i.cast("string"), F.lit(".5"))).otherwise("n/a")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(R.tolerant_number(v)).alias("total"))


@query("a13_line_ratio", f"WITH {V.FILE_SQL}, g AS (SELECT project, sum(symbol_count)::BIGINT AS a, sum(CASE WHEN parse_success THEN 0 ELSE file_size END)::BIGINT AS b FROM fil GROUP BY 1) SELECT project, a, b, CASE WHEN b > 0 THEN a / b END AS ratio FROM (SELECT * FROM g UNION ALL SELECT 'Overall', sum(a) FILTER (b > 0)::BIGINT, sum(b) FILTER (b > 0)::BIGINT FROM g)")
def _(spark, sf):
    f = V.files(spark, sf).groupBy("project").agg(F.sum("symbol_count").alias("a"), F.sum(F.when(F.col("parse_success"), F.lit(0)).otherwise(F.col("file_size"))).alias("b"))
    total = f.where("b > 0").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(F.lit(R.OVERALL).alias("project"), "a", "b")
    return f.unionByName(total).withColumn("ratio", R.ratio(F.col("a"), F.col("b")))


@query("a14_unweighted_mean", "SELECT avg(a) AS share FROM (SELECT avg((l_linestatus = 'F')::INT) AS a FROM lineitem UNION ALL SELECT avg((o_orderstatus = 'F')::INT) FROM orders)")
def _(spark, sf):
    a = table(spark, sf, "lineitem").agg(F.avg((F.col("l_linestatus") == "F").cast("int")).alias("share"))
    b = table(spark, sf, "orders").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    return R.unweighted_mean(a.unionByName(b), ["share"])


@query("a15_repeated_failures", "SELECT what, count(*) AS n FROM (SELECT regexp_extract(line, '^\\[\\w+\\] (?:error|warning): (.*\\S)', 1) AS what FROM run_logs) WHERE what <> '' GROUP BY what HAVING count(*) >= 2 ORDER BY n DESC, what LIMIT 10")
def _(spark, sf):
    f = table(spark, sf, "run_logs").select(F.regexp_extract("line", r"^\[\w+\] (?:error|warning): (.*\S)", 1).alias("what")).where("what <> ''")
    return R.repeated(f, "what", 2, 10)


@query(
    "a17_mean_depth",
    f"""WITH {V.sym_sql('full_definition')}, l AS (SELECT symbol_id, generate_subscripts(string_split(full_definition, chr(10)), 1) AS row, unnest(string_split(full_definition, chr(10))) AS line FROM sym WHERE full_definition <> ''),
        d AS (SELECT symbol_id, sum(len(replace(line, '}}', '')) - len(replace(line, '{{', ''))) OVER (PARTITION BY symbol_id ORDER BY row) AS depth FROM l)
        SELECT symbol_id, sum(depth)::BIGINT AS depths, count(*) AS lines, sum(depth) / count(*) AS mean_depth FROM d GROUP BY symbol_id""",
)
def _(spark, sf):
    s = V.symbols(spark, sf, "full_definition").where("full_definition <> ''").select("symbol_id", F.posexplode(F.split("full_definition", "\n")).alias("row", "line"))
    return R.mean_depth(s, "symbol_id", "row", "line")


@query("a18_name_types", f"WITH {V.sym_sql()} SELECT name, list_sort(list(DISTINCT type)) AS types, list_sort(list(DISTINCT path)) AS paths FROM sym GROUP BY name")
def _(spark, sf):
    return V.symbols(spark, sf).groupBy("name").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("path")).alias("paths"))


@query("a19_cycle_stats", "SELECT run_id, count(DISTINCT cycle_group_id) AS groups, count(DISTINCT batch_id) FILTER (is_cycle_group) AS batches, sum(len(cycle_group_files)) FILTER (is_cycle_group)::BIGINT AS files FROM (SELECT DISTINCT run_id, batch_id, is_cycle_group, cycle_group_id, cycle_group_files FROM symbol_batches) GROUP BY run_id")
def _(spark, sf):
    b = table(spark, sf, "symbol_batches").select("run_id", "batch_id", "is_cycle_group", "cycle_group_id", "cycle_group_files").dropDuplicates(["batch_id"])
    cyc = F.col("is_cycle_group")
    return b.groupBy("run_id").agg(F.countDistinct("cycle_group_id").alias("groups"), F.countDistinct(F.when(cyc, F.col("batch_id"))).alias("batches"), F.sum(F.when(cyc, F.size("cycle_group_files"))).alias("files"))


# Windows -------------------------------------------------------------------------------------------------

_MSG = "msg AS (SELECT user_id AS conv, event_id AS pos, CASE event_type WHEN 'error' THEN 'system' WHEN 'purchase' THEN 'system' WHEN 'click' THEN 'assistant' ELSE 'user' END AS role, event_type || ' ' || coalesce(props, '') AS content FROM events)"


def _messages(spark, sf):
    t = F.col("event_type")
    role = F.when(t.isin("error", "purchase"), "system").when(t == "click", "assistant").otherwise("user")
    e = table(spark, sf, "events").select("user_id", "event_id", role.alias("r"), F.concat(t, F.lit(" "), F.coalesce("props", F.lit(""))).alias("c"))
    return M.normal_messages(e, "user_id", "event_id", "r", "c")


@query(
    "w1_last_messages",
    f"""WITH {_MSG}, k AS (SELECT *, row_number() OVER (PARTITION BY conv, role = 'system' ORDER BY pos DESC) AS rn FROM msg)
        SELECT conv, pos, role, content, row_number() OVER (PARTITION BY conv ORDER BY role <> 'system', pos) AS ord FROM k WHERE role = 'system' OR rn <= 5""",
)
def _(spark, sf):
    return M.sliding_window(_messages(spark, sf), 5)


@query(
    "w2_token_budget",
    f"""WITH {_MSG}, t AS (SELECT *, greatest(1, ceil(length(content) / 4))::INT AS tok FROM msg),
        s AS (SELECT *, coalesce(sum(tok) FILTER (role = 'system') OVER (PARTITION BY conv), 0) AS sys FROM t),
        u AS (SELECT *, row_number() OVER w AS rn, sys + sum(tok) OVER w AS used FROM s WINDOW w AS (PARTITION BY conv, role = 'system' ORDER BY pos DESC))
        SELECT conv, pos, role, content, row_number() OVER (PARTITION BY conv ORDER BY role <> 'system', pos) AS ord FROM u WHERE role = 'system' OR (sys < 200 AND (used <= 200 OR rn = 1))""",
)
def _(spark, sf):
    return M.token_budget(_messages(spark, sf), 220, margin=20)


@query(
    "w4_summary",
    f"""WITH {_MSG}, n AS (SELECT *, row_number() OVER (PARTITION BY conv, role = 'system' ORDER BY pos) AS rn, count(*) FILTER (role <> 'system') OVER (PARTITION BY conv) AS n FROM msg),
        o AS (SELECT *, role <> 'system' AND n > 4 AND rn <= n - 3 AS old FROM n),
        k AS (SELECT conv, pos, role, content FROM o WHERE NOT old UNION ALL
              SELECT conv, max(pos), 'summary', 'Summary of ' || count(*) || ' messages: ' || string_agg(left(content, 40), ' / ' ORDER BY pos) FROM o WHERE old GROUP BY conv)
        SELECT conv, pos, role, content, row_number() OVER (PARTITION BY conv ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'summary' THEN 1 ELSE 2 END, pos) AS ord FROM k""",
)
def _(spark, sf):
    return M.checkpoint_summary(_messages(spark, sf), keep_recent=3, interval=2)


@query("w5_history", f"WITH {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos DESC) AS back FROM msg), k AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos) AS i FROM r WHERE back <= 4) SELECT conv, string_agg(i || '. ' || role || ': ' || content, chr(10) ORDER BY pos) AS text FROM k GROUP BY conv")
def _(spark, sf):
    return M.rendered_history(_messages(spark, sf), 4)


@query("w6_repeats", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE a = event_type AND b = event_type")
def _(spark, sf):
    return W.repeated_calls(table(spark, sf, "events"), ["user_id"], ["event_type"], 3, F.col("ts"), F.col("event_id")).select("event_id", "user_id", "event_type")


@query(
    "w7_sessions",
    """WITH s AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 7200 THEN 0 ELSE 1 END AS o FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT user_id, island, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY ALL""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))
    return W.islands(e, ["user_id"], F.col("sec"), F.lit(7200), F.col("sec"), F.col("event_id")).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("w10_refresh", "SELECT event_id, (floor((event_id - 1) / 3) * 3)::INT AS slot FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", W.refresh_slot(F.col("event_id")).alias("slot"))


@query("w11_first_seen", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    return W.first_seen(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query(
    "h18_prompt_pairs",
    "WITH t AS (SELECT user_id AS conv, event_id AS pos, event_type AS q, coalesce(props, '') AS a FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos DESC) AS rn FROM t), p AS (SELECT conv, pos, 0 AS k, 'user' AS role, q AS content FROM k WHERE rn <= 2 UNION ALL SELECT conv, pos, 1, 'assistant', a FROM k WHERE rn <= 2) SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY pos, k) AS ord, role, content FROM p",
)
def _(spark, sf):
    t = table(spark, sf, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("pos"), F.col("event_type").alias("question"), F.coalesce("props", F.lit("")).alias("answer"))
    return M.prompt_pairs(t, 2)


@query("x14_strategies", f"WITH {_MSG} SELECT conv, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conv, role = 'system' ORDER BY pos DESC) AS rn FROM msg) WHERE role = 'system' OR rn <= 3 GROUP BY conv")
def _(spark, sf):
    return M.strategy({"name": "sliding-window", "most": 3})(_messages(spark, sf)).groupBy("conv").agg(F.count("*").alias("kept"))


# Sorts and top-k -----------------------------------------------------------------------------------------


@query("t8_best_candidate", "SELECT user_id, arg_max(event_id, (event_type = 'purchase', coalesce(value, 0), -event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    rank = F.struct((F.col("event_type") == "purchase"), F.coalesce("value", F.lit(0.0)), -F.col("event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", rank).alias("event_id"))


@query("t9_overall_last", "SELECT grp, n FROM (SELECT l_shipmode AS grp, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1 UNION ALL SELECT 'Overall', count(*) FROM lineitem) ORDER BY grp = 'Overall', grp")
def _(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("grp")).agg(F.count("*").alias("n"))
    return R.overall_last(R.with_overall(g, "grp", ["n"]), "grp")


@query("t11_limit_flag", "SELECT doc_id, (SELECT count(*) FROM documents WHERE lang = 'fr') > 20 AS more FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20")
def _(spark, sf):
    from lodestrata.operators.sorts import limit_with_flag

    return limit_with_flag(table(spark, sf, "documents").where("lang = 'fr'").select("doc_id"), 20, "doc_id")


@query("t12_definitions", f"WITH {V.sym_sql('full_definition')} SELECT path, name, start_line FROM sym WHERE full_definition <> '' AND type = 'functions' ORDER BY path, start_line, name, symbol_id LIMIT 100")
def _(spark, sf):
    s = V.symbols(spark, sf, "full_definition").where("full_definition <> '' and type = 'functions'")
    return s.orderBy("path", "start_line", "name", "symbol_id").limit(100).select("path", "name", "start_line")


@query("t_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn <= 3")
def _(spark, sf):
    from lodestrata.operators.sorts import top_per_group

    return top_per_group(table(spark, sf, "lineitem"), ["l_suppkey"], 3, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


# Sets ------------------------------------------------------------------------------------------------------


@query("u1_edge_dedup", f"WITH {V.edge_sql()} SELECT src, dst, dep_type, arg_min(edge_id, edge_id) AS edge_id, arg_min(coalesce(start_line, -1), edge_id) AS start_line FROM edg GROUP BY src, dst, dep_type")
def _(spark, sf):
    e = V.edges(spark, sf).select("src", "dst", "dep_type", "edge_id", F.coalesce("start_line", F.lit(-1)).alias("start_line"))
    return e.groupBy("src", "dst", "dep_type").agg(F.min_by(F.struct("edge_id", "start_line"), "edge_id").alias("v")).select("src", "dst", "dep_type", "v.edge_id", "v.start_line")


@query("u2_last_wins", "SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderstatus = 'F', o_orderkey)) AS v FROM orders GROUP BY o_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    new = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return U.merge_last_wins(old, new, ["k"])


@query("u3_without_overall", "SELECT grp, n FROM (SELECT l_returnflag AS grp, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus || '-order', count(*) FROM orders GROUP BY 1) UNION ALL SELECT 'Overall', (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders)")
def _(spark, sf):
    a = R.with_overall(table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.count("*").alias("n")), "grp", ["n"])
    b = R.with_overall(table(spark, sf, "orders").groupBy(F.concat("o_orderstatus", F.lit("-order")).alias("grp")).agg(F.count("*").alias("n")), "grp", ["n"])
    return R.with_overall(R.without_overall(a.unionByName(b), "grp"), "grp", ["n"])


@query("u4_united_reports", "SELECT r_name AS Source, 'nations' AS Method, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1 UNION ALL SELECT r_name, 'customers', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def _(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("Source"))
    a = n.groupBy("Source").agg(F.count("*").alias("n"))
    b = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("Source").agg(F.count("*").alias("n"))
    return R.united({"nations": a, "customers": b})


@query("u5_added", f"WITH {V.sym_sql('extracted_at')} SELECT DISTINCT key FROM sym WHERE key NOT IN (SELECT key FROM sym WHERE extracted_at < TIMESTAMP '2026-01-01')")
def _(spark, sf):
    s = V.symbols(spark, sf, "extracted_at")
    return U.added_rows(s.select("key").distinct(), s.where("extracted_at < timestamp_ntz'2026-01-01 00:00:00'").select("key"), ["key"])


@query("u6_payloads", "SELECT props, min(event_id) AS event_id FROM events WHERE props IS NOT NULL GROUP BY props")
def _(spark, sf):
    e = table(spark, sf, "events").where("props is not null").select("props", "event_id")
    return U.distinct_payloads(e, "props", F.col("event_id"))


@query("u7_not_done", f"WITH {V.sym_sql()} SELECT symbol_id FROM sym WHERE symbol_id NOT IN (SELECT unnest(symbols).symbol_id FROM symbol_batches)")
def _(spark, sf):
    done = table(spark, sf, "symbol_batches").select(F.explode("symbols").alias("s")).select("s.symbol_id")
    return V.symbols(spark, sf).select("symbol_id").join(done, "symbol_id", "left_anti")


@query("u8_missing_sources", f"WITH {V.sym_sql('deleted_at')}, e AS (SELECT project AS dest, path FROM sym), c AS (SELECT DISTINCT project AS dest, path FROM sym WHERE deleted_at IS NULL) SELECT dest, list_sort(coalesce(list(DISTINCT path) FILTER (NOT ok), [])) AS missing FROM (SELECT e.dest, e.path, c.path IS NOT NULL AS ok FROM e LEFT JOIN c USING (dest, path)) GROUP BY dest")
def _(spark, sf):
    s = V.symbols(spark, sf, "deleted_at").select(F.col("project").alias("dest"), F.col("path").alias("source"), "deleted_at")
    return U.covered_sources(s, s.where("deleted_at is null"))


@query("u9_spans", f"WITH {V.sym_sql('start_byte', 'end_byte', 'full_definition')} SELECT path, start_byte, end_byte, arg_min(symbol_id, (NOT coalesce(full_definition <> '', false), symbol_id)) AS id FROM sym GROUP BY ALL")
def _(spark, sf):
    s = V.symbols(spark, sf, "start_byte", "end_byte", "full_definition").select(F.col("symbol_id").alias("id"), "path", "start_byte", "end_byte", F.coalesce(F.col("full_definition") != "", F.lit(False)).alias("is_definition"))
    return U.distinct_spans(s).select("path", "start_byte", "end_byte", "id")


@query("u10_columns", f"WITH {V.FILE_SQL} SELECT project AS Source, sum(file_size)::BIGINT AS Loc, sum(symbol_count)::BIGINT AS Fns FROM fil GROUP BY project")
def _(spark, sf):
    return V.files(spark, sf).groupBy(F.col("project").alias("Source")).agg(F.sum("file_size").alias("Loc"), F.sum("symbol_count").alias("Fns"))


@query("u_exact_copies", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    return d.groupBy("h", "m").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


QUERIES, ORACLE_SQL = Q, S
