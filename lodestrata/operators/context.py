"""What belongs to a symbol: its mapped targets, the snippets of its dependents, the context of a batch, and lists made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.joins import coalesced_lookup, snippets
from lodestrata.operators.predicates import one_per


def in_edge_snippets(edges: DataFrame, texts: DataFrame, offset: int = 0) -> DataFrame:
    """(dst, snippets): the lines around each edge that points to a node, in edge order; empty ones are left out [J6].

    edges: (edge_id, src, dst, start_line, end_line), texts: (path, lines). The lines are those of the source's file.
    """
    e = edges.where("start_line is not null").select(F.col("edge_id").alias("span_id"), "dst", F.split("src", ":", 3)[2].alias("path"), "start_line", "end_line")
    cut = snippets(e, texts, offset).where(F.trim("snippet") != "").join(e.select("span_id", "dst"), "span_id")
    return cut.groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("span_id", "snippet"))), lambda x: x["snippet"]).alias("snippets"))


def batch_contexts(items: DataFrame, symbols: DataFrame, contexts: DataFrame) -> DataFrame:
    """(batch, key, found, text): the symbols asked for by a batch with their context, each once; unknown ones stay, with '' [J7].

    items: (batch, pos, ref), a ref being a key or a bare name, which stands for the first registered symbol of that name;
    symbols: (key, name, reg_order), contexts: (key, text).
    """
    first = symbols.groupBy("name").agg(F.min_by("key", F.struct("reg_order", "key")).alias("by_name"))
    known = symbols.select(F.col("key").alias("ref"), F.lit(True).alias("is_key")).distinct()
    named = items.join(known, "ref", "left").join(first.withColumnRenamed("name", "ref"), "ref", "left")
    key = F.when(F.coalesce("is_key", F.lit(False)), F.col("ref")).otherwise(F.coalesce("by_name", "ref"))
    rows = named.select("batch", "pos", key.alias("key"), (F.coalesce("is_key", F.lit(False)) | F.col("by_name").isNotNull()).alias("found"))
    return one_per(rows, ["batch", "key"], F.col("pos")).join(contexts, "key", "left").select("batch", "key", "found", F.coalesce("text", F.lit("")).alias("text"))


def mapped_symbols(mapping: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, key, target): per name the first mapping with a target and the first registered symbol [J10]."""
    m = mapping.where("target is not null and target <> ''").groupBy("name").agg(F.min_by("target", F.struct(F.coalesce("path", F.lit("")), "target")).alias("target"))
    s = symbols.groupBy("name").agg(F.min_by("key", F.struct("reg_order", "key")).alias("key"))
    return s.join(m, "name").select("name", "key", "target")


def triple_lookup(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, key): by whole key, else by name, else by name without leading underscores in lower case; first registered wins [J16]."""

    def index(on: Column, out: str) -> DataFrame:
        return symbols.groupBy(on.alias("on")).agg(F.min_by("key", F.struct("reg_order", "key")).alias(out))

    def plain(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, "^_+", ""))

    r = refs.select("ref").distinct().withColumn("low", plain(F.col("ref")))
    a = r.join(index(F.col("key"), "k1").withColumnRenamed("on", "ref"), "ref", "left")
    b = a.join(index(F.col("name"), "k2").withColumnRenamed("on", "ref"), "ref", "left")
    c = b.join(index(plain(F.col("name")), "k3").withColumnRenamed("on", "low"), "low", "left")
    return c.select("ref", F.coalesce("k1", "k2", "k3").alias("key"))


def dependency_context(hops: DataFrame, mapping: DataFrame, code: DataFrame) -> DataFrame:
    """(start, node, target, code): what a symbol's dependencies became, distinct, without the symbol itself [J18].

    hops: (start, node, depth) of a traversal, mapping: (name, path, target), code: (target, code). Nodes without a target are left out.
    """
    n = hops.where("node <> start").select("start", "node", F.substring_index("node", ":", 1).alias("name"), F.split("node", ":", 3)[2].alias("path")).distinct()
    return coalesced_lookup(n, mapping).where("target is not null").join(code, "target", "left").select("start", "node", "target", "code").distinct()


def reverse_dependencies(targets: DataFrame, mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, dep): the targets of what the sources of a target depend on [J12]. targets: (target), mapping: (key, target), edges: (src, dst)."""
    m = mapping.where("target is not null")
    src = targets.join(m, "target").select("target", F.col("key").alias("src"))
    return src.join(edges.select("src", "dst"), "src").join(m.select(F.col("key").alias("dst"), F.col("target").alias("dep")), "dst").where("dep <> target").select("target", "dep").distinct()


def fix_targets(sources: list[DataFrame]) -> DataFrame:
    """(file, names): the names to work on per file, in the order of the given tables (file, name, pos), each once [H9, X31]."""
    out = None
    for k, s in enumerate(sources):
        rows = s.select("file", "name", F.struct(F.lit(k).alias("k"), "pos").alias("at"))
        out = rows if out is None else out.unionByName(rows)
    first = out.groupBy("file", "name").agg(F.min("at").alias("at"))
    return first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))


def module_lines(paths: DataFrame) -> DataFrame:
    """(dir, text): per directory the sorted ``pub mod x;`` lines of its distinct files [H27]."""
    from lodestrata.functions.text import module_name

    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = paths.select(F.regexp_extract("path", r"^(.*)/", 1).alias("dir"), module_name(stem).alias("m")).distinct()
    return rows.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: F.concat(F.lit("pub mod "), m, F.lit(";"))), "\n").alias("text"))


def prompt_items(groups: DataFrame, items: str) -> DataFrame:
    """(group, idx, name, content): the numbered items of each group; one without a name is ``item_i`` [H28]."""
    rows = groups.select("group", F.posexplode(items).alias("pos", "i"))
    idx = F.col("pos") + 1
    return rows.select("group", idx.alias("idx"), F.coalesce(F.nullif(F.col("i.name"), F.lit("")), F.concat(F.lit("item_"), idx.cast("string"))).alias("name"), F.col("i.content").alias("content"))


def entry_text(file: Column, start: Column, end: Column, code: Column) -> Column:
    """``- file:start-end`` and the code [H13]."""
    return F.concat(F.lit("- "), file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n"), code)


def numbered_trace(calls: DataFrame, most: int) -> DataFrame:
    """(conv, text): the last calls (conv, pos, name, args, result) as numbered lines [H11, H12, H17]."""
    w = Window.partitionBy("conv").orderBy(F.col("pos").desc())
    kept = calls.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    rows = F.array_sort(F.collect_list(F.struct("pos", "name", "args", "result")))
    line = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"], F.lit("("), x["args"], F.lit(") -> "), x["result"]))
    return kept.groupBy("conv").agg(F.array_join(line, "\n").alias("text"))
