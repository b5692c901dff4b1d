"""Joins beyond the plain equi-join: ranked best match, ranges, containment, nearest preceding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import common_suffix, dep_fits
from lodestrata.operators.predicates import is_test_path, one_per


def ranked_resolution(uses: DataFrame, registry: DataFrame) -> DataFrame:
    """(use_id, target): each use of a name resolved to ONE symbol, or none.

    uses: (use_id, name, src, path, dep_type); registry: (name, key, type, path, reg_order). Candidates share the name. In this order:
    one in the same file; one in the sibling header (every ``.c`` of a path that ends so becomes ``.h``); then, without test files
    unless the use stands in one, those whose type fits the dependency, if any does; of the rest the longest common path
    suffix. Ties go to the first registered. A symbol doesn't resolve to itself.

    What is resolved is the distinct (name, path, dep_type), which a map-side aggregate gives, so a name with a great many uses
    costs a row per file. Each is joined with its candidates as narrow rows and takes the least one by rank, a map-side aggregate again.
    """
    asked = uses.select("name", "path", "dep_type").distinct()
    c = registry.select("name", F.col("key").alias("ckey"), F.col("type").alias("ctype"), F.col("path").alias("cpath"), "reg_order")
    met = asked.join(c, "name")
    header = F.when(F.col("path").endswith(".c"), F.replace("path", F.lit(".c"), F.lit(".h")))
    same, sibling = F.col("cpath") == F.col("path"), F.coalesce(F.col("cpath") == header, F.lit(False))
    pooled = is_test_path(F.col("path")) | ~is_test_path(F.col("cpath"))
    fits = F.coalesce(dep_fits(F.col("dep_type"), F.col("ctype")), F.lit(True))
    # A pool counts only if it holds something; the ranks below keep the better pool ahead of the worse one.
    step = F.when(same, 0).when(sibling, 1).when(pooled & fits, 2).when(pooled, 3).when(fits, 4).otherwise(5)
    rank = F.struct(step.alias("step"), F.when(step < 2, 0).otherwise(-common_suffix(F.col("cpath"), F.col("path"))).alias("d"), "reg_order", "ckey")
    found = met.groupBy("name", "path", "dep_type").agg(F.min(rank).alias("best")).select("name", "path", "dep_type", F.col("best.ckey").alias("target"))
    keys = [F.col(f"u.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("name", "path", "dep_type")]
    met = uses.alias("u").join(found.alias("f"), keys[0] & keys[1] & keys[2])
    return met.where("f.target <> u.src").select("u.use_id", "f.target")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends (src, dst) are among the nodes (key)."""
    n = nodes.select("key").distinct()
    return edges.join(n.withColumnRenamed("key", "src"), "src", "left_semi").join(n.withColumnRenamed("key", "dst"), "dst", "left_semi")


def snippets(spans: DataFrame, texts: DataFrame, offset: int = 0) -> DataFrame:
    """(span_id, snippet): the lines [start-offset, end+offset] of the file's text, cut to what exists; spans: (span_id, path, start_line, end_line), texts: (path, lines array).

    The lines of a file are one array, so a range of them is a slice, not a range join.
    """
    j = spans.join(texts, "path")
    lo = F.greatest(F.col("start_line") - offset, F.lit(1))
    hi = F.least(F.coalesce("end_line", "start_line") + offset, F.size("lines"))
    return j.where(lo <= F.size("lines")).select("span_id", F.array_join(F.slice("lines", lo, F.greatest(hi - lo + 1, F.lit(0))), "\n").alias("snippet"))


def enclosing(points: DataFrame, spans: DataFrame, bucket: int = 256) -> DataFrame:
    """(point_id, key): the narrowest span around each point of the same file; where none is, the one around the next line.

    points: (point_id, path, line), spans: (path, key, start_line, end_line). An equi-join on file and block of lines; a span
    is listed in each block that it touches.
    """
    s = spans.where("start_line <= end_line").select("path", "key", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("block"))
    p = points.select("point_id", "path", F.explode(F.array(F.struct(F.lit(0).alias("shift"), F.col("line").alias("at")), F.struct(F.lit(1).alias("shift"), (F.col("line") + 1).alias("at")))).alias("p")).select("point_id", "path", "p.shift", "p.at")
    met = p.withColumn("block", F.floor(F.col("at") / bucket)).join(s, ["path", "block"]).where("at between start_line and end_line")
    return met.groupBy("point_id").agg(F.min_by("key", F.struct("shift", F.expr("end_line - start_line"), "start_line", "key")).alias("key"))


def outermost(elements: DataFrame) -> DataFrame:
    """Elements (id, path, type, start_line, end_line) not strictly within another of their file; a struct within a struct or typedef stays.

    Sorted by (start, -end) a span lies within an earlier one exactly if some earlier end reaches its own: running maxima
    replace the pairwise test. Equal spans don't contain each other; they sort side by side, so all of them take over
    the maximum that the first of them sees.
    """
    before = Window.partitionBy("path").orderBy("start_line", F.col("end_line").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    twins = Window.partitionBy("path", "start_line", "end_line").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    holds = F.col("type").isin("structs", "typedefs")
    rows = elements.withColumn("_other", F.max(F.when(~holds, F.col("end_line"))).over(before)).withColumn("_holder", F.max(F.when(holds, F.col("end_line"))).over(before))
    rows = rows.withColumn("_other", F.first("_other").over(twins)).withColumn("_holder", F.first("_holder").over(twins))
    inside = (F.col("_other") >= F.col("end_line")) | ((F.col("_holder") >= F.col("end_line")) & (F.col("type") != "structs"))
    return rows.where(~F.coalesce(inside, F.lit(False))).select(*elements.columns)


def preceding_notes(targets: DataFrame, notes: DataFrame, most: int = 3, gap: int = 2) -> DataFrame:
    """(target_id, note): the comment block ahead of each target: one that ends 1 to ``most`` lines before it, and further ones no more than ``gap`` lines apart, joined by blanks.

    targets: (target_id, path, start_line), notes: (path, start_line, end_line, text). Notes are first cut into blocks
    (gaps and islands); a target then looks up the block by the lines it may end on: an equi-join.
    """
    w = Window.partitionBy("path").orderBy("start_line", "end_line")
    opened = F.coalesce(F.col("start_line") - F.lag("end_line").over(w) > gap, F.lit(True)).cast("int")
    blocks = notes.withColumn("opened", opened).withColumn("block", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = blocks.withColumn("k", F.row_number().over(Window.partitionBy("path", "block").orderBy("start_line", "end_line"))).select("path", "block", "k", F.col("end_line").alias("at"), "start_line")
    whole = blocks.groupBy("path", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "text"))), lambda x: x["text"]).alias("texts"))
    reach = targets.select("target_id", "path", F.explode(F.sequence(F.col("start_line") - most, F.col("start_line") - 1)).alias("at"))
    # A target first chooses its last note; the texts of a block are joined to what is chosen alone.
    last = reach.join(ends, ["path", "at"]).groupBy("target_id", "path").agg(F.max(F.struct("at", "start_line", "block", "k")).alias("n"))
    return last.select("target_id", "path", "n.block", "n.k").join(whole, ["path", "block"]).select("target_id", F.array_join(F.slice("texts", F.lit(1), F.col("k")), " ").alias("note"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with ``value`` of the latest right row of its keys at or before ``at``: one sorted sweep over the union, no range join."""
    rows = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def coalesced_lookup(left: DataFrame, mapping: DataFrame) -> DataFrame:
    """left (name, path, ...) with ``target``: of the mapping row (name, path), else of the first row (by path) with the same name."""
    exact = one_per(mapping.where("path is not null").select("name", "path", F.col("target").alias("t1")), ["name", "path"], F.col("t1"))
    by_name = mapping.groupBy("name").agg(F.min_by("target", F.struct(F.coalesce("path", F.lit("")), "target")).alias("t2"))
    return left.join(exact, ["name", "path"], "left").join(by_name, "name", "left").withColumn("target", F.coalesce("t1", "t2")).drop("t1", "t2")


def reverse_mapping(mapping: DataFrame) -> DataFrame:
    """(target, keys): which keys map to each target; null targets are left out."""
    return mapping.where("target is not null").groupBy("target").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def batch_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (src_batch, dst_batch) of edges (src, dst) between members (key, batch) of different batches."""
    m = members.select("key", "batch").distinct()
    a = edges.join(m.select(F.col("key").alias("src"), F.col("batch").alias("src_batch")), "src")
    b = a.join(m.select(F.col("key").alias("dst"), F.col("batch").alias("dst_batch")), "dst")
    return b.where("src_batch <> dst_batch").select("src_batch", "dst_batch").distinct()


def complete_groups(expected: DataFrame, completed: DataFrame) -> DataFrame:
    """(dest): destinations all of whose expected sources are completed; both have (dest, source)."""
    missing = expected.select("dest", "source").distinct().join(completed.select("dest", "source").distinct(), ["dest", "source"], "left_anti").select("dest")
    return expected.select("dest").distinct().join(missing, "dest", "left_anti")
