"""The test tables in normal form, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.model import is_blank, normal_key, normal_path, normal_type
from lodestrata.plans.sqltext import key_sql, path_sql, type_sql
from lodestrata.session import table


def symbols(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """(symbol_id, key, name, type, path, project, start_line, end_line, *extra): each symbol once."""
    # Repeats are exact, so they go before any expression is worked out, by a hash aggregate.
    s = table(spark, sf, "symbols").select("symbol_id", "symbol_key", "name", "type", "file_path", "project", "start_line", "end_line", *extra).distinct()
    return s.select(
        "symbol_id", normal_key(F.col("symbol_key")).alias("key"), "name", normal_type(F.col("type")).alias("type"), normal_path(F.col("file_path")).alias("path"),
        "project", "start_line", "end_line", *extra,
    )


def edges(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """(edge_id, src, dst, src_name, dst_name, dep_type, start_line, end_line, project, *extra): each edge with two keys once."""
    e = table(spark, sf, "edges").select("edge_id", "source", "target", "dep_type", "start_line", "end_line", "project", *extra).distinct()
    e = e.where(~is_blank(F.col("source")) & ~is_blank(F.col("target")))
    e = e.select("edge_id", normal_key(F.col("source")).alias("src"), normal_key(F.col("target")).alias("dst"), "dep_type", "start_line", "end_line", "project", *extra)
    return e.withColumns({"src_name": F.substring_index("src", ":", 1), "dst_name": F.substring_index("dst", ":", 1)})


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst) of each edge with two keys, repeats included, so nothing is shuffled."""
    e = table(spark, sf, "edges").select("source", "target").where(~is_blank(F.col("source")) & ~is_blank(F.col("target")))
    return e.select(normal_key(F.col("source")).alias("src"), normal_key(F.col("target")).alias("dst"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Each analysed file once."""
    return table(spark, sf, "file_analysis").dropDuplicates(["file_path", "project", "analyzed_at"])


def sym_sql(*extra: str) -> str:
    more = "".join(f", {x}" for x in extra)
    return f"""sym AS (SELECT DISTINCT symbol_id, {key_sql("symbol_key")} AS key, name, {type_sql("type")} AS type, {path_sql("file_path")} AS path, project, start_line, end_line{more} FROM symbols)"""


def edge_sql(*extra: str) -> str:
    more = "".join(f", {x}" for x in extra)
    return f"""edg AS (SELECT *, split_part(src, ':', 1) AS src_name, split_part(dst, ':', 1) AS dst_name FROM (
        SELECT DISTINCT edge_id, {key_sql("source")} AS src, {key_sql("target")} AS dst, dep_type, start_line, end_line, project{more} FROM edges) WHERE src IS NOT NULL AND dst IS NOT NULL)"""


FILE_SQL = "fil AS (SELECT DISTINCT * FROM file_analysis)"
LINE_SQL = "lin AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"
