"""References to symbols: the symbols and spans they stand for, usages and diagnostics of offline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import severity
from lodestrata.operators.predicates import at_least_severity


def symbols_of_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (ref, name, type, path) with the first symbol_id of that name, type and path; a ref that lacks one of them, or meets none, is left out [H5]."""
    first = symbols.groupBy("name", "type", "path").agg(F.min("symbol_id").alias("symbol_id"))
    whole = refs.where("coalesce(name, '') <> '' and coalesce(type, '') <> '' and coalesce(path, '') <> ''")
    return whole.join(first, ["name", "type", "path"]).select(*refs.columns, "symbol_id")


def resolved_spans(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, start_line, end_line): the lines of the symbol itself or, failing that, of the first of its name in the same file; null for neither [H8]."""
    span = F.struct("start_line", "end_line")
    own = symbols.groupBy("name", "type", "path").agg(F.min_by(span, "symbol_id").alias("own"))
    other = symbols.groupBy("name", "path").agg(F.min_by(span, "symbol_id").alias("other"))
    met = refs.join(own, ["name", "type", "path"], "left").join(other, ["name", "path"], "left")
    return met.select("ref", *[F.coalesce(F.col(f"own.{c}"), F.col(f"other.{c}")).alias(c) for c in ("start_line", "end_line")])


def usages(places: DataFrame, most: int) -> DataFrame:
    """(symbol, uri, line, character, truncated): the first ``most`` distinct places of each symbol, and whether there are more [X24]."""
    u = places.select("symbol", "uri", "line", "character").distinct()
    counts = u.groupBy("symbol").agg((F.count("*") > most).alias("truncated"))
    ranked = u.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy("uri", "line", "character"))).where(F.col("_rn") <= most)
    return ranked.join(counts, "symbol").select("symbol", "uri", "line", "character", "truncated")


def diagnostics(rows: DataFrame, least: str = "warning") -> DataFrame:
    """Rows whose ``severity`` (1 is the most severe) is that of ``least`` or worse, each once; rows without a severity pass [X25]."""
    bound = rows.sparkSession.range(1).select(severity(F.lit(least)).alias("s")).first()["s"]
    return rows.where(at_least_severity(F.col("severity"), bound)).dropDuplicates()
