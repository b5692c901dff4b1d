"""Set operations with a defined survivor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import canonical_json
from lodestrata.operators.predicates import one_per


def merge_last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two tables with equal columns; of equal keys the new row stays [U2]."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    packed = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_side").alias("_v"))
    return packed.select(*keys, "_v.*").select(*old.columns)


def added_rows(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``now`` whose keys a snapshot lacks [U5, U7]; null keys are equal to each other."""
    b = before.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return now.join(b, cond, "left_anti")


def distinct_payloads(df: DataFrame, payload: str, *order: Column) -> DataFrame:
    """The first row of each payload, which is the same whatever the order of its keys [U6]."""
    return one_per(df.withColumn("_canon", canonical_json(F.col(payload))), ["_canon"], *order).drop("_canon")


def distinct_spans(df: DataFrame) -> DataFrame:
    """One element per (path, start_byte, end_byte): definitions ahead of declarations, then by id [U9]."""
    return one_per(df, ["path", "start_byte", "end_byte"], F.col("is_definition").desc(), F.col("id"))


def covered_sources(expected: DataFrame, completed: DataFrame) -> DataFrame:
    """(dest, missing): expected sources, as arrays per destination, that aren't completed [U8]."""
    e = expected.groupBy("dest").agg(F.collect_set("source").alias("want"))
    c = completed.groupBy("dest").agg(F.collect_set("source").alias("have"))
    none = F.array().cast("array<string>")
    return e.join(c, "dest", "left").select("dest", F.array_sort(F.array_except(F.col("want").cast("array<string>"), F.coalesce(F.col("have").cast("array<string>"), none))).alias("missing"))
