"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = 1 << 30


def by_rank(df: DataFrame, ranks: DataFrame, key: str, position: str) -> DataFrame:
    """df in the order of ``ranks`` (key, rank); unknown keys come last, ties keep their position [T1]."""
    return df.join(ranks, key, "left").withColumn("rank", F.coalesce("rank", F.lit(LAST))).orderBy("rank", position)


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group in a total order; a hot group is cut to k by a local limit before it is gathered."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def limit_with_flag(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows and, in ``more``, whether there are further ones [T11]."""
    head = df.orderBy(*order).limit(n + 1)
    # At most n + 1 rows are left here, so a window over all of them is bounded.
    w = Window.partitionBy(F.lit(0))
    return head.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("more", F.count("*").over(w) > n).where(F.col("_rn") <= n).drop("_rn")


def best_candidate(df: DataFrame, keys: list[str], epsilon: float = 1e-6) -> DataFrame:
    """(keys, idx): success beats failure, then the larger score (differences up to epsilon don't count), then the first [T8].

    Scores are compared on a grid of epsilon, which makes "about equal" transitive.
    """
    rank = F.struct(F.col("success"), F.round(F.col("score") / epsilon), -F.col("idx"))
    return df.groupBy(*keys).agg(F.max_by("idx", rank).alias("idx"))
