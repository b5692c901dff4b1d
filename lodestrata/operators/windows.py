"""Windows over ordered rows: last-n, budgets, repeats, gaps and islands, merging of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.predicates import one_per


def last_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The last n rows of each group, by a total order (given ascending)."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_seen(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key: ordered removal of repeats [W11, U1]."""
    return one_per(df, keys, *order)


def repeated_calls(df: DataFrame, keys: list[str], call: list[str], k: int, *order: Column) -> DataFrame:
    """Rows that end a stretch of k equal calls of their group [W6]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for i in range(1, k):
        for c in call:
            same = same & F.lag(c, i).over(w).eqNullSafe(F.col(c))
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_same", same).where(F.col("_same") & (F.col("_n") >= k)).drop("_n", "_same")


def islands(df: DataFrame, keys: list[str], at: Column, gap: Column, *order: Column) -> DataFrame:
    """df with ``island``: a new one opens where the step from the row before exceeds the gap [W7]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = at - F.lag(at).over(w)
    opened = F.when(step.isNull() | (step > gap), 1).otherwise(0)
    return df.withColumn("_open", opened).withColumn("island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def merge_impls(matches: DataFrame) -> DataFrame:
    """(file, name, kind, start_line, end_line, code): a Struct takes in the Impl rows of its name that follow it directly in the file [W8]."""
    w = Window.partitionBy("file").orderBy("start_line", "kind", "name", "end_line")
    run = matches.withColumn("_pos", F.row_number().over(w)).withColumn("_is_impl", F.col("kind") == "Impl")
    # A row goes on with the group before it if it is an Impl of the name of the last Struct and only such rows lie between.
    run = run.withColumn("_brk", F.when(F.col("_is_impl") & F.lag("name").over(w).eqNullSafe(F.col("name")) & F.lag("kind").over(w).isin("Struct", "Impl"), 0).otherwise(1))
    run = run.withColumn("_grp", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = Window.partitionBy("file", "_grp").orderBy("_pos")
    run = run.withColumn("_head", F.first("kind").over(head)).withColumn("_out", F.when(F.col("_head") == "Struct", F.col("_grp").cast("string")).otherwise(F.concat_ws("/", "_grp", "_pos")))
    glued = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_pos", "code"))), F.lit(""), lambda a, x: F.when(a == "", x["code"]).otherwise(F.concat(a, F.when(a.endswith("\n"), "").otherwise("\n"), x["code"]))
    )
    g = run.groupBy("file", "_out").agg(F.min_by("name", "_pos").alias("name"), F.min_by("kind", "_pos").alias("kind"), F.min("start_line").alias("start_line"), F.max_by("end_line", "_pos").alias("end_line"), glued.alias("code"))
    return g.select("file", "name", "kind", "start_line", "end_line", "code")


def refresh_slot(n: Column, every: int = 3) -> Column:
    """The attempt whose context serves attempt n: it is renewed at every third [W10]."""
    return (F.floor((n - 1) / every) * every).cast("int")
