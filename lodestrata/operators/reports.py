"""Reports: grouped figures with an overall row, ratios, unions and merges of tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERALL = "Overall"


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; ``empty`` (null by default) where the whole is not positive [H15]."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def with_overall(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """The rows and an overall row of the sums of ``sums`` [A10]."""
    total = rows.agg(*[F.sum(c).alias(c) for c in sums]).select(F.lit(OVERALL).alias(key), *sums)
    return rows.select(key, *sums).unionByName(total)


def pass_rates(df: DataFrame, key: str, passed: Column) -> DataFrame:
    """(key, passed, total, rate) per group and overall; groups without rows don't appear [A8]."""
    g = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.sum(passed.cast("long")).alias("passed"), F.count("*").alias("total"))
    return with_overall(g, key, ["passed", "total"]).withColumn("rate", ratio(F.col("passed"), F.col("total")))


def overall_last(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in key order, overall rows last [T9]."""
    return df.orderBy(F.col(keys[0]) == OVERALL, *keys)


def without_overall(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) != OVERALL)


def united(reports: dict[str, DataFrame], tag: str = "Method") -> DataFrame:
    """The union of reports, each with its name in the column ``tag``; missing columns are null [U4]."""
    out = None
    for name in sorted(reports):
        r = reports[name].withColumn(tag, F.lit(name))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    return out


def merge_reports(left: DataFrame, right: DataFrame, key: str = "Source") -> DataFrame:
    """The inner merge of two reports [J17]."""
    return left.join(right, key, "inner")


def tolerant_number(c: Column) -> Column:
    """A whole number from its text, from the text of a decimal number, else null [A12]."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), c.try_cast("long")).otherwise(F.floor(c.try_cast("double")).cast("long"))


def improvement(before: Column, after: Column) -> Column:
    """The difference of two percent figures, rounded to one place, with a plus sign ahead [F2]."""
    return F.concat(F.lit("+"), F.round(after - before, 1).cast("string"))


def unweighted_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """The plain mean of overall figures of several suites, whatever their sizes [A14]."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def merged_groups(df: DataFrame, key: str, rules: list[tuple[Column, str]], dropped: list[str], sums: list[str]) -> DataFrame:
    """(key, *sums, place): rows merged under the name of the first rule that holds; dropped keys leave the rows but not the overall sum.

    place: 0 for plain rows, 1 for the overall row, 2 for merged rows, which come last [A11].
    """
    merged = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        merged = F.when(cond, F.lit(name)).otherwise(merged)
    plain = F.replace(F.col(key), F.lit("_"), F.lit("-"))
    rows = df.withColumn("_m", merged)
    kept = rows.where(~F.col(key).isin(*dropped))
    g = kept.groupBy(F.coalesce("_m", plain).alias(key), F.when(F.col("_m").isNotNull(), 2).otherwise(0).alias("place")).agg(*[F.sum(c).alias(c) for c in sums])
    return g.unionByName(rows.agg(*[F.sum(c).alias(c) for c in sums]).withColumns({key: F.lit(OVERALL), "place": F.lit(1)}))


def repeated(df: DataFrame, col: str, least: int, most: int) -> DataFrame:
    """(col, n): the ``most`` values that occur ``least`` times or more, most frequent first, ties by value [A15]."""
    return df.groupBy(col).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), col).limit(most)


def mean_depth(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, depths, lines, mean_depth): how deep the lines of a text are nested at their ends, by braces [A17]."""
    opens = F.length(F.replace(line, F.lit("}"), F.lit(""))) - F.length(F.replace(line, F.lit("{"), F.lit("")))
    depth = F.sum(opens).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    g = lines.select(key, depth.alias("_d")).groupBy(key).agg(F.sum("_d").alias("depths"), F.count("*").alias("lines"))
    return g.withColumn("mean_depth", F.col("depths") / F.col("lines"))


def percent_text(c: Column) -> Column:
    """``12.34%`` of a ratio, rounded from the binary number as Python does [F1]; for the last step of a report."""

    def fmt(x):
        return x.map(lambda v: None if v is None or v != v else f"{v * 100:.2f}%")

    fmt.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(fmt, "string")(c)
