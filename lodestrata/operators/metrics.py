"""Code metrics: safety of lines and references, per file and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import raw_pointer_count, safe_ref_count, scrub_code, unsafe_ref_count
from lodestrata.operators.reports import OVERALL, ratio

_STATE = "struct<armed:boolean,depth:int,lines:int,unsafe:int,inline:int>"


def unsafe_lines(lines: Column) -> Column:
    """struct(lines, unsafe, inline) of scrubbed, non-empty lines: a fold over one file's lines [F20].

    ``unsafe`` outside a scope arms, the next ``{`` opens the scope; a line counts if the scope is open at its end, so
    ``unsafe { x }`` in one line and the closing line don't count. ``inline`` counts the lines that open and close a scope
    within themselves, which a corrected figure adds.
    """
    start = F.struct(F.lit(False).alias("armed"), F.lit(0).alias("depth"), F.lit(0).alias("lines"), F.lit(0).alias("unsafe"), F.lit(0).alias("inline")).cast(_STATE)

    def line_step(s: Column, line: Column) -> Column:
        arms = s["armed"] | (line.rlike(r"\bunsafe\b") & (s["depth"] == 0))
        braces = F.split(F.regexp_replace(line, "[^{}]", ""), "")
        inner = F.struct(arms.alias("armed"), s["depth"].alias("depth"), F.lit(False).alias("opened")).cast("struct<armed:boolean,depth:int,opened:boolean>")

        def brace_step(t: Column, c: Column) -> Column:
            opens = (c == "{") & t["armed"]
            depth = F.when(opens, 1).when((c == "{") & (t["depth"] > 0), t["depth"] + 1).when((c == "}") & (t["depth"] > 0), t["depth"] - 1).otherwise(t["depth"])
            return F.struct((t["armed"] & ~opens).alias("armed"), depth.cast("int").alias("depth"), (t["opened"] | opens).alias("opened"))

        after = F.aggregate(braces, inner, brace_step)
        return F.struct(
            after["armed"].alias("armed"), after["depth"].alias("depth"), (s["lines"] + 1).alias("lines"), (s["unsafe"] + F.when(after["depth"] > 0, 1).otherwise(0)).cast("int").alias("unsafe"),
            (s["inline"] + F.when(after["opened"] & (after["depth"] == 0), 1).otherwise(0)).cast("int").alias("inline"),
        )

    return F.aggregate(lines, start, line_step)


def safety_by_file(files: DataFrame, name: str, text: str) -> DataFrame:
    """(name, total_lines, unsafe_lines, inline_unsafe, safe_refs, unsafe_refs, raw_pointers) of each text; no shuffle [A9]."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n"), scrub_code), lambda x: x != "")
    rows = files.where(F.col(text).isNotNull()).select(F.col(name).alias(name), lines.alias("_lines"))

    def total(count) -> Column:
        return F.aggregate("_lines", F.lit(0), lambda a, x: a + count(x))

    folded = rows.withColumn("_u", unsafe_lines(F.col("_lines")))
    return folded.select(
        name, F.col("_u.lines").alias("total_lines"), F.col("_u.unsafe").alias("unsafe_lines"), F.col("_u.inline").alias("inline_unsafe"), total(safe_ref_count).alias("safe_refs"),
        total(unsafe_ref_count).alias("unsafe_refs"), total(raw_pointer_count).alias("raw_pointers"),
    )


def safety_report(per_file: DataFrame, name: str) -> DataFrame:
    """Per file and overall, from summed counts: the share of safe lines (0 without lines) and of safe references (1 without any) [A10, H14]."""
    sums = ["total_lines", "unsafe_lines", "safe_refs", "unsafe_refs"]
    rows = per_file.select(F.col(name).cast("string").alias(name), *[F.col(c).cast("bigint").alias(c) for c in sums])
    rows = rows.unionByName(rows.agg(*[F.sum(c).alias(c) for c in sums]).select(F.lit(OVERALL).alias(name), *sums))
    safe = F.greatest(F.col("total_lines") - F.col("unsafe_lines"), F.lit(0))
    refs = F.col("safe_refs") + F.col("unsafe_refs")
    return rows.withColumns({"safe_lines": safe, "safe_line_share": ratio(safe, F.col("total_lines"), 0.0), "safe_ref_share": ratio(F.col("safe_refs"), refs, 1.0)})
