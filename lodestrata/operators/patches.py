"""Patches and candidates of changes: hunk counts, summaries, and the files that paths stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The words of a summary.
SYMBOLS, IMPORTS, NOTHING = "符号: ", "调整导入", "无显著变更"

_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def recounted_patches(patches: DataFrame) -> DataFrame:
    """(patch_id, text, changed): patches (patch_id, text) whose hunk headers state the lines that the hunks have [F28].

    A header that is right, or that can't be read, stays as it is; a count of 1 is left out. Null texts give no rows, equal ids are one patch each.
    """
    lines = patches.where("text is not null").select("patch_id", "text", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    one = Window.partitionBy("patch_id", "text").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("hunk", F.sum(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(one))
    hunk = Window.partitionBy("patch_id", "text", "hunk")
    old, new = [F.count(F.when(F.col("line").rlike(f"^[ {sign}]"), 1)).over(hunk) for sign in ("-", "+")]
    lines = lines.withColumns({"old": old, "new": new})
    start = [F.regexp_extract("line", _HEADER, i) for i in (1, 3)]
    stated = [F.coalesce(F.regexp_extract("line", _HEADER, i).try_cast("int"), F.lit(1)) for i in (2, 4)]

    def spelled(n: str):
        return F.when(F.col(n) == 1, "").otherwise(F.concat(F.lit(","), F.col(n).cast("string")))

    wrong = F.col("line").rlike(_HEADER) & ((stated[0] != F.col("old")) | (stated[1] != F.col("new")))
    header = F.concat(F.lit("@@ -"), start[0], spelled("old"), F.lit(" +"), start[1], spelled("new"), F.lit(" @@"))
    rows = lines.select("patch_id", F.col("text").alias("before"), "row", wrong.alias("wrong"), F.when(wrong, header).otherwise(F.col("line")).alias("line"))
    whole = rows.groupBy("patch_id", "before").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"), F.max("wrong").alias("changed"))
    return whole.select("patch_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), "changed")


def change_summaries(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """(candidate, text): the files that each candidate changes with the symbols in them, in order of ``pos`` [F37].

    candidates: (candidate); changes: (candidate, pos, file, symbols, imports), imports telling whether imports change. A candidate without files changes nothing.
    """
    notes = F.array_compact(F.array(F.when(F.size(F.coalesce("symbols", F.array())) > 0, F.concat(F.lit(SYMBOLS), F.array_join("symbols", ", "))), F.when(F.col("imports"), IMPORTS)))
    entry = F.when(F.size(notes) > 0, F.concat("file", F.lit(" ("), F.array_join(notes, "; "), F.lit(")"))).otherwise(F.col("file"))
    texts = changes.where("file is not null").select("candidate", "pos", entry.alias("entry")).groupBy("candidate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]), "; ").alias("text"))
    return candidates.select("candidate").distinct().join(texts, "candidate", "left").select("candidate", F.coalesce("text", F.lit(NOTHING)).alias("text"))


def resolved_paths(wanted: DataFrame, existing: DataFrame, folders: tuple[str, ...] = ("", "src/")) -> DataFrame:
    """(name, path): the first existing of the paths that a name may stand for, else the name below its first base [F7].

    wanted: (name, bases), bases an array in order of preference; each base is tried with every folder; existing: (path). An absolute name that exists is
    itself, and so is a name without bases.
    """
    below = F.flatten(F.transform("bases", lambda b: F.array(*[F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/" + f), F.col("name")) for f in folders])))
    own = F.when(F.col("name").startswith("/"), F.array("name")).otherwise(F.array().cast("array<string>"))
    tried = wanted.where("name is not null").select("name", F.posexplode(F.concat(own, F.coalesce(below, F.array().cast("array<string>")), F.array("name"))).alias("pos", "path"))
    found = tried.join(existing.select("path").distinct(), "path", "left_semi").groupBy("name").agg(F.min_by("path", "pos").alias("found"))
    first = F.when(F.col("name").startswith("/") | (F.size(F.coalesce("bases", F.array())) == 0), F.col("name")).otherwise(F.concat(F.regexp_replace(F.element_at("bases", 1), "/+$", ""), F.lit("/"), F.col("name")))
    return wanted.where("name is not null").select("name", first.alias("first")).groupBy("name").agg(F.min("first").alias("first")).join(found, "name", "left").select("name", F.coalesce("found", "first").alias("path"))
