"""Sources and sinks: file scans, line and byte ranges, CSV and JSON sinks, project reconstruction."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import ship

TEXT_LIMIT = 64_000
BINARY_KINDS = {"pdf", "doc", "xls", "xlsx", "ppt", "pptx"}


def scan_files(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """(path, length, modified, content): all files below the root with one of the suffixes, in any case; raises if there is none."""
    wanted = [s.lower() if s.startswith(".") else f".{s.lower()}" for s in suffixes]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hits = df.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*wanted)).select("path", "length", F.col("modificationTime").alias("modified"), "content")
    if hits.drop("content").limit(1).isEmpty():
        raise FileNotFoundError(f"no file with suffix {', '.join(wanted)} in {root}")
    return hits


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where that fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_documents(spark: SparkSession, root: str, suffixes: list[str], converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, kind, text): text documents by extension; files of a kind with a converter, as docx has, become text by it, one worker each.

    Binary formats without a converter, such as pdf, raise; other formats are read as text.
    """
    known = {"docx": docx_markdown, **(converters or {})}
    wanted = {s.lower().lstrip(".") for s in suffixes}
    if wanted & BINARY_KINDS - set(known):
        raise ValueError(f"no converter for {', '.join(sorted(wanted & BINARY_KINDS - set(known)))}")
    files = scan_files(spark, root, suffixes)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    converted = sorted(wanted & set(known))
    plain = files.where(~kind.isin(*converted)) if converted else files
    plain = plain.select("path", kind.alias("kind"), decoded(F.col("content")).alias("text"))
    if not converted:
        return plain
    import pandas as pd

    def convert(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "kind": b["kind"], "text": [known[k](bytes(c)) for k, c in zip(b["kind"], b["content"])]})

    ship(files.sparkSession)
    return plain.unionByName(files.where(kind.isin(*converted)).select("path", kind.alias("kind"), "content").mapInPandas(convert, "path string, kind string, text string"))


def docx_markdown(content: bytes) -> str:
    """The paragraphs of a docx file; headings get as many ``#`` as their level."""
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    ns = {"w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main"}
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for p in root.iterfind(".//w:p", ns):
        text = "".join(t.text or "" for t in p.iterfind(".//w:t", ns))
        style = p.find("w:pPr/w:pStyle", ns)
        level = re.search(r"[Hh]eading\s*(\d)", style.get(f"{{{ns['w']}}}val") or "") if style is not None else None
        if text.strip():
            out.append(f"{'#' * int(level.group(1))} {text}" if level else text)
    return "\n".join(out)


def line_range(lines: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Lines ``start`` to ``end``, both counted from 1; a start below 1 is 1, no end means the last line."""
    hit = F.col("line_no") >= max(start, 1)
    return lines.where(hit if end is None else hit & (F.col("line_no") <= end))


def capped_text(text: Column, limit: int = TEXT_LIMIT) -> Column:
    """At most ``limit`` characters, with a marker where more were cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated]"))).otherwise(text)


def byte_range(content: Column, start: int, end: int) -> Column:
    """Bytes from ``start`` (counted from 0) up to ``end``."""
    return F.substring(content, start + 1, end - start)


def directory_listing(files: DataFrame) -> DataFrame:
    """(name, length, lines) sorted by name."""
    text = decoded(F.col("content"))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)).alias("lines")).orderBy("name")


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "overwrite") -> bool:
    """A small report as one CSV file with a header. Without rows and without given fields nothing is written."""
    if fields is None and df.limit(1).isEmpty():
        return False
    (df.select(*fields) if fields else df).coalesce(1).write.mode(mode).csv(path, header=True, escape='"')
    return True


def append_csv(df: DataFrame, path: str) -> None:
    """Rows for a growing CSV table; every part file carries the header, which the reader drops."""
    df.write.mode("append").csv(path, header=True, escape='"')


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics table from a file or a folder of CSV files."""
    return spark.read.csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one folder of part files."""
    df.write.mode("overwrite").json(path)


def reconstruct(elements: DataFrame) -> DataFrame:
    """(path, text): each file from its elements (path, type, start_line, text) in line order, a section header where the type changes.

    A file is rebuilt by one task; it is as large as one file.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("start_line", "type", "text")
    head = F.lag("type").over(w)
    part = F.when(head.isNull() | (head != F.col("type")), F.concat(F.lit("/* "), F.col("type"), F.lit(" */\n"), F.col("text"))).otherwise(F.col("text"))
    rows = elements.withColumn("part", part).withColumn("pos", F.row_number().over(w))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts")).select("path", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("text"))


def reassemble(spans: DataFrame) -> DataFrame:
    """(path, text): files from (path, content, start, end, piece) by byte order; what lies between the pieces is copied from ``content``.

    A piece that begins before the one ahead of it has ended gives up the part in common.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("start", "end")
    covered = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = spans.withColumn("from_", covered).withColumn("gap", F.expr("substring(content, from_ + 1, greatest(start - from_, 0))")).withColumn("own", F.expr("substring(piece, greatest(from_ - start, 0) + 1, length(piece))"))
    joined = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "gap", "own"))).alias("p"), F.first("content").alias("content"), F.max("end").alias("last"))
    body = F.array_join(F.transform("p", lambda x: F.concat(x["gap"], x["own"])), "")
    return joined.select("path", F.concat(body, F.expr("substring(content, last + 1)")).alias("text"))


def relative_path(path: str, root: str) -> str:
    """The path from the root on, with ``..`` where it lies outside."""
    import posixpath

    return posixpath.relpath(str(PurePosixPath(path)), str(PurePosixPath(root)))
