"""Sources: analysis, edge and order documents in JSON, CSV tables as key/value documents, mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import pair_decode
from lodestrata.model import normal_key

_SYMBOL = "struct<name:string,type:string,start_line:int,end_line:int,start_byte:int,end_byte:int,full_declaration:string,full_definition:string,comment:string,text:string,symbol:string>"
_KINDS = ("functions", "structs", "typedefs", "macros", "variables", "enums")
ANALYSIS_SCHEMA = "map<string,struct<file_path:string,parse_success:boolean,error:string,includes:array<" + _SYMBOL + ">," + ",".join(f"{k}:array<{_SYMBOL}>" for k in _KINDS) + ",total_nodes:int,file_size:int>>"
EDGE_SCHEMA = "edge_id bigint, source struct<name:string,type:string,file:string>, target struct<name:string,type:string,file:string>, dependency_type string, occurrence struct<start_line:int,end_line:int>"


def read_analysis_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, parse_success, error, total_nodes, file_size, symbols...): one row per file of analysis documents."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", ANALYSIS_SCHEMA).alias("doc"))
    return doc.select(F.explode("doc").alias("path", "a")).select("path", "a.*")


def analysis_symbols(files: DataFrame) -> DataFrame:
    """(path, type, name, start_line, ..., comment): the symbols of files that were parsed; names may come as ``text`` or ``symbol``, nulls become defaults."""
    def typed(kind: str) -> Column:
        own = F.coalesce(F.col(kind), F.array().cast(f"array<{_SYMBOL}>"))
        return F.transform(own, lambda s: s.withField("type", F.coalesce(s["type"], F.lit(kind))))

    lists = F.flatten(F.array(*map(typed, _KINDS)))
    s = files.where("parse_success").select("path", F.explode(lists).alias("s"))
    ints = [F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in ("start_line", "end_line", "start_byte", "end_byte")]
    texts = [F.coalesce(F.col(f"s.{c}"), F.lit("")).alias(c) for c in ("full_declaration", "full_definition", "comment")]
    return s.select("path", "s.type", F.coalesce("s.name", "s.symbol", "s.text", F.lit("")).alias("name"), *ints, *texts)


def read_edge_json(lines: DataFrame) -> DataFrame:
    """(edge_id, src, dst, dep_type, start_line, end_line) of JSON rows in ``value``; rows that are broken or lack one of the six parts of the ends or the type are skipped."""
    e = lines.select(F.from_json("value", EDGE_SCHEMA).alias("e")).select("e.*")
    parts = [F.col(f"{end}.{p}") for end in ("source", "target") for p in ("name", "type", "file")]
    whole = F.lit(True)
    for p in [*parts, F.col("dependency_type")]:
        whole = whole & (F.coalesce(p, F.lit("")) != "")
    return e.where(whole).select(
        "edge_id", normal_key(F.concat_ws(":", *parts[:3])).alias("src"), normal_key(F.concat_ws(":", *parts[3:])).alias("dst"), F.col("dependency_type").alias("dep_type"),
        "occurrence.start_line", "occurrence.end_line",
    )


def read_edges_file(spark: SparkSession, path: str) -> DataFrame:
    """The edges of dependency documents: the array ``dependencies`` of each file."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.dependencies"), "array<string>")).alias("value"))
    return read_edge_json(doc)


def read_order_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, rank): the stored order; ``ordered_depth`` stands in for missing ``ordered_names``; a missing file gives no rows."""
    schema = "name string, rank int"
    try:
        text = spark.read.text(path, wholetext=True)
        text.schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    names = F.from_json(F.get_json_object("value", "$.ordered_names"), "array<string>")
    depth = F.from_json(F.get_json_object("value", "$.ordered_depth"), "array<array<string>>")
    ranked = text.select(F.posexplode(F.coalesce(names, F.transform(depth, lambda x: x[0]))).alias("rank", "name"))
    return ranked.select("name", "rank")


def key_value_docs(df: DataFrame, key_fields: list[str], value_fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """(*keep, key, value): maps of trimmed fields; rows with an empty key field are dropped, empty values left out."""

    def field(c: str) -> Column:
        return F.trim(F.col(c).cast("string"))

    whole = F.lit(True)
    for k in key_fields:
        whole = whole & (F.coalesce(field(k), F.lit("")) != "")

    def as_map(cols: list[str]) -> Column:
        full = F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*map(field, cols)))
        return F.map_filter(full, lambda _, v: F.coalesce(v, F.lit("")) != "")

    return df.where(whole).select(*(keep or []), as_map(key_fields).alias("key"), as_map(value_fields).alias("value"))


def read_key_value_csv(spark: SparkSession, path: str, key_fields: list[str]) -> DataFrame:
    """A CSV table with doubled quotes as key/value documents."""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return key_value_docs(df, key_fields, [c for c in df.columns if c not in key_fields])


def read_mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """(c_name, c_path, rust_name, rust_path): mappings ``name|path`` to ``name|path``; null targets are skipped."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v")).where("v is not null")
    c, r = pair_decode(F.col("k")), pair_decode(F.col("v"))
    return pairs.select(c["name"].alias("c_name"), c["path"].alias("c_path"), r["name"].alias("rust_name"), r["path"].alias("rust_path"))


def dependency_document(symbols: DataFrame, edges: DataFrame, files: int | None = None) -> DataFrame:
    """(value): dependency rows as JSON lines for a partitioned sink, one object per edge; totals belong to ``document_totals``."""
    def end(c: str) -> Column:
        p = F.split(c, ":", 3)
        return F.struct(p[0].alias("name"), p[1].alias("type"), p[2].alias("file"))

    return edges.select(
        F.to_json(F.struct("edge_id", end("src").alias("source"), end("dst").alias("target"), F.col("dep_type").alias("dependency_type"), F.struct("start_line", "end_line").alias("occurrence"))).alias("value")
    )


def document_totals(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(total_symbols, total_dependencies, total_files): the true file count."""
    both = symbols.select("key", "path").withColumn("dep", F.lit(0)).unionByName(edges.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("path"), F.lit(1).alias("dep")))
    return both.agg(F.countDistinct("key").alias("total_symbols"), F.sum("dep").alias("total_dependencies"), F.countDistinct("path").alias("total_files"))


SYMBOL_STRUCT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("name", "type")]
    + [T.StructField(c, T.IntegerType()) for c in ("start_line", "end_line", "start_byte", "end_byte")]
    + [T.StructField(c, T.StringType()) for c in ("full_declaration", "full_definition", "comment")]
)


def read_symbol_rows(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, file): symbols from a JSON document whose root is a list of them or a map to them [S9]."""
    row = "struct<name:string,type:string,file:string,file_path:string,source_path:string,path:string,symbol:string,id:string>"
    text = spark.read.text(path, wholetext=True)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{row}>")).otherwise(F.map_values(F.from_json("value", f"map<string,{row}>")))
    s = text.select(F.explode(rows).alias("s"))
    return s.select(F.coalesce("s.name", "s.symbol", "s.id").alias("name"), "s.type", F.coalesce("s.file_path", "s.file", "s.source_path", "s.path").alias("file")).where("name is not null")


def mapping_document(mapping: DataFrame) -> DataFrame:
    """(key, value): mappings (c_name, c_path, rust_name, rust_path) as ``name|path`` texts, the form ``read_mapping_json`` reads [S18]."""
    from lodestrata.functions.text import pair_encode

    return mapping.select(pair_encode(F.col("c_name"), F.col("c_path")).alias("key"), pair_encode(F.col("rust_name"), F.col("rust_path")).alias("value"))
