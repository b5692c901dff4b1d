"""Named queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import encoding, funcdocs, leakage, packing, splitting, truncation
from lodestrata.session import table

def p1_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_batches(table(spark, sf, "symbol_batches"), table(spark, sf, "symbols"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.container_report(p1_containers(spark, sf), "run_id")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "symbols"), "symbol_id", "full_declaration")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_pieces(spark, sf).where("piece_no = 2").select("symbol_id")


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return funcdocs.function_pairs(table(spark, sf, "symbols"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pairs(spark, sf).select("symbol_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf, "documents"))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leak_report(p7_leaks(spark, sf))


def p8_cut(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated_documents(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_cut(spark, sf).select("doc_id")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf, "documents"), p8_cut(spark, sf))


QUERIES = {"p1_containers": p1_containers, "p1_report": p1_report, "p2_found": p2_found, "p2_pieces": p2_pieces, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_report": p7_report, "p8_found": p8_found, "p8_cut": p8_cut, "p8_report": p8_report}

ORACLE_SQL = {
    "p2_found": "SELECT DISTINCT symbol_id FROM symbols WHERE length(full_declaration) > 2000",
}
