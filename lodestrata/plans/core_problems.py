"""Queries of the general problems: orphan references and log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import loglines, orphans
from lodestrata.plans.sqltext import key_sql
from lodestrata.session import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_references(table(spark, sf, "edges"), table(spark, sf, "symbols")).select("edge_id", "side")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(table(spark, sf, "edges"), table(spark, sf, "symbols"))


def p3_current(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.current_orphans(table(spark, sf, "edges"), table(spark, sf, "symbols"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return loglines.log_entries(table(spark, sf, "run_logs"), with_message=False)


def p4_entries(spark: SparkSession, sf: str) -> DataFrame:
    return loglines.log_entries(table(spark, sf, "run_logs"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_current": p3_current, "p4_found": p4_found, "p4_entries": p4_entries}

_REFS = f"""
refs AS (
  SELECT DISTINCT edge_id, 'source' AS side, {key_sql("source")} AS k, recorded_at FROM edges
  UNION SELECT DISTINCT edge_id, 'target', {key_sql("target")}, recorded_at FROM edges
),
lives AS (SELECT DISTINCT {key_sql("symbol_key")} AS k, extracted_at, deleted_at FROM symbols),
orphans AS (
  SELECT * FROM refs r WHERE k IS NOT NULL AND recorded_at IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.k = r.k AND l.extracted_at <= r.recorded_at AND (l.deleted_at IS NULL OR r.recorded_at < l.deleted_at))
)"""

ORACLE_SQL = {
    "p3_found": f"WITH {_REFS} SELECT edge_id, side FROM orphans",
    "p3_report": f"""WITH {_REFS} SELECT side, strftime(recorded_at, '%Y-%m') AS period, count(*) AS orphans, count(DISTINCT k) AS keys
        FROM orphans GROUP BY ALL""",
    "p3_current": f"""WITH {_REFS}
        SELECT k AS key, count(*) AS reference_count FROM refs r
        WHERE k IS NOT NULL AND recorded_at IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM lives l WHERE l.k = r.k AND l.extracted_at IS NOT NULL AND l.deleted_at IS NULL)
        GROUP BY k""",
}
