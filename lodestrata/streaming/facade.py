"""Structured Streaming over the same tables: plain Spark features beside the batch operators.

The pure transforms (type, key and path normal forms, log line parsing of single lines, filters) apply to streams as they
are. What keeps state is here: windowed counts with a watermark, removal of repeats, repeated calls per key.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import checkpoint_folder, ship, table


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files of a table, a file or a folder, with the schema of the batch table."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = f"{sf_dir}/{name}.parquet"
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if os.path.isfile(path) else reader.parquet(path)


def windowed_counts(stream: DataFrame, at: str, width: str, keys: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, keys, n): events per window; events later than ``late`` behind the newest are dropped."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return s.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n")


def distinct_events(stream: DataFrame, keys: list[str], at: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once; with a time column repeats are remembered as long as events may come late."""
    if at is None:
        return stream.dropDuplicates(keys)
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def repeated_calls(stream: DataFrame, key: str, call: str, k: int) -> DataFrame:
    """(key, call, n): a row whenever the last k events of a key are the same call; the state is one call and a count per key."""

    def fold(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        out = []
        for b in batches:
            for c in b[call]:
                last, n = (last, n + 1) if c == last else (c, 1)
                if n >= k:
                    out.append((group[0], c, n))
        state.update((last, n))
        yield pd.DataFrame(out, columns=[key, call, "n"])

    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {call} string, n int", "last string, n int", "append", GroupStateTimeout.NoTimeout)


def run_to_table(spark: SparkSession, sf_dir: str, name: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Drive a stream over all that is there now into a parquet table in the shared folder, and read it.

    ``append_last`` is for windowed aggregates: what the watermark has not closed when the input ends is written, too,
    by an update sink of which the last version of each row counts.
    """
    where = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = transform(read_stream(spark, sf_dir, name))
    if mode == "append_last":
        def save(df: DataFrame, batch: int) -> None:
            df.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(f"{where}/rows")

        q = out.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(f"{where}/rows")
        keys = [c for c in out.columns if c != "n"]
        return rows.groupBy(*keys).agg(F.max_by("n", "_batch").alias("n"))
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/rows")
