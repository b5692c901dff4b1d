"""Keys that hold so many rows that one task should not take them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES, LEAST_ROWS = 512, 50_000
_TRACKED = 16_384


def heavy_keys(df: DataFrame, key: str, least_rows: int = LEAST_ROWS) -> dict[str, int]:
    """Keys with more than 1/512 of all rows (and more than ``least_rows``), with about how many each has.

    One pass with a frequent-items sketch of bounded size: a key's count is off by at most 1/12,288 of all rows, so no
    such key is missed, and no more than some 600 keys come to the driver at any size. Null keys aren't counted.
    """
    row = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {2 * SHARES}, {_TRACKED})").alias("top"), F.count("*").alias("n")).first()
    least = max(row["n"] / SHARES, least_rows)
    return {x[0]: x[1] for x in row["top"] or [] if x[1] > least}
