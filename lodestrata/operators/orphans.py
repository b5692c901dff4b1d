"""References to records that do not exist.

Every key carries two signed counts that follow from change deltas: *existence* (+1 when a row of the
key is extracted, -1 when it is deleted) and *references* (+1 per edge end). A reference is an orphan
if the existence count of its key is zero at the time it was recorded.

Scale: references and deltas are shuffled once by key and swept as one sorted stream of narrow rows. A key that holds
more than 1/512 of all rows is found by a sketch of bounded size; its time is cut at its own quantiles, so that each
(key, slot) holds about that share, and what the slots before add up to opens a slot: a table of one row per slot.
The orphans alone are shuffled again, to drop repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.model import is_blank, key_of, normal_key
from lodestrata.operators.skew import LEAST_ROWS, SHARES, heavy_keys


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


SIDES = ("source", "target")


def reference_deltas(edges: DataFrame) -> DataFrame:
    """(key, at, edge_id, side): one row per end of an edge that is neither null nor blank; side is a place in SIDES.

    Edges without recorded_at have no place in time and are left out.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("side"), F.col(s).alias("raw")) for i, s in enumerate(SIDES)]))
    e = edges.where("recorded_at is not null").select("edge_id", _micros(F.col("recorded_at")).alias("at"), ends.alias("end")).where(~is_blank(F.col("end.raw")))
    return e.select(normal_key(F.col("end.raw")).alias("key"), "at", "edge_id", F.col("end.side").alias("side"))


def existence_spans(symbols: DataFrame) -> DataFrame:
    """(key, born, dies): the time in which a row lives, in microseconds; ``dies`` is null while it does.

    The key is taken from symbol_key or, where that is null or blank, from name, type and file_path.
    Rows without key or extracted_at never live, nor do rows deleted at or before their extraction.
    """
    key = F.coalesce(normal_key(F.col("symbol_key")), key_of(F.col("name"), F.col("type"), F.col("file_path")))
    s = symbols.select(key.alias("key"), _micros(F.col("extracted_at")).alias("born"), _micros(F.col("deleted_at")).alias("dies"))
    return s.where("key is not null and born is not null and (dies is null or dies > born)")


def existence_deltas(symbols: DataFrame) -> DataFrame:
    """(key, at, delta): +1 when a row begins to live, -1 when it ends."""
    both = F.array(F.struct(F.col("born").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("dies").alias("at"), F.lit(-1).alias("delta")))
    return existence_spans(symbols).select("key", F.explode(both).alias("d")).select("key", "d.at", "d.delta").where("at is not null")


def _slotted(events: DataFrame, heavy: dict[str, int], total: int) -> DataFrame:
    """Events with a slot: 0 or, for the heavy keys, the number of the key's cuts at or before the event."""
    if not heavy:
        return events.withColumn("slot", F.lit(0))
    # Cuts at the quantiles of each heavy key, as many as it has shares: no more than some 1,000 values over all keys.
    steps = [x for k, n in heavy.items() for x in (F.lit(k), F.lit(max(SHARES // max(round(n * SHARES / total), 2), 1)))]
    found = events.where(F.col("key").isin(*heavy)).groupBy("key").agg(F.percentile_approx("at", [i / SHARES for i in range(1, SHARES)], 20 * SHARES).alias("all"))
    step = F.create_map(*steps)[F.col("key")]
    cuts = found.select("key", F.filter("all", lambda c, i: (i + 1) % step == 0).alias("cuts"))
    met = events.join(F.broadcast(cuts), "key", "left")
    return met.withColumn("slot", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("at"))))).drop("cuts")


def orphan_references(edges: DataFrame, symbols: DataFrame, heavy_rows: int = LEAST_ROWS) -> DataFrame:
    """(edge_id, side, key, recorded_at): each reference whose key has no living row when it is recorded.

    A row lives from extracted_at (inclusive) to deleted_at (exclusive). Keys are compared in normal form
    (``model.normal_key``); null and blank references are none. Repeated edges come out once per
    (edge_id, side), repeated symbol rows change nothing (both signs of a span repeat alike). An empty
    edges table gives no rows; with an empty symbols table every reference is an orphan. Further
    columns of either table are ignored, so clashing names do no harm.
    """
    events = reference_deltas(edges).unionByName(existence_deltas(symbols), allowMissingColumns=True)
    heavy = heavy_keys(events, "key", heavy_rows)
    slotted = _slotted(events, heavy, events.count() if heavy else 0)
    if heavy:
        sums = slotted.where(F.col("key").isin(*heavy)).groupBy("key", "slot").agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("delta"))
        before = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        opens = sums.select("key", "slot", F.sum("delta").over(before).cast("int").alias("delta")).where("delta <> 0")
        slotted = slotted.unionByName(opens.withColumn("at", F.lit(-(2**63)).cast("bigint")), allowMissingColumns=True)
    # Changes come before references of the same moment: a birth counts at once, and so does a death.
    sweep = Window.partitionBy("key", "slot").orderBy("at", F.col("side").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = slotted.withColumn("existing", F.coalesce(F.sum("delta").over(sweep), F.lit(0)))
    found = swept.where("side is not null and existing <= 0").dropDuplicates(["edge_id", "side"])
    named = F.when(F.col("side") == 0, SIDES[0]).otherwise(SIDES[1])
    return found.select("edge_id", named.alias("side"), "key", F.timestamp_micros("at").cast(edges.schema["recorded_at"].dataType).alias("recorded_at"))


def orphan_report(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(side, period, orphans, keys): orphan references per side and month of recorded_at."""
    o = orphan_references(edges, symbols)
    return (
        o.groupBy("side", F.date_format(F.col("recorded_at").cast("timestamp_ntz"), "yyyy-MM").alias("period"))
        .agg(F.count("*").alias("orphans"), F.countDistinct("key").alias("keys"))
    )


def current_orphans(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, reference_count): keys with a positive reference count and an existence count of zero after all changes.

    Both counts are summed map-side before the one shuffle on the key, so a hot key costs one row per task.
    Repeated edge rows count once per (edge_id, side).
    """
    refs = reference_deltas(edges).dropDuplicates(["edge_id", "side"]).select("key", F.lit(1).alias("refs"), F.lit(0).alias("alive"))
    rows = existence_spans(symbols).select("key", F.lit(0).alias("refs"), F.when(F.col("dies").isNull(), 1).otherwise(0).alias("alive"))
    both = refs.unionByName(rows).groupBy("key").agg(F.sum("refs").alias("reference_count"), F.sum("alive").alias("alive"))
    return both.where("reference_count > 0 and alive = 0").select("key", "reference_count")
