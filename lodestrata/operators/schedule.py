"""Scheduling: batches and chunks under a budget of characters, kept whole per cycle group, and parallel levels.

Greedy folds depend on the order of a group. They are run as a stream: rows are parted by group and sorted within the
partition, and the fold carries a running total from batch to batch, so no group is held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import ship

CHUNK_CHARS, BATCH_CHARS = 3000, 8000


def _folded(df: DataFrame, group: str, order: list[str], cost: str, number: str, step) -> DataFrame:
    """df with ``number``: the state of ``step(total, count, cost) -> (opens, total)`` counted per group."""
    schema = df.schema
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total, k, first = object(), 0, 0, True
        for b in batches:
            out = []
            for g, c in zip(b[group], b[cost]):
                if first or g != current:
                    current, total, k, first = g, 0, 0, False
                    opens, total = False, step(None, int(c))[1]
                else:
                    opens, total = step(total, int(c))
                k += bool(opens)
                out.append(k)
            yield b.assign(**{number: pd.Series(out, dtype="int32", index=b.index)})[[*names, number]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{number}` int"
    sorted_ = df.where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, *order)
    ship(sorted_.sparkSession)
    return sorted_.mapInPandas(run, ddl)


def chunk_by_chars(df: DataFrame, group: str, order: list[str], cost: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """df with ``chunk`` (from 0): items in order until the next would exceed the limit; an item over the limit closes its chunk alone [B7]."""

    def step(total: int | None, c: int) -> tuple[bool, int]:
        if total is None:
            return False, c
        return (True, c) if total + c > limit or total >= limit else (False, total + c)

    return _folded(df, group, order, cost, "chunk", step)


def batch_by_chars(df: DataFrame, group: str, order: list[str], cost: str, limit: int = BATCH_CHARS) -> DataFrame:
    """df with ``batch`` (from 0): a new batch opens if the current one holds something and would exceed the limit [B2]."""

    def step(total: int | None, c: int) -> tuple[bool, int]:
        return (False, c) if total is None else (True, c) if total + c > limit else (False, total + c)

    return _folded(df, group, order, cost, "batch", step)


def batch_with_cycles(df: DataFrame, group: str, order: list[str], cost: str, cycle: str, limit: int = BATCH_CHARS) -> DataFrame:
    """df with ``batch``: as ``batch_by_chars``, but the members of a cycle group are placed as one item, at the place of the first [B3].

    Members need not be neighbours; none is placed twice. A null cycle is no group.
    """
    unit = F.coalesce(F.concat(F.lit("c"), F.col(cycle).cast("string")), F.concat_ws("/", F.lit("s"), *[F.col(c).cast("string") for c in order]))
    rows = df.withColumn("_unit", unit)
    units = rows.groupBy(group, "_unit").agg(F.sum(cost).alias("_cost"), F.min(F.struct(*order)).alias("_first"))
    placed = batch_by_chars(units, group, ["_first"], "_cost", limit).select(F.col(group), "_unit", "batch")
    return rows.join(placed, [group, "_unit"]).drop("_unit")


def cost_of(definition: Column, declaration: Column, name: Column) -> Column:
    """Characters of an item [B10]."""
    from lodestrata.functions.text import char_cost

    return char_cost(definition, declaration, name)


def file_batches(order: DataFrame, members: DataFrame) -> DataFrame:
    """(batch, file, cycle): one batch per file in rank order; a cycle group is one contiguous block, at the rank of its first member [B1].

    order: (file, rank), members: (file, scc) of files in groups of more than one. Files without rank are skipped.
    """
    f = order.join(members.select("file", F.col("scc").alias("cycle")), "file", "left")
    lead = F.when(F.col("cycle").isNotNull(), F.min("rank").over(Window.partitionBy("cycle"))).otherwise(F.col("rank"))
    f = f.withColumn("_lead", lead)
    # Ranks are dense, so blocks of them have a known size and the numbering needs no single task.
    width = 10_000
    f = f.withColumn("_block", F.floor(F.col("_lead") / width))
    sizes = f.groupBy("_block").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    k = F.row_number().over(Window.partitionBy("_block").orderBy("_lead", "rank"))
    return f.withColumn("_k", k).join(base, "_block").select((F.col("_base") + F.col("_k")).alias("batch"), "file", "cycle")


def by_file(df: DataFrame, path: str) -> DataFrame:
    """(file, n): rows per file, those without one under ``<unknown>`` [B4]."""
    return df.groupBy(F.coalesce(F.nullif(F.col(path), F.lit("")), F.lit("<unknown>")).alias("file")).agg(F.count("*").alias("n"))


def group_members(groups: DataFrame, members: str) -> DataFrame:
    """(node, group): the group of each member of arrays; of several groups the later one [B8, B9]."""
    return groups.select("group", F.explode(members).alias("node")).groupBy("node").agg(F.max("group").alias("group"))


def in_file_order(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, key, pos, place): symbols of each file with dependencies first, the original position as priority [T3, T4].

    Files with an anonymous symbol, a repeated key or a cycle keep their order. symbols: (path, key, name, pos), edges: (src, dst).
    A file is one call; it is as large as one file.
    """
    import heapq

    own = edges.select("src", "dst").distinct().join(symbols.select(F.col("key").alias("src"), F.col("path").alias("epath")).distinct(), "src")
    inner = own.join(symbols.select(F.col("key").alias("dst"), F.col("path").alias("p2")).distinct(), "dst").where("epath = p2 and src <> dst").select("epath", "src", "dst")

    def order(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos", kind="stable").reset_index(drop=True)
        keys = left["key"].tolist()
        place = list(range(len(keys)))
        at = {k: i for i, k in enumerate(keys)}
        if len(at) == len(keys) and not left["name"].fillna("").eq("").any():
            waits, users = [0] * len(keys), [[] for _ in keys]
            for s, d in zip(right["src"], right["dst"]):
                waits[at[s]] += 1
                users[at[d]].append(at[s])
            ready, out = [i for i, w in enumerate(waits) if not w], []
            heapq.heapify(ready)
            while ready:
                i = heapq.heappop(ready)
                out.append(i)
                for u in users[i]:
                    waits[u] -= 1
                    if not waits[u]:
                        heapq.heappush(ready, u)
            if len(out) == len(keys):
                for rank, i in enumerate(out):
                    place[i] = rank
        return pd.DataFrame({"path": left["path"], "key": keys, "pos": left["pos"], "place": pd.Series(place, dtype="int32")})

    ship(symbols.sparkSession)
    kind = symbols.schema["pos"].dataType.simpleString()
    return symbols.select("path", "key", "name", "pos").groupBy("path").cogroup(inner.groupBy("epath")).applyInPandas(order, f"path string, key string, pos {kind}, place int")
