"""Filling fixed-capacity containers with items of varying length.

Method: harmonic packing. Items are parted into reciprocal-capacity classes: an item of class k is longer than
capacity/(k+1) and not longer than capacity/k, so k of them always fit, and each class fills its containers with a
fixed count, independently across workers. There is a class for every k that the items meet. The bare method leaves each class
a remainder of less than k items, and up to 1/(k+1) of space in the others. So a class closes only containers that its count fills to 97 %; the
remainders of all classes follow within a worker, largest first, where they leave the least space (best fit).

How much the classes place depends on the size of the groups: runs of some seventy items have next to no k items of a class k beyond
the first few, so nearly all of their items are remainders; of a group of 50,000 items four fifths are placed by class. ``step`` tells which it was.

Scale: a worker's group is a slice of a run with a bounded number of items; runs within the bound are one slice. The few least filled
containers of each slice of a larger run are taken apart once more and packed together, so slices leave no part-filled containers of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import checkpointed, ship

CAPACITY = 8000
SLICE_ITEMS = 50_000
REOPENED = 4
#: The share of the capacity that a class's fixed count must fill; looser counts would leave space that no item is left to fill.
TIGHT = 0.97


def pack_by_class(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[bool]]:
    """(the container number of each length, whether its class placed it); no length may exceed the capacity. Zero and negative lengths take no space."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    by_class: dict[int, list[int]] = {}
    pool: list[int] = []
    for i in order:
        by_class.setdefault(capacity // lengths[i], []).append(i) if lengths[i] > 0 else pool.append(i)
    at, placed, left = [-1] * len(lengths), [False] * len(lengths), []
    for k, members in sorted(by_class.items()):
        for a in range(0, len(members), k):
            own = members[a : a + k]
            used = sum(lengths[i] for i in own)
            if len(own) < k or used < TIGHT * capacity:
                pool += own
                continue
            for i in own:
                at[i], placed[i] = len(left), True
            left.append(capacity - used)
    # Best fit, largest first, over the spaces that are left: (space, container) in order.
    spaces = sorted((s, c) for c, s in enumerate(left))
    for i in sorted(pool, key=lambda i: (-lengths[i], i)):
        size = max(lengths[i], 0)
        j = bisect_left(spaces, (size, -1))
        if j < len(spaces):
            space, c = spaces.pop(j)
        else:
            space, c = capacity, len(left)
            left.append(capacity)
        at[i] = c
        insort(spaces, (space - size, c))
    return at, placed


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container number of each length."""
    return pack_by_class(lengths, capacity)[0]


def pack_items(items: DataFrame, group_col: str, key_cols: list[str], length_col: str, capacity: int = CAPACITY, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """(group, container_id, *keys, piece_no, piece_chars, step): each item of each group in a container of ``capacity``.

    Items longer than the capacity are cut: all pieces but the last fill a container of their own, the last one is packed
    like an item; nothing else is split. Null and negative lengths count as 0 and take no space. Items repeat if their
    keys do; repeated keys come out once. Null groups are a group. An empty table gives no rows, other columns are ignored.
    ``step`` is 'cut' for full pieces of oversized items, 'class' or 'fit'.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ship(items.sparkSession)
    items = items.select(F.col(group_col).alias("grp"), *key_cols, F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("chars"))
    large = checkpointed(items.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > slice_items).select(F.col("grp").alias("g"), F.ceil(F.col("n") / slice_items).alias("slices")))
    sliced_runs = not large.isEmpty()
    if sliced_runs:
        cut = F.pmod(F.xxhash64(*key_cols), F.coalesce(F.col("slices"), F.lit(1))).cast("int")
        items = items.join(large, F.col("grp").eqNullSafe(F.col("g")), "left").select("grp", *key_cols, "chars", cut.alias("slice"), F.col("slices").isNotNull().alias("again"))
    else:
        items = items.select("grp", *key_cols, "chars", F.lit(0).alias("slice"), F.lit(False).alias("again"))
    columns = [*key_cols, "piece_no", "piece_chars", "step", "reopened", "container"]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(key_cols)
        again = bool(pdf["again"].iloc[0])
        rows, lengths, done, full = [], [], [], 0
        for r in pdf[[*key_cols, "chars"]].sort_values(key_cols, kind="stable").itertuples(index=False):
            *key, chars = r
            whole = (int(chars) - 1) // capacity if chars > capacity else 0
            for p in range(whole):
                done.append((*key, p + 1, capacity, "cut", False, f"w{full}"))
                full += 1
            rows.append((*key, whole + 1))
            lengths.append(int(chars) - whole * capacity)
        at, placed = pack_by_class(lengths, capacity)
        used = [0] * (max(at, default=-1) + 1)
        for n, c in zip(lengths, at):
            used[c] += n
        reopened = set(sorted(range(len(used)), key=lambda c: (used[c], c))[:REOPENED]) if again else set()
        done += [(*r, n, "class" if by else "fit", c in reopened, f"c{c}") for r, n, c, by in zip(rows, lengths, at, placed)]
        return labelled(pdf, done, str(pdf["slice"].iloc[0]))

    def refill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key_cols, "piece_no"], kind="stable")
        at, placed = pack_by_class(pdf["piece_chars"].tolist(), capacity)
        keys = pdf[[*key_cols, "piece_no", "piece_chars"]].itertuples(index=False)
        return labelled(pdf, [(*r, "class" if by else "fit", False, f"c{c}") for r, c, by in zip(keys, at, placed)], "again")

    def labelled(pdf: pd.DataFrame, rows: list[tuple], part: str) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        out.insert(0, "grp", [pdf["grp"].iloc[0] if len(pdf) else None] * len(out))
        out["container_id"] = f"{part}/" + out["container"]
        return out.drop(columns="container")

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = f"grp {kinds['grp']}, " + ", ".join(f"{c} {kinds[c]}" for c in key_cols) + ", piece_no int, piece_chars int, step string, reopened boolean, container_id string"
    packed = items.groupBy("grp", "slice").applyInPandas(fill, schema)
    if sliced_runs:
        packed = checkpointed(packed)
        packed = packed.where("not reopened").unionByName(packed.where("reopened").groupBy("grp").applyInPandas(refill, schema))
    return packed.select(F.col("grp").alias(group_col), "container_id", *key_cols, "piece_no", "piece_chars", "step")


def batch_items(batches: DataFrame, symbols: DataFrame) -> DataFrame:
    """(run_id, batch_id, item_no, symbol_id, chars): the items listed in ``symbols`` of each batch.

    A null inner count is filled from the symbol itself (the length of full_definition or, without one, of
    full_declaration), never from the batch total, which may be stale.
    """
    listed = batches.select("run_id", "batch_id", F.posexplode("symbols").alias("pos", "s"))
    items = listed.select("run_id", "batch_id", (F.col("pos") + 1).alias("item_no"), F.col("s.symbol_id").alias("symbol_id"), F.col("s.char_count").alias("chars"))
    known, open_ = items.where("chars is not null"), items.where("chars is null")
    text = F.when(F.length("full_definition") > 0, F.length("full_definition")).otherwise(F.length("full_declaration"))
    sizes = symbols.select("symbol_id", text.alias("size")).join(open_.select("symbol_id").distinct(), "symbol_id", "left_semi").groupBy("symbol_id").agg(F.max("size").alias("size"))
    filled = open_.join(sizes, "symbol_id", "left").select("run_id", "batch_id", "item_no", "symbol_id", F.coalesce(F.col("size"), F.lit(0)).alias("chars"))
    return known.unionByName(filled)


def pack_batches(batches: DataFrame, symbols: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The items of each planning run in containers of ``capacity`` characters."""
    return pack_items(batch_items(batches, symbols), "run_id", ["batch_id", "item_no", "symbol_id"], "chars", capacity)


def container_report(packed: DataFrame, group_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(group, containers, used_chars, unused_chars, least_containers, by_class, by_fit): what the containers of each group hold, and how many items either step placed."""
    steps = [F.count(F.when(F.col("step") == s, 1)).alias(f"by_{s}") for s in ("class", "fit")]
    g = packed.groupBy(group_col, "container_id").agg(F.sum("piece_chars").alias("used"), *steps)
    g = g.groupBy(group_col).agg(F.count("*").alias("containers"), F.sum("used").alias("used_chars"), F.sum("by_class").alias("by_class"), F.sum("by_fit").alias("by_fit"))
    return g.select(
        group_col, "containers", "used_chars", (F.col("containers") * capacity - F.col("used_chars")).alias("unused_chars"),
        F.greatest(F.ceil(F.col("used_chars") / capacity), F.lit(1)).alias("least_containers"), "by_class", "by_fit",
    )
