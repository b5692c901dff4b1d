import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import packing as P

ITEM = "grp string, id int, chars int, slice string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_pack(lengths):
    at = P.pack(lengths, 100)
    used = {}
    for n, c in zip(lengths, at):
        used[c] = used.get(c, 0) + n
    assert len(at) == len(lengths) and all(v <= 100 for v in used.values())
    assert sorted(used) == list(range(len(used)))
    # No two containers could be one but for those that harmonic classes fill by count: best fit stays within 3/2 of the least.
    least = -(-sum(lengths) // 100)
    assert len(used) <= max(1, 1.7 * least + 2)


def test_quality():
    r = random.Random(3)
    lengths = [min(int(r.paretovariate(1.1) * 60), 8000) for _ in range(5000)]
    at = P.pack(lengths)
    assert max(at) + 1 <= 1.03 * sum(lengths) / 8000 + 1


def test_large_groups_are_placed_by_class():
    r = random.Random(3)
    lengths = [min(int(r.paretovariate(1.1) * 60), 8000) for _ in range(50_000)]
    at, placed = P.pack_by_class(lengths)
    assert sum(placed) > 0.5 * len(lengths) and max(at) + 1 <= 1.01 * sum(lengths) / 8000 + 1


def brute_check(items, out, capacity):
    want = {}
    for g, i, n, _ in items:
        want[g, i] = max(n or 0, 0)
    got, room = {}, {}
    for x in out:
        got.setdefault((x.grp, x.id), []).append((x.piece_no, x.piece_chars))
        room[x.grp, x.container_id] = room.get((x.grp, x.container_id), 0) + x.piece_chars
    assert set(got) == set(want) and all(v <= capacity for v in room.values())
    for k, pieces in got.items():
        pieces.sort()
        assert [p for p, _ in pieces] == list(range(1, len(pieces) + 1)) and sum(c for _, c in pieces) == want[k]
        if want[k] <= capacity:
            assert len(pieces) == 1
        else:
            assert len(pieces) == -(-want[k] // capacity) and all(c == capacity for _, c in pieces[:-1])
    return room


@pytest.mark.parametrize("bound", [7, 1000])
def test_items(spark, bound):
    r = random.Random(1)
    items = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, -5, 0, 1, 30, 51, 100, 101, 250, r.randint(1, 100)]), "clash") for i in range(120)]
    df = spark.createDataFrame([*items, *items[:30]], ITEM)
    out = P.pack_items(df, "grp", ["id"], "chars", 100, slice_items=bound).collect()
    brute_check(items, out, 100)


def test_slices_leave_no_part_filled_containers(spark):
    r = random.Random(2)
    items = [("a", i, r.randint(1, 40), "") for i in range(2000)]
    df = spark.createDataFrame(items, ITEM)
    room = brute_check(items, P.pack_items(df, "grp", ["id"], "chars", 100, slice_items=100).collect(), 100)
    assert len(room) <= 1.02 * sum(i[2] for i in items) / 100 + 1


def test_exact_fits_and_empty(spark):
    items = [("a", 1, 100, ""), ("a", 2, 100, ""), ("a", 3, 200, "")]
    room = brute_check(items, P.pack_items(spark.createDataFrame(items, ITEM), "grp", ["id"], "chars", 100).collect(), 100)
    assert len(room) == 4
    none = P.pack_items(spark.createDataFrame([], ITEM), "grp", ["id"], "chars", 100)
    assert none.collect() == []
    with pytest.raises(ValueError):
        P.pack_items(spark.createDataFrame([], ITEM), "grp", ["id"], "chars", 0)


def test_batches(spark):
    b = spark.createDataFrame(
        [("r", 1, [(1, 7900), (2, None), (3, None)]), ("r", 1, [(1, 7900), (2, None), (3, None)]), ("r", 2, []), ("q", 3, None), ("q", 4, [(9, 50)])],
        "run_id string, batch_id bigint, symbols array<struct<symbol_id:bigint,char_count:int>>",
    )
    s = spark.createDataFrame([(2, "abc", "x" * 150), (2, "abc", "x" * 150), (3, "abcd", "")], "symbol_id bigint, full_declaration string, full_definition string")
    out = P.pack_batches(b, s)
    got = {(x.batch_id, x.item_no): x.piece_chars for x in out.collect()}
    assert got == {(1, 1): 7900, (1, 2): 150, (1, 3): 4, (4, 1): 50}
    rep = {x.run_id: (x.containers, x.used_chars, x.unused_chars, x.least_containers) for x in P.container_report(out, "run_id").collect()}
    assert rep == {"r": (2, 8054, 7946, 2), "q": (1, 50, 7950, 1)}
