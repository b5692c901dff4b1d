import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph as G

FIXED = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "e"), ("f", "e"), ("g", "f"), ("b", "d")]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {n: set() for n in nodes}
    for n in nodes:
        todo = [d for s, d in edges if s == n]
        while todo:
            x = todo.pop()
            if x not in out[n]:
                out[n].add(x)
                todo += [d for s, d in edges if s == x]
    return out


def brute_scc(edges):
    r = reach(edges)
    return {n: min([n] + [m for m in r[n] if n in r[m]]) for n in r}


def random_graph(seed, n=25, m=45):
    r = random.Random(seed)
    return sorted({(f"n{r.randint(0, n):02d}", f"n{r.randint(0, n):02d}") for _ in range(m)})


@pytest.mark.parametrize("edges", [FIXED, random_graph(1), random_graph(2, 40, 50)])
def test_components(spark, edges):
    want = brute_scc(edges)
    got = {x.node: x.scc for x in G.strong_components(frame(spark, edges)).collect()}
    assert got == want
    layers = {x.node: x for x in G.layers(frame(spark, edges)).collect()}
    # Exact longest path over the condensation.
    dag = {(want[s], want[d]) for s, d in edges if want[s] != want[d]}
    depth = {c: 0 for c in want.values()}
    for _ in range(len(depth)):
        for u, v in dag:
            depth[v] = max(depth[v], depth[u] + 1)
    assert {n: x.depth for n, x in layers.items()} == {n: depth[c] for n, c in want.items()}
    weak = {x.node: x.component for x in G.components(frame(spark, edges)).collect()}
    both = reach(edges + [(d, s) for s, d in edges])
    assert weak == {n: min(both[n] | {n}) for n in both}


def test_order_is_valid(spark):
    edges = random_graph(5)
    order = G.topological_order(frame(spark, edges), spark.createDataFrame([("lone",)], "node string")).collect()
    rank = {x.node: x["rank"] for x in order}
    assert sorted(rank.values()) == list(range(len(rank))) and "lone" in rank
    scc = brute_scc(edges)
    assert all(rank[d] < rank[s] for s, d in edges if scc[s] != scc[d])


def test_counter_example(spark):
    """B needs C, A needs B, Y needs A: the order must put C before B."""
    rank = {x.node: x["rank"] for x in G.topological_order(frame(spark, [("B", "C"), ("Y", "A"), ("A", "B")])).collect()}
    assert rank["C"] < rank["B"] < rank["A"] < rank["Y"]


@pytest.mark.parametrize("direction", ["out", "in", "both"])
@pytest.mark.parametrize("depth", [0, 2, 5, None])
def test_k_hop(spark, direction, depth):
    edges = random_graph(7)
    step = {"out": edges, "in": [(d, s) for s, d in edges], "both": edges + [(d, s) for s, d in edges]}[direction]
    starts = ["n01", "n02", "nowhere"]
    got = {(x.start, x.node): x.depth for x in G.k_hop(frame(spark, edges), spark.createDataFrame([(s,) for s in starts], "start string"), depth, direction).collect()}
    want = {}
    for s in starts:
        level, seen, d = {s}, {s: 0}, 0
        while level and (depth is None or d < depth):
            d += 1
            level = {y for x, y in step if x in level} - set(seen)
            seen |= {x: d for x in level}
        want |= {(s, n): k for n, k in seen.items()}
    assert got == want


def test_filter_hides_but_doesnt_stop(spark, rows):
    kinds = spark.createDataFrame([("d",)], "node string")
    got = G.k_hop(frame(spark, FIXED), spark.createDataFrame([("a",)], "start string"), 3, kinds=kinds)
    assert rows(got) == [("a", "d", 2)]


def test_groups_and_views(spark, rows):
    assert rows(G.cycle_groups(frame(spark, FIXED)), "scc", "size") == [("a", 3)]
    assert rows(G.bounded_view(frame(spark, FIXED), "a", 2, 2)) == [("in", "b", 2), ("in", "c", 1), ("out", "b", 1), ("out", "c", 2)]
    levels = dict(rows(G.parallel_levels(frame(spark, FIXED), spark.createDataFrame([("z",)], "node string"))))
    assert levels["z"] == 0 and levels["e"] == 0 and levels["d"] == 1 and levels["a"] == levels["b"] == levels["c"] == 2 and levels["g"] == 2
    assert dict(rows(G.parallel_levels(frame(spark, FIXED), spark.createDataFrame([], "node string"), False)))["g"] == 0


def test_empty(spark):
    none = frame(spark, [])
    for fn in (G.strong_components, G.layers, G.topological_order, G.components, G.cycle_groups):
        assert fn(none).collect() == []


def test_closure(spark, rows):
    edges = [("s", "f1"), ("s", "m1"), ("m1", "m2"), ("m2", "f2"), ("m2", "m3"), ("f1", "m9"), ("m3", "s")]
    kinds = spark.createDataFrame([(n, n.startswith("f")) for n in ("s", "f1", "f2", "m1", "m2", "m3", "m9")], "node string, is_function boolean")
    st = spark.createDataFrame([("s",)], "start string")
    assert rows(G.closure_with_limit(frame(spark, edges), st, kinds)) == [("s", "f1", 1), ("s", "m1", 1), ("s", "m2", 2), ("s", "m3", 3)]
    assert len(rows(G.closure_with_limit(frame(spark, edges), st, kinds, 2))) == 2


def test_closure_by_column_of_long_chains(spark, rows):
    """Repeated edges and a chain beyond any number of rounds: a start with enough nodes goes no further, one with few is followed to the end."""
    edges = [(f"m{i}", f"m{i + 1}") for i in range(260)] * 2 + [("s", x) for x in ("f0", "m0", "s", "m1")] + [("t", "m258"), ("m260", "t"), ("t", "f1")]
    st = spark.createDataFrame([("s",), ("t",), ("u",)], "start string")
    want = [("s", "f0", 1), ("s", "m0", 1), ("s", "m1", 1)] + [("s", f"m{i}", i) for i in range(2, 6)]
    few = [("t", "f1", 1), ("t", "m258", 1), ("t", "m259", 2), ("t", "m260", 3)]
    kinds = spark.createDataFrame([(n, n.startswith("f")) for n in {x for e in edges for x in e}], "node string, is_function boolean")
    for told in (lambda node: node.startswith("f"), kinds):
        assert rows(G.closure_with_limit(frame(spark, edges), st, told, 7)) == sorted(want + few)


def test_uses(spark, rows):
    s = spark.createDataFrame([("k", 10, "int a = FOO(b);\nFOO + bar_9")], "key string, start_line int, text string")
    n = spark.createDataFrame([("FOO",), ("bar_9",), ("zzz",)], "name string")
    assert rows(G.identifier_uses(s, n)) == [("k", "FOO", 10), ("k", "bar_9", 11)]
    d = spark.createDataFrame([("x", "(1)", "functions"), ("x", "->a", "variables"), ("x", "", "structs"), ("x", "(", "macros")], "n string, t string, k string")
    assert [r[0] for r in d.select(G.infer_dep_type(F.col("n"), F.col("t"), F.col("k"))).collect()] == ["function_call", "struct_member", "type_reference", "macro_use"]


def test_unsettled_components_raise(spark):
    cycle = [(f"n{i}", f"n{(i + k) % 9}") for i in range(9) for k in (1, 2)]
    with pytest.raises(RuntimeError):
        G.strong_components(frame(spark, cycle), 2, small=0)
    assert {x.scc for x in G.strong_components(frame(spark, cycle), small=0).collect()} == {"n0"}


def test_long_rings_and_chains(spark):
    """A ring of 500 with a chain of 300 that leads to it and a small cycle on the way."""
    ring = [(f"r{i:03d}", f"r{(i + 1) % 500:03d}") for i in range(500)]
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(300)] + [("c300", "r000"), ("c150", "x"), ("x", "c150")]
    got = {x.node: x.scc for x in G.strong_components(frame(spark, ring + chain)).collect()}
    want = {f"r{i:03d}": "r000" for i in range(500)} | {f"c{i:03d}": f"c{i:03d}" for i in range(301)} | {"x": "c150"}
    assert got == want
    assert max(x.depth for x in G.layers(frame(spark, chain)).collect()) == 301


@pytest.mark.parametrize("small", [0, 8])
def test_rounds_over_the_cluster(spark, small):
    """The same by rounds: rings and chains are contracted, the rest is coloured or left to one task when it is small."""
    edges = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "r3"), ("r5", "z"), ("y", "a"), ("c", "d"), ("d", "c")]
    assert {x.node: x.scc for x in G.strong_components(frame(spark, edges), small=small).collect()} == brute_scc(edges)


def test_layers_by_rounds(spark):
    assert {x.node: x.depth for x in G.layers(frame(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "b")]), small=0).collect()} == {"a": 0, "b": 1, "c": 1}
