"""Graph operators: neighbours, bounded and unbounded traversal, components, cycles, layers, order.

Graphs are edge tables (src, dst). Loops run one join per round against the frontier and cut their lineage every round
through the shared checkpoint folder. Nothing is collected to the driver but a round's row count. Components and layers of graphs
that are small by count are worked out by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.model import DEP_TYPES
from lodestrata.session import checkpointed, ship

MOST_ROUNDS = 200
#: A graph of up to this many edges, which are counted, is solved by one task in linear time; larger ones are made smaller by rounds over the cluster first.
SMALL = 250_000
#: Nodes up to this number, which are counted, are sent to every task rather than moving all edges.
MOST_SENT = 250_000


def file_edges(edges: DataFrame) -> DataFrame:
    """(src_file, dst_file, n, calls, dep_types): distinct edges (src, dst, dep_type) between different files [A2].

    The types of a pair are gathered as bits, which a hash aggregate can hold; a type beyond the six known ones counts in n only.
    """
    f = edges.select("src", "dst", "dep_type").distinct().select(F.split("src", ":", 3)[2].alias("src_file"), F.split("dst", ":", 3)[2].alias("dst_file"), "dep_type").where("src_file <> dst_file")
    kinds = sorted(DEP_TYPES)
    bit = F.lit(0)
    for i, kind in enumerate(kinds):
        bit = F.when(F.col("dep_type") == kind, 1 << i).otherwise(bit)
    g = f.groupBy("src_file", "dst_file").agg(F.count("*").alias("n"), F.count(F.when(F.col("dep_type") == "function_call", 1)).alias("calls"), F.bit_or(bit).alias("bits"))
    listed = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.lit(kind)) for i, kind in enumerate(kinds)]))
    return g.select("src_file", "dst_file", "n", "calls", listed.alias("dep_types"))


def degree_top(edges: DataFrame, k: int) -> DataFrame:
    """(side, name, n): the k names with most edges out and in; ties by name [A3]."""

    def top(side: str, col: str) -> DataFrame:
        g = edges.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n"))
        return g.orderBy(F.desc("n"), "name").limit(k).select(F.lit(side).alias("side"), "name", "n")

    return top("out", "src_name").unionByName(top("in", "dst_name"))


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct (a, b): steps from a to b along edges, against them, or both ways."""
    out, back = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    steps = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    return steps.where("a is not null and b is not null").distinct()


def k_hop(edges: DataFrame, starts: DataFrame, depth: int | None = 1, direction: str = "out", kinds: DataFrame | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(start, node, depth): every node within ``depth`` steps of each start (column ``start``) and its least distance [G1, G3].

    Without a depth the walk goes on until nothing new is met. The filter ``kinds`` (column ``node``) applies to the result only: the
    walk passes through what it hides. Starts have depth 0; a start without edges is its own and only node.
    """
    first = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    seen = _few_hops(first, directed(edges, direction), depth) if depth is not None and depth <= LAZY_DEPTH else _all_hops(first, directed(edges, direction), depth, most_rounds)
    return seen if kinds is None else seen.join(kinds.select("node").distinct(), "node", "left_semi").select("start", "node", "depth")


LAZY_DEPTH = 3


def _few_hops(first: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """One plan of ``depth`` joins; a node that is met more than once keeps its least depth."""
    level, every = first, first
    for k in range(1, depth + 1):
        level = level.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct().withColumn("depth", F.lit(k))
        every = every.unionByName(level)
    return every.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def _all_hops(first: DataFrame, steps: DataFrame, depth: int | None, most_rounds: int) -> DataFrame:
    """A round per step against the nodes met last, with its lineage cut."""
    steps, seen = checkpointed(steps), checkpointed(first)
    frontier, level = seen, 0
    while level < (most_rounds if depth is None else depth):
        level += 1
        reached = frontier.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        frontier = checkpointed(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier)) if level % 4 == 0 else seen.unionByName(frontier)
    else:
        if depth is None:
            raise RuntimeError(f"the walk didn't end within {most_rounds} rounds")
    return seen


def _leaving(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The steps (src, dst) from the nodes. Up to MOST_SENT nodes, which are counted, go to the steps, which then aren't shuffled; more are joined."""
    wanted = nodes.select(F.col("node").alias("src")).distinct()
    return steps.join(F.broadcast(wanted) if wanted.limit(MOST_SENT + 1).count() <= MOST_SENT else wanted, "src", "left_semi")


def closure_with_limit(edges: DataFrame, starts: DataFrame, kinds: DataFrame | Callable[[Column], Column], most: int = 64) -> DataFrame:
    """(start, node, depth): functions one step away and everything that is no function at any distance, the first ``most`` by (depth, node) [G18].

    kinds: (node, is_function), or what tells of a node's column whether it is a function. The walk passes only through nodes that are no
    functions. It goes on, level by level, from starts with less than ``most`` nodes: what is deeper comes behind those of a start that has
    them. Each level brings such a start a node at least, so the walk ends. Edges may repeat; if kinds are told by the column, only those that
    leave a level are shuffled.
    """

    def told(df: DataFrame, node: str, function: bool) -> DataFrame:
        if callable(kinds):
            return df.where(kinds(F.col(node)) if function else ~kinds(F.col(node)))
        return df.join(kinds.where("is_function" if function else "not is_function").select(F.col("node").alias(node)), node, "left_semi")

    def stepped(nodes: DataFrame, steps: DataFrame) -> DataFrame:
        met = _leaving(steps.select("src", "dst"), nodes).join(nodes.select("start", F.col("node").alias("src")), "src")
        return met.select("start", F.col("dst").alias("node")).where("node <> start").distinct()

    first = checkpointed(stepped(starts.select("start", F.col("start").alias("node")).distinct(), edges))
    frontier = checkpointed(told(first, "node", False).withColumn("depth", F.lit(1)))
    seen = checkpointed(told(first, "node", True).withColumn("depth", F.lit(1)).unionByName(frontier))
    inner = None
    for level in range(2, most + 1):
        done = seen.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        active = checkpointed(frontier.join(done, "start", "left_anti"))
        if active.isEmpty():
            break
        inner = checkpointed(told(told(edges.select("src", "dst"), "src", False), "dst", False)) if inner is None else inner
        frontier = checkpointed(stepped(active, inner).join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        seen = checkpointed(seen.unionByName(frontier)) if level % 4 == 0 else seen.unionByName(frontier)
    w = Window.partitionBy("start").orderBy("depth", "node")
    return seen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn").select("start", "node", "depth")


def components(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, component): weakly connected components, named by their least node.

    Large-star and small-star rounds: each node's neighbourhood is joined to its least member; the number of rounds grows with
    the logarithm of the longest path, and a hub costs one row per neighbour.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    everyone = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    pairs, before = checkpointed(pairs), None
    for _ in range(most_rounds):
        both = pairs.select("u", "v").union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        pairs = checkpointed(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components didn't settle within {most_rounds} rounds")
    return everyone.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _component_names(src: list[int], dst: list[int], n: int) -> list[int]:
    """The number of each node's component: one depth-first walk that keeps its own stack (path-based, linear)."""
    out = [[] for _ in range(n)]
    for a, b in zip(src, dst):
        out[a].append(b)
    order, comp, path, open_, count, named = [-1] * n, [-1] * n, [], [], 0, 0
    for root in range(n):
        if order[root] >= 0:
            continue
        work = [(root, iter(out[root]))]
        order[root] = count
        count += 1
        path.append(root)
        open_.append(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if order[nxt] < 0:
                    order[nxt] = count
                    count += 1
                    path.append(nxt)
                    open_.append(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if comp[nxt] < 0:
                    while order[open_[-1]] > order[nxt]:
                        open_.pop()
            else:
                work.pop()
                if open_[-1] == node:
                    open_.pop()
                    while True:
                        last = path.pop()
                        comp[last] = named
                        if last == node:
                            break
                    named += 1
    return comp


def _edge_table(batches: Iterator[pd.DataFrame]) -> tuple[list[str], list[int], list[int]]:
    """The names of the nodes in order, and the edges as places in them."""
    parts = list(batches)
    e = pd.concat(parts) if parts else pd.DataFrame({"src": [], "dst": []})
    names = sorted(set(e["src"]) | set(e["dst"]))
    at = {x: i for i, x in enumerate(names)}
    return names, [at[x] for x in e["src"]], [at[x] for x in e["dst"]]


def _components_at_once(edges: DataFrame) -> DataFrame:
    """(node, scc) of a small graph, by one task."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, src, dst = _edge_table(batches)
        comp = _component_names(src, dst, len(names))
        least: dict[int, str] = {}
        for name, c in zip(names, comp):
            least.setdefault(c, name)
        yield pd.DataFrame({"node": names, "scc": [least[c] for c in comp]})

    ship(edges.sparkSession)
    return edges.select("src", "dst").coalesce(1).mapInPandas(solve, "node string, scc string")


def _depths_at_once(dag: DataFrame) -> DataFrame:
    """(node, depth) of a small graph without cycles: the length of the longest path to each node, by one task."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, src, dst = _edge_table(batches)
        out, waits, depth = [[] for _ in names], [0] * len(names), [0] * len(names)
        for a, b in zip(src, dst):
            out[a].append(b)
            waits[b] += 1
        ready = [i for i, w in enumerate(waits) if not w]
        while ready:
            a = ready.pop()
            for b in out[a]:
                depth[b] = max(depth[b], depth[a] + 1)
                waits[b] -= 1
                if not waits[b]:
                    ready.append(b)
        yield pd.DataFrame({"node": names, "depth": pd.Series(depth, dtype="int32")})

    ship(dag.sparkSession)
    return dag.select(F.col("u").alias("src"), F.col("v").alias("dst")).coalesce(1).mapInPandas(solve, "node string, depth int")


def _reduced(edges: DataFrame, links: list[DataFrame], most_rounds: int | None, small: int) -> DataFrame:
    """Edges on which cycles may lie, made short: sources and sinks are peeled off, and chains are contracted.

    A node v with one way in and one way out, u -> v -> w, is on a cycle exactly if u and w are in one component, and then in that one. So v
    gives way to an edge u -> w, and (v, u, w) is kept in ``links``. Of neighbouring ones that come first by a hash of the round give
    way, a good third, so a ring or chain of any length takes a number of rounds that grows with its logarithm. What is ``small`` is left as it is.
    """
    e = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    n, rounds = e.count(), 0
    while n > small:
        if rounds == most_rounds:
            raise RuntimeError(f"the graph wasn't reduced within {most_rounds} rounds")
        rounds += 1
        ins = e.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("i"), F.min("src").alias("u"))
        outs = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o"), F.min("dst").alias("w"))
        nodes = checkpointed(ins.join(outs, "v").select("v", "u", "w", (F.greatest("i", "o") == 1).alias("chain"), F.struct(F.xxhash64("v", F.lit(rounds)).alias("h"), F.col("v").alias("name")).alias("rank")))
        chain = nodes.where("chain")
        near = [chain.select(F.col("v").alias(c), F.col("rank").alias(f"rank_{c}")) for c in ("u", "w")]
        ahead = [F.col(f"rank_{c}").isNull() | (F.col("rank") > F.col(f"rank_{c}")) for c in ("u", "w")]
        picked = chain.join(near[0], "u", "left").join(near[1], "w", "left").where(ahead[0] & ahead[1]).select("v", "u", "w")
        within = nodes.join(picked, "v", "left_anti").select("v")
        kept = e.join(within.withColumnRenamed("v", "src"), "src", "left_semi").join(within.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
        e = checkpointed(kept.unionByName(picked.select(F.col("u").alias("src"), F.col("w").alias("dst"))).where("src <> dst").distinct())
        m = e.count()
        # As long as anything gives way or is peeled off, edges get fewer.
        if m == n:
            break
        links.append(picked)
        n = m
    return e


def _restored(found: DataFrame | None, links: list[DataFrame], nodes: DataFrame) -> DataFrame | None:
    """``found`` (node, scc) with the contracted nodes, last ones first: each belongs to the component of both its neighbours, if that is one."""
    for link in reversed(links):
        if found is None:
            found = nodes.select("node", F.col("node").alias("scc")).where("false")
        a, b = found.select(F.col("node").alias("u"), F.col("scc").alias("su")), found.select(F.col("node").alias("w"), F.col("scc").alias("sw"))
        own = link.join(a, "u", "left").join(b, "w", "left").select("v", "u", F.coalesce("su", "u").alias("su"), F.coalesce("sw", "w").alias("sw")).where("su = sw")
        both = own.select(F.explode(F.array("v", "u")).alias("node"), F.col("su").alias("scc"))
        found = checkpointed(found.unionByName(both).distinct())
    return found


def _coloured(edges: DataFrame, most_rounds: int | None) -> DataFrame:
    """(node, c): the least node from which each node can be reached, itself included; one round per step of the longest way."""
    colour = checkpointed(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("c", F.col("node")))
    before, rounds = None, 0
    while True:
        now = colour.agg(F.sum(F.xxhash64("node", "c").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return colour
        if rounds == most_rounds:
            raise RuntimeError(f"colours didn't settle within {most_rounds} rounds")
        before, rounds = now, rounds + 1
        pushed = edges.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "c")
        colour = checkpointed(colour.unionByName(pushed).groupBy("node").agg(F.min("c").alias("c")))


def strong_components(edges: DataFrame, most_rounds: int | None = None, small: int = SMALL) -> DataFrame:
    """(node, scc): strongly connected components of the edges, named by their least node; nodes on no cycle are their own [G7].

    A small graph is walked by one task. A larger one is reduced, then parted by forward-backward colouring: the least colour is pushed along edges until it settles; a node of colour c
    that reaches c backwards within the colour belongs to c's component; found components leave the graph, and the rest goes on.
    Colours only fall and each round takes out a component, so the loops end; with ``most_rounds`` they raise beyond that many.
    """
    everyone = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    links: list[DataFrame] = []
    rest, found, rounds = _reduced(edges, links, most_rounds, small), None, 0
    while n := rest.count():
        if n <= small:
            part = checkpointed(_components_at_once(rest))
            found = part if found is None else found.unionByName(part)
            break
        if rounds == most_rounds:
            raise RuntimeError(f"components didn't settle within {most_rounds} rounds")
        rounds += 1
        colour = _coloured(rest, most_rounds)
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        within = checkpointed(rest.join(a, "src").join(b, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # A colour is the least node of its own, so the nodes that reach it are those to which it comes back against the edges.
        back = _coloured(within, most_rounds).join(colour, ["node", "c"], "left_semi")
        part = checkpointed(back.unionByName(colour.where("node = c")).distinct().select("node", F.col("c").alias("scc")))
        found = part if found is None else checkpointed(found.unionByName(part))
        left = rest.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti")
        rest = _reduced(left, links, most_rounds, small)
    found = _restored(found, links, everyone)
    if found is None:
        return everyone.withColumn("scc", F.col("node"))
    named = found.groupBy("scc").agg(F.min("node").alias("least")).join(found, "scc").select("node", F.col("least").alias("scc"))
    return everyone.join(named, "node", "left").withColumn("scc", F.coalesce("scc", "node"))


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(scc, size, nodes): groups of more than one node that depend on each other."""
    g = strong_components(edges).groupBy("scc").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("nodes"))
    return g.where("size > 1")


def layers(edges: DataFrame, most_rounds: int = 10_000, small: int = SMALL) -> DataFrame:
    """(node, scc, depth): the length of the longest path from a node without dependents, components taken as one node [G8, exact].

    Whoever depends on a node is less deep than it, so dependencies have the greater depth.
    """
    scc = checkpointed(strong_components(edges, small=small))
    a, b = scc.select(F.col("node").alias("src"), F.col("scc").alias("u")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("v"))
    dag = checkpointed(edges.join(a, "src").join(b, "dst").where("u <> v").select("u", "v").distinct())
    if dag.count() <= small:
        at_once = _depths_at_once(dag).withColumnRenamed("node", "scc")
        return scc.join(at_once, "scc", "left").select("node", "scc", F.coalesce("depth", F.lit(0)).alias("depth"))
    depth = checkpointed(scc.select(F.col("scc").alias("node")).distinct().withColumn("depth", F.lit(0)))
    moved = depth
    for level in range(1, most_rounds):
        pushed = dag.join(moved.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct()
        moved = checkpointed(pushed.withColumn("depth", F.lit(level)))
        if moved.isEmpty():
            break
        depth = depth.join(moved.select("node", F.col("depth").alias("d")), "node", "left").select("node", F.coalesce("d", "depth").alias("depth"))
        if level % 4 == 0:
            depth = checkpointed(depth)
    else:
        raise RuntimeError(f"layers didn't settle within {most_rounds} rounds")
    return scc.join(depth.select(F.col("node").alias("scc"), "depth"), "scc").select("node", "scc", "depth")


def topological_order(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(node, depth, rank): dependencies first, ties by component and name [G9, T2]. isolated: further nodes, column ``node``."""
    l = layers(edges)
    if isolated is not None:
        l = l.unionByName(isolated.select("node").distinct().join(l.select("node"), "node", "left_anti").select("node", F.col("node").alias("scc"), F.lit(0).alias("depth")))
    return ranked(l)


def ranked(layered: DataFrame) -> DataFrame:
    """(node, depth, rank): ranks 0, 1, ... by (depth descending, scc, node), numbered per layer and offset by the layers below, so no task sorts all nodes."""
    w = Window.partitionBy("depth").orderBy("scc", "node")
    sizes = layered.groupBy("depth").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return layered.withColumn("k", F.row_number().over(w) - 1).join(before.select("depth", "base"), "depth").select("node", "depth", (F.col("base") + F.col("k")).alias("rank"))


def parallel_levels(edges: DataFrame, nodes: DataFrame, dependencies_first: bool = True) -> DataFrame:
    """(node, level): nodes of a level don't depend on each other; level 0 has no dependencies, or no dependents with the flag off [B6]."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if dependencies_first else edges
    l = layers(turned).select("node", F.col("depth").alias("level"))
    return l.unionByName(nodes.select("node").distinct().join(l, "node", "left_anti").withColumn("level", F.lit(0)))


def bounded_view(edges: DataFrame, start: str, depth: int = 2, most: int = 50) -> DataFrame:
    """(side, node, depth): the nearest ``most`` nodes forwards and backwards of one start, by (depth, node) [G6]."""
    spark = edges.sparkSession
    s = spark.createDataFrame([(start,)], "start string")
    out = None
    for side in ("out", "in"):
        hit = k_hop(edges, s, depth, side).where("depth > 0").orderBy("depth", "node").limit(most).select(F.lit(side).alias("side"), "node", "depth")
        out = hit if out is None else out.unionByName(hit)
    return out


def registry(symbols: DataFrame) -> DataFrame:
    """(name, keys): the symbols of each name, in order of registration [G17]."""
    return symbols.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("reg_order", "key"))), lambda x: x["key"]).alias("keys"))


def identifier_uses(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name, line): every identifier of a text that names a registered symbol, with the line of its first place in the text [G13].

    symbols: (key, start_line, text), names: (name). One pass over the texts; the pairs are narrow before the join.
    """
    lines = symbols.select("key", "start_line", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    words = lines.select("key", (F.col("start_line") + F.col("row")).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("name"))
    return words.groupBy("key", "name").agg(F.min("line").alias("line")).join(names.select("name").distinct(), "name", "left_semi").select("key", "name", "line")


def infer_dep_type(name, next_text, kind):
    """The dependency type of a use: a macro before a call before a member before a type, else by what is registered, else a variable [G14]."""
    return (
        F.when(kind == "macros", "macro_use")
        .when(next_text.rlike(r"^\s*\("), "function_call")
        .when(next_text.rlike(r"^\s*(?:->|\.)"), "struct_member")
        .when(kind.isin("structs", "typedefs"), "type_reference")
        .when(kind == "enums", "enum_use")
        .when(kind == "functions", "function_call")
        .otherwise("variable_use")
    )
