"""Graph operators on edge DataFrames (src, dst): loops of joins, no driver-side graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions.scalars import fan_level, instability_class
from lodegraph.runtime import materialize, release, ship, union_all


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct (src, dst) pairs to walk: forward, reverse or both ways."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return (out if direction == "forward" else back if direction == "reverse" else out.unionByName(back)).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None, direction: str = "forward", by: str | None = None, max_group: int | None = None) -> DataFrame:
    """(seed, node, depth): every node within ``max_depth`` of each seed (None: however far), the seed itself at 0.

    ``seeds``: (seed), or (seed, node) to name a group of starting nodes.
    ``by`` names a column of ``edges`` and ``seeds`` that no way crosses (a
    snapshot): groups of up to ``max_group`` edges and seeds, counted first, are
    walked in one task each, larger ones by joins.  Null seeds take no part.
    """
    max_group = MAX_GROUP_EDGES if max_group is None else max_group
    start = seeds if "node" in seeds.columns else seeds.withColumn("node", F.col("seed"))
    start = start.where(F.col("seed").isNotNull() & F.col("node").isNotNull())
    if by is None:
        return _bfs_by_joins(edges, start, max_depth, direction)
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    rows = edges.select(F.col(by).cast("string").alias("_by"), "src", "dst", F.lit(None).cast("string").alias("seed")).unionByName(start.select(F.col(by).cast("string").alias("_by"), F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), "seed"))
    small, large = _by_size(rows, max_group)

    def walk(src: np.ndarray, dst: np.ndarray, seed: np.ndarray) -> Iterator[pd.DataFrame]:
        return _walk(src, dst, seed, max_depth, direction)

    found = _each_group(small, ["src", "dst", "seed"], walk, "seed string, node string, depth int")
    if large is None:
        return found
    far = _bfs_by_joins(large.where(F.col("dst").isNotNull()), large.where(F.col("dst").isNull()).select("seed", F.col("src").alias("node")), max_depth, direction)
    return found.unionByName(far)


def _bfs_by_joins(edges: DataFrame, seeds: DataFrame, max_depth: int | None, direction: str) -> DataFrame:
    """One join per level; a level without new nodes ends it."""
    walk = materialize(directed(edges, direction), "walk")
    seen = materialize(seeds.select("seed", "node", F.lit(0).alias("depth")).distinct(), "bfs")
    front, depth, levels = seen, 0, [seen]
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = front.join(walk, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = materialize(reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            release(front)
            break
        levels.append(front)
        if len(levels) > 20:  # few files, short plans
            merged = materialize(union_all(levels), "bfs")
            for x in levels[:-1]:
                release(x)
            levels = [merged]
        seen = union_all(levels)
    release(walk)
    return seen


def _walk(src: np.ndarray, dst: np.ndarray, seed: np.ndarray, max_depth: int | None, direction: str) -> Iterator[pd.DataFrame]:
    """Breadth-first walks of one group; rows without ``dst`` name the starting nodes."""
    near: dict[str, list[str]] = {}
    starts: dict[str, list[str]] = {}
    for a, b, s in zip(src, dst, seed):
        if b is None:
            starts.setdefault(s, []).append(a)
            continue
        if direction != "reverse":
            near.setdefault(a, []).append(b)
        if direction != "forward":
            near.setdefault(b, []).append(a)
    for s, begun in starts.items():
        depth = dict.fromkeys(begun, 0)
        front, d = list(depth), 0
        while front and (max_depth is None or d < max_depth):
            d += 1
            nxt = []
            for v in front:
                for w in near.get(v, ()):
                    if w not in depth:
                        depth[w] = d
                        nxt.append(w)
            front = nxt
        yield pd.DataFrame({"seed": s, "node": list(depth), "depth": list(depth.values())}).astype({"depth": "int32"})


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int, by: str | None = None) -> DataFrame:
    """(seed, node, depth, impact): both directions, the smaller depth; depth 1 is direct, more is indirect."""
    both = bfs(edges, seeds, max_depth, "forward", by).unionByName(bfs(edges, seeds, max_depth, "reverse", by))
    near = both.groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    return near.withColumn("impact", F.when(F.col("depth") <= 1, "direct").otherwise("indirect"))


#: Edges of one group that a single task may hold.
MAX_GROUP_EDGES = 200_000
#: Nodes whose reachability one pass over a group's edges follows, a bit each.
REACH_BITS = 8192


def _by_size(rows: DataFrame, max_group: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of groups (column ``_by``) of up to ``max_group`` rows, and the rest (None if there is none).

    Fewer groups than rows / ``max_group`` can be large, so their keys are few
    enough to be listed and broadcast.
    """
    rows = materialize(rows, "groups")
    large = [r[0] for r in rows.groupBy("_by").count().where(F.col("count") > max_group).select("_by").toLocalIterator()]
    if not large:
        return rows, None
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in large], "_by string"))
    same = F.col("_by").eqNullSafe(F.col("_key"))
    keys = keys.withColumnRenamed("_by", "_key")
    return rows.join(keys, same, "left_anti"), rows.join(keys, same, "left_semi")


def _each_group(rows: DataFrame, columns: list[str], solve: Callable[..., Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``solve`` on the ``columns`` of each group of ``_by``: one shuffle, many groups a task, one group in memory at a time."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                cols = [whole[c].astype(object).where(whole[c].notna(), None).to_numpy() for c in columns]
                held.clear()
                yield from solve(*cols)

        last: object = None
        for b in batches:
            key = b["_by"].fillna("")
            cuts = np.flatnonzero((key != key.shift()).to_numpy())
            for a, z in zip(cuts, [*cuts[1:], len(b)]):
                k = key.iloc[a]
                if held and k != last:
                    yield from flush()
                last = k
                held.append(b.iloc[a:z])
        yield from flush()

    return rows.select("_by", *columns).repartition("_by").sortWithinPartitions("_by").mapInPandas(run, schema)


def _solve(src: np.ndarray, dst: np.ndarray, reach: bool) -> pd.DataFrame:
    """Component, weak component, depth, level and reach of every node of one group of edges."""
    names, codes = np.unique(np.concatenate([src, dst]).astype(str), return_inverse=True)
    n, m = len(names), len(src)
    pairs = np.unique(codes[:m] * n + codes[m:])
    loops = np.zeros(n, bool)
    a, b = pairs // n, pairs % n
    loops[a[a == b]] = True
    a, b = a[a != b], b[a != b]
    ends = np.searchsorted(a, np.arange(n + 1)).tolist()
    out = b.tolist()
    comp, order = _strong(n, ends, out)
    size = np.bincount(comp, minlength=order)
    first = np.full(order, n)
    np.minimum.at(first, comp, np.arange(n))
    succ: list[set[int]] = [set() for _ in range(order)]
    for x, y in zip(comp[a].tolist(), comp[b].tolist()):
        if x != y:
            succ[x].add(y)
    depth = [1] * order
    for c in range(order):  # components come with those they lead to first
        for t in succ[c]:
            if depth[t] >= depth[c]:
                depth[c] = depth[t] + 1
    cyclic = size > 1
    cyclic[comp[loops]] = True
    level: list[int | None] = [0] * order
    for c in range(order - 1, -1, -1):
        if cyclic[c]:
            level[c] = None
        for t in succ[c]:
            if level[c] is None:
                level[t] = None
            elif level[t] is not None:
                level[t] = max(level[t], level[c] + 1)
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    weak = [find(v) for v in range(n)]
    counts = np.zeros(order, np.int64)
    if reach:
        member = np.argsort(comp, kind="stable")
        for lo in range(0, n, REACH_BITS):
            own = [0] * order
            for i, v in enumerate(member[lo : lo + REACH_BITS].tolist()):
                own[comp[v]] |= 1 << i
            far = [0] * order
            for c in range(order):
                got = own[c] if cyclic[c] else 0
                for t in succ[c]:
                    got |= own[t] | far[t]
                far[c] = got
            counts += np.fromiter((x.bit_count() for x in far), np.int64, order)
    return pd.DataFrame(
        {
            "id": names,
            "component": names[first[comp]],
            "weak": names[weak],
            "depth": np.array(depth, np.int32)[comp],
            "level": pd.array([level[c] for c in comp.tolist()], "Int32"),
            "reach": counts[comp],
        }
    )


def _strong(n: int, ends: list[int], out: list[int]) -> tuple[np.ndarray, int]:
    """(component of each node, components), sinks first; depth-first without recursion."""
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    at = ends[:n]
    stack: list[int] = []
    tick = done = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        way = [root]
        index[root] = low[root] = tick
        tick += 1
        stack.append(root)
        while way:
            v = way[-1]
            if at[v] < ends[v + 1]:
                w = out[at[v]]
                at[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = tick
                    tick += 1
                    stack.append(w)
                    way.append(w)
                elif comp[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
                continue
            way.pop()
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    comp[w] = done
                    if w == v:
                        break
                done += 1
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
    return np.array(comp, np.int64), done


FACTS = "id string, component string, weak string, depth int, level int, reach bigint"


def graph_facts(nodes: DataFrame, edges: DataFrame, by: str | None = None, wanted: tuple[str, ...] = ("component", "weak", "depth", "level", "reach"), max_group: int = MAX_GROUP_EDGES) -> DataFrame:
    """(id, *wanted) of every node.

    ``component``: smallest id of its strongly connected component; ``weak``: of
    its weakly connected one; ``depth``: components on the longest way down (a
    leaf has 1); ``level``: edges on the longest way from a source, null on and
    behind cycles; ``reach``: nodes reached by one edge or more.  ``by`` names a
    column of ``edges`` that no way crosses (a snapshot).  Groups of up to
    ``max_group`` edges, counted first, are solved in one task each; larger ones,
    with the same results, by joins.  Edges with a null end take no part; nodes
    without edges, or absent from ``nodes`` but at an edge's end, are answered
    for only if ``nodes`` has them.
    """
    alone = nodes.select("id").where(F.col("id").isNotNull()).distinct()
    rows = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select((F.col(by) if by else F.lit("")).cast("string").alias("_by"), "src", "dst").distinct()
    small, large = _by_size(rows, max_group)
    reach = "reach" in wanted
    found = _each_group(small, ["src", "dst"], lambda src, dst: iter([_solve(src, dst, reach)]), FACTS).select("id", *wanted)
    if large is not None:
        found = found.unionByName(_facts_by_joins(large, wanted))
    found = materialize(found, "facts")
    empty = {"component": F.col("id"), "weak": F.col("id"), "depth": F.lit(1), "level": F.lit(0), "reach": F.lit(0).cast("bigint")}
    met = alone.join(found.withColumn("_there", F.lit(True)), "id", "left")
    return met.select("id", *[F.when(F.col("_there").isNull(), empty[w]).otherwise(F.col(w)).alias(w) for w in wanted])


def _facts_by_joins(edges: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    links = materialize(edges.select("src", "dst").distinct(), "large")
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    out = ends
    if {"component", "depth", "level", "reach"} & set(wanted):
        comps = _components_by_joins(ends, links)
        dag = materialize(condensation(links, comps), "dag")
        heads = comps.select(F.col("component").alias("id")).distinct()
        out = out.join(comps, "id")
        if "depth" in wanted:
            out = out.join(dag_depth(heads, dag).withColumnRenamed("id", "component"), "component")
        if "level" in wanted or "reach" in wanted:
            loops = links.where(F.col("src") == F.col("dst")).select(F.col("src").alias("id")).join(comps, "id").select("component")
            cyclic = materialize(comps.groupBy("component").count().where(F.col("count") > 1).select("component").unionByName(loops).distinct(), "cyclic")
        if "level" in wanted:
            behind = _behind(cyclic.select(F.col("component").alias("id")), dag)
            free = heads.join(behind, "id", "left_anti")
            up = dag.join(behind.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            out = out.join(dag_depth(free, up).select(F.col("id").alias("component"), (F.col("depth") - 1).alias("level")), "component", "left")
        if "reach" in wanted:
            out = out.join(_reach_by_joins(comps, dag, cyclic).withColumnRenamed("id", "component"), "component")
    if "weak" in wanted:
        out = out.join(_weak_by_joins(ends, links).withColumnRenamed("component", "weak"), "id")
    return out.select("id", *wanted)


def _behind(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(id): ``starts`` and all that is reached from them; only the newest are followed."""
    return _bfs_by_joins(links, starts.select(F.lit("").alias("seed"), F.col("id").alias("node")), None, "forward").select(F.col("node").alias("id"))


def _reach_by_joins(comps: DataFrame, dag: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(id, reach) of components: nodes reached, 63 to a row as bits; each round only new bits move up."""
    at = comps.withColumn("_n", F.row_number().over(W.partitionBy(F.pmod(F.xxhash64("id"), F.lit(1024))).orderBy("id")) - 1)
    block = F.concat_ws("/", F.pmod(F.xxhash64("id"), F.lit(1024)), F.floor(F.col("_n") / 63))
    own = materialize(at.select("component", block.alias("block"), F.expr("shiftleft(1L, cast(pmod(_n, 63) AS int))").alias("bit")).groupBy("component", "block").agg(F.bit_or("bit").alias("bits")), "own")
    far = dag.join(own.withColumnRenamed("component", "dst"), "dst").select(F.col("src").alias("component"), "block", "bits")
    new = materialize(far.unionByName(own.join(cyclic, "component", "left_semi")).groupBy("component", "block").agg(F.bit_or("bits").alias("bits")), "reach")
    seen = new
    while not new.isEmpty():
        up = dag.join(new.withColumnRenamed("component", "dst"), "dst").groupBy(F.col("src").alias("component"), "block").agg(F.bit_or("bits").alias("add"))
        met = materialize(seen.join(up, ["component", "block"], "full_outer").select("component", "block", F.coalesce("bits", F.lit(0).cast("bigint")).alias("old"), F.coalesce("add", F.lit(0).cast("bigint")).alias("add")), "reach")
        for x in {id(seen): seen, id(new): new}.values():
            release(x)
        new = materialize(met.select("component", "block", F.col("add").bitwiseAND(F.bitwise_not(F.col("old"))).alias("bits")).where(F.col("bits") != 0), "reach")
        seen = materialize(met.select("component", "block", F.col("old").bitwiseOR(F.col("add")).alias("bits")), "reach")
        release(met)
    counts = seen.groupBy("component").agg(F.sum(F.bit_count("bits")).alias("reach"))
    return comps.select("component").distinct().join(counts, "component", "left").select(F.col("component").alias("id"), F.coalesce("reach", F.lit(0).cast("bigint")).alias("reach"))


def reach_counts(nodes: DataFrame, edges: DataFrame, by: str | None = None, max_group: int = MAX_GROUP_EDGES) -> DataFrame:
    """(id, reach): how many nodes each node reaches by one edge or more, without the pairs."""
    return graph_facts(nodes, edges, by, ("reach",), max_group)


def weak_components(nodes: DataFrame, edges: DataFrame, by: str | None = None, max_group: int = MAX_GROUP_EDGES) -> DataFrame:
    """(id, component): the smallest id of the component."""
    return graph_facts(nodes, edges, by, ("weak",), max_group).withColumnRenamed("weak", "component")


def strong_components(nodes: DataFrame, edges: DataFrame, by: str | None = None, max_group: int = MAX_GROUP_EDGES) -> DataFrame:
    """(id, component): the smallest id of each strongly connected component."""
    return graph_facts(nodes, edges, by, ("component",), max_group)


def _weak_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the component.

    Each round a node and the node it points to take the least pointer's pointer
    among the node's neighbours, and pointers jump to their pointer's pointer;
    it ends when nothing changes, on long chains after a logarithm of rounds.
    """
    links = materialize(directed(edges.where(F.col("src") != F.col("dst")), "both"), "links")
    label = materialize(nodes.select("id", F.col("id").alias("component")).distinct(), "wcc")
    while True:
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("g"))
        far = materialize(label.join(jump, "component", "left").select("id", F.col("component").alias("c"), F.coalesce("g", "component").alias("g")), "wcc")
        heard = links.join(far, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.min("g").alias("m"))
        met = materialize(far.join(heard, "id", "left").select("id", "c", F.least("c", "g", "m").alias("n"), "m"), "wcc")
        hooks = met.where(F.col("m") < F.col("c")).select(F.col("c").alias("id"), F.lit(None).cast(nodes.schema["id"].dataType).alias("c"), F.col("m").alias("n"))
        nxt = materialize(met.select("id", "c", "n").unionByName(hooks).groupBy("id").agg(F.max("c").alias("old"), F.min("n").alias("component")), "wcc")
        done = nxt.where(F.col("old") != F.col("component")).isEmpty()
        for x in (label, far, met):
            release(x)
        label = nxt
        if done:
            return label.select("id", "component")


def _behind_ends(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id): nodes without a way in, and all that is reached from them by only ways in, however long the chain (by doubling)."""
    only = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.min("src").alias("up"))
    start = nodes.join(only, "id", "left_anti").select("id", F.lit(None).cast("string").alias("up"))
    up = materialize(only.where(F.col("k") == 1).select("id", "up").unionByName(start), "up")
    known = up.where(F.col("up").isNull()).count()
    while known:
        above = up.select(F.col("id").alias("up"), F.col("up").alias("next"), F.lit(True).alias("there"))
        nxt = materialize(up.join(above, "up", "left").select("id", F.when(F.col("there"), F.col("next")).otherwise(F.col("up")).alias("up")), "up")
        now = nxt.where(F.col("up").isNull()).count()
        release(up)
        up = nxt
        if now == known:
            break
        known = now
    return up.where(F.col("up").isNull()).select("id")


def _first_before(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, c): the least ``p`` of the nodes that reach each node, itself among them; ``nodes``: (id, p), ``p`` unique."""
    label = materialize(nodes.select("id", "p", F.col("p").alias("c")), "colour")
    while True:
        heard = links.join(label, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        low = label.join(heard, "id", "left").select("id", "p", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = label.select(F.col("p").alias("c"), F.col("c").alias("j"))
        nxt = materialize(low.join(jump, "c").select("id", "p", "old", F.least("c", "j").alias("c")), "colour")
        same = nxt.where(F.col("old") != F.col("c")).isEmpty()
        release(label)
        label = nxt
        if same:
            return label.select("id", "c")


def _components_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strong components without any group in one task.

    Nodes behind dead ends only are components of their own and are trimmed
    until none is left.  Of the rest each node takes the first node, in an order
    shuffled anew each time, that reaches it and the first that it reaches inside
    that colour; where both are the same they name its component, and no other
    component crosses nodes that differ in either.  Neither loop has a bound:
    each phase finds at least the first node's component.
    """
    left = materialize(nodes.select("id").distinct(), "scc")
    links = materialize(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct(), "scc-links")
    found, phase = [], 0
    while True:
        while True:
            back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            dead = materialize(_behind_ends(left, links).unionByName(_behind_ends(left, back)).distinct(), "dead")
            if dead.isEmpty():
                break
            found.append(dead.select("id", F.col("id").alias("component")))
            left = materialize(left.join(dead, "id", "left_anti"), "scc")
            links = materialize(links.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc-links")
            if len(found) > 20:
                found = [materialize(union_all(found), "found")]
        if left.isEmpty():
            return materialize(union_all(found), "found") if found else left.select("id", F.col("id").alias("component"))
        order = materialize(left.withColumn("p", F.concat(F.lpad(F.hex(F.xxhash64("id", F.lit(phase))), 16, "0"), "id")), "order")
        colour = _first_before(order, links)
        a, b = colour.select(F.col("id").alias("src"), F.col("c").alias("sc")), colour.select(F.col("id").alias("dst"), F.col("c").alias("dc"))
        within = materialize(links.join(a, "src").join(b, "dst").where(F.col("sc") == F.col("dc")).select("src", "dst"), "within")
        ahead = _first_before(order, within.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = materialize(colour.join(ahead.withColumnRenamed("c", "d"), "id"), "both")
        done = both.where(F.col("c") == F.col("d"))
        names = done.groupBy("c").agg(F.min("id").alias("component"))
        found.append(materialize(done.join(names, "c").select("id", "component"), "found"))
        rest = materialize(both.where(F.col("c") != F.col("d")).select("id", "d"), "rest")
        a, b = rest.select(F.col("id").alias("src"), F.col("d").alias("sd")), rest.select(F.col("id").alias("dst"), F.col("d").alias("dd"))
        links = materialize(within.join(a, "src").join(b, "dst").where(F.col("sd") == F.col("dd")).select("src", "dst"), "scc-links")
        left = rest.select("id")
        phase += 1


def condensation(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between different components."""
    a, b = comps.select(F.col("id").alias("src"), F.col("component").alias("cs")), comps.select(F.col("id").alias("dst"), F.col("component").alias("cd"))
    return edges.join(a, "src").join(b, "dst").where(F.col("cs") != F.col("cd")).select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def dag_depth(nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """(id, depth): nodes on the longest way down from each node of a DAG; a leaf has 1.

    Nodes with one way out whose end has one way in form chains; a chain becomes
    one edge as long as it is, found by doubling.  Over what is left only nodes
    whose depth has just risen speak to those above them, so a round costs what
    it changes; it ends when none rises.
    """
    links = materialize(dag.select("src", "dst").distinct(), "dag")
    outs = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.min("dst").alias("down"))
    ins = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("j"))
    deg = materialize(nodes.select("id").distinct().join(outs, "id", "left").join(ins, "id", "left").fillna(0, ["k", "j"]), "degrees")
    # inner: one way out, one way in; its depth follows from the end of its chain
    inner = deg.where((F.col("k") == 1) & (F.col("j") == 1)).select("id", "down")
    jump = materialize(inner.select("id", F.col("down").alias("end"), F.lit(1).cast("bigint").alias("steps")), "chain")
    while True:
        on = jump.select(F.col("id").alias("end"), F.col("end").alias("e2"), F.col("steps").alias("s2"))
        nxt = materialize(jump.join(on, "end", "left").select("id", F.coalesce("e2", "end").alias("end"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), F.col("e2").isNotNull().alias("moved")), "chain")
        done = nxt.where("moved").isEmpty()
        release(jump)
        jump = nxt
        if done:
            break
    chains = jump.select("id", "end", "steps")
    ends = chains.select(F.col("id").alias("dst"), "end", "steps")
    outer = links.join(inner.select(F.col("id").alias("src")), "src", "left_anti")
    far = materialize(outer.join(ends, "dst", "left").select("src", F.coalesce("end", "dst").alias("dst"), (F.coalesce("steps", F.lit(0)) + 1).alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w")), "far")
    depth = materialize(deg.join(inner.select("id"), "id", "left_anti").select("id", F.lit(1).cast("bigint").alias("depth")), "depth")
    risen = depth
    while True:
        best = far.join(risen.select(F.col("id").alias("dst"), "depth"), "dst").groupBy(F.col("src").alias("id")).agg(F.max(F.col("depth") + F.col("w")).alias("d"))
        nxt = materialize(depth.join(best, "id", "left").select("id", F.greatest("depth", F.coalesce("d", "depth")).alias("depth"), (F.col("d") > F.col("depth")).alias("up")), "depth")
        release(depth)
        depth, risen = nxt, nxt.where("up").select("id", "depth")
        if risen.isEmpty():
            break
    tails = chains.join(depth.select(F.col("id").alias("end"), "depth"), "end").select("id", (F.col("depth") + F.col("steps")).alias("depth"))
    out = materialize(depth.select("id", "depth").unionByName(tails).select("id", F.col("depth").cast("int").alias("depth")), "depths")
    for x in (links, deg, far, depth):
        release(x)
    return out


def node_depths(nodes: DataFrame, edges: DataFrame, by: str | None = None, max_group: int = MAX_GROUP_EDGES) -> DataFrame:
    """(id, depth) counted in components."""
    return graph_facts(nodes, edges, by, ("depth",), max_group)


def topological_levels(nodes: DataFrame, edges: DataFrame, by: str | None = None, max_group: int = MAX_GROUP_EDGES) -> DataFrame:
    """(id, level, cyclic): Kahn's levels; nodes that no level takes are on or behind a cycle."""
    return graph_facts(nodes, edges, by, ("level",), max_group).withColumn("cyclic", F.col("level").isNull())


def fans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in, fan_out (parallel edges count), their sum, share, level and the two flags."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    out = nodes.join(i, "id", "left").join(o, "id", "left").fillna(0, ["fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    return (
        out.withColumn("total", total)
        .withColumn("concentration", F.when(total > 0, F.round(F.col("fan_in") / total, 4)).otherwise(0.0))
        .withColumn("fan_level", fan_level(F.greatest("fan_in", "fan_out")))
        .withColumn("utility_hotspot", (F.col("fan_out") >= 20) & (F.col("fan_in") < F.col("fan_out") * 0.2))
        .withColumn("god_module", (F.col("fan_in") >= 50) & (F.col("fan_out") >= 50))
    )


def instability(fan: DataFrame) -> DataFrame:
    total = F.col("fan_in") + F.col("fan_out")
    value = F.when(total > 0, F.round(F.col("fan_out") / total, 4)).otherwise(0.0)
    return fan.withColumn("instability", value).withColumn("instability_class", instability_class(value))


def centrality(fan: DataFrame, reach: DataFrame, comp_size: DataFrame, by: str) -> DataFrame:
    """(id, score): in- and out-degree, reach and two dampings, relative to the largest of each ``by``."""
    v = fan.groupBy(by).agg(F.count(F.lit(1)).alias("v"))
    met = fan.join(reach, "id", "left").join(comp_size, "id", "left").fillna(0, ["reach"]).fillna(1, ["size"]).join(v, by)
    raw = (F.col("fan_in") * 0.7 + F.col("fan_out") * 0.3) * F.col("reach") / F.col("v")
    raw = raw * F.when(F.col("size") > 1, 0.85).otherwise(1.0) * F.when((F.col("fan_out") >= 20) & (F.col("fan_in") <= 5), 0.65).otherwise(1.0)
    met = materialize(met.select("id", by, raw.alias("raw")), "raw")
    met = met.join(met.groupBy(by).agg(F.max("raw").alias("top")), by)
    return met.select("id", by, F.when(F.col("top") > 0, F.round(F.col("raw") / F.col("top"), 4)).otherwise(0.0).alias("score"))


def density(v: Column, e: Column) -> Column:
    return F.when(v > 1, e * 2 / (v * (v - 1))).otherwise(0.0)


def entropy(counts: DataFrame, by: str, value: str) -> DataFrame:
    """(by, entropy): Shannon entropy of the shares of ``value``, 1 for equal shares."""
    p = F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(by)))
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    met = counts.withColumn("p", p).withColumn("n", n)
    return met.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p"))), F.lit(0.0)).alias("h"), F.first("n").alias("n")).select(by, F.when(F.col("n") > 1, F.round(F.try_divide(F.col("h"), F.log2("n")), 4)).otherwise(0.0).alias("entropy"))


def cascade(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(seed, cascade): the weights of the ways by which nodes are first reached, multiplied along each way.

    Of several ways of one length the one from the node reached first, then the
    smallest id, counts; the last parallel edge by id gives the weight.
    """
    last = edges.groupBy("src", "dst").agg(F.max_by("weight", "id").alias("w")).withColumn("w", F.coalesce("w", F.lit(1.0)))
    last = materialize(last, "weights")
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("way"), F.lit(0).cast("bigint").alias("rank"))
    front, parts = seen, []
    for _ in range(max_depth):
        met = front.join(last, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), (F.col("way") * F.col("w")).alias("way"), "rank")
        first = F.row_number().over(W.partitionBy("seed", "node").orderBy("rank"))
        met = met.withColumn("r", first).where(F.col("r") == 1).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = materialize(met.select("seed", "node", "way", F.row_number().over(W.partitionBy("seed").orderBy("rank", "node")).cast("bigint").alias("rank")), "cascade")
        parts.append(front)
        seen = seen.unionByName(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return seeds.select("seed").join(out.groupBy("seed").agg(F.sum("way").alias("s")), "seed", "left").select("seed", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("cascade"))
