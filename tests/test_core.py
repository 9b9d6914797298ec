import random

from pyspark.sql import functions as F

from lodegraph.operators import graph, hierarchy, orphans, relational, snapshot_diff

ENTRY = "id string, parent_id string, entry_ts long, path string, nxt string"


def brute(parents):
    out = {}
    for i in parents:
        way = [i]
        while True:
            p = parents[way[-1]]
            if not p or p not in parents:
                out[i] = (way[-1], len(way) - 1, None)
                break
            if p in way:
                out[i] = (None, None, min(way[way.index(p) :]))
                break
            way.append(p)
    return out


def entries(spark, parents):
    return spark.createDataFrame([(i, p, 1, "x", "y") for i, p in parents.items()], ENTRY)


def resolved(df):
    return {r.id: (r.root_id, r.depth, r.cycle_id) for r in df.collect()}


def test_hierarchy_against_brute_force(spark):
    rnd = random.Random(3)
    ids = [f"n{i:03d}" for i in range(300)]
    parents = {x: rnd.choice([None, "", "gone", *ids[:50], *ids[max(0, i - 3) : i + 1]]) for i, x in enumerate(ids)}
    parents["n200"] = "n200"
    want = brute(parents)
    for rows in (10_000, 40, 7):
        assert resolved(hierarchy.resolve_hierarchy(entries(spark, parents), fragment_rows=rows)) == want


def test_long_chain_and_long_loop_need_pointer_doubling(spark):
    chain = {f"c{i:04d}": f"c{i - 1:04d}" if i else None for i in range(400)}
    loop = {f"l{i:03d}": f"l{(i + 1) % 90:03d}" for i in range(90)}
    tail = {f"t{i}": f"t{i - 1}" if i else "l050" for i in range(30)}
    parents = chain | loop | tail
    assert resolved(hierarchy.resolve_hierarchy(entries(spark, parents), fragment_rows=25)) == brute(parents)


def test_hierarchy_last_delivery_nulls_empty_and_locality(spark):
    df = spark.createDataFrame([("a", "b", 1, "", ""), ("a", None, 2, "", ""), ("a", None, 2, "", ""), (None, "a", 1, "", ""), ("b", "a", None, "", "")], ENTRY)
    assert resolved(hierarchy.resolve_hierarchy(df, locality=["path"])) == {"a": ("a", 0, None), "b": ("a", 1, None)}
    assert resolved(hierarchy.resolve_hierarchy(df.limit(0))) == {}


def test_paths_and_descendants(spark):
    parents = {"a": None, "b": "a", "c": "b", "x": "y", "y": "x"}
    got = hierarchy.resolve_hierarchy(entries(spark, parents), paths=True, fragment_rows=2)
    assert {r.id: r.path for r in got.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "x": None, "y": None}
    assert {tuple(r) for r in hierarchy.descendants(got).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_snapshot_changes(spark):
    snaps = spark.createDataFrame([("s1", "p", 1, "ACTIVE"), ("s2", "p", 2, "FAILED"), ("s3", "p", 5, "DEGRADED"), ("s3", "p", 5, "DEGRADED"), ("s4", None, 1, "ACTIVE")], "id string, project_id string, version_no long, status string")
    n = [
        ("1", "s1", r".\a\x.ts", "AA", "FILE", 1), ("2", "s1", "a/y.ts", None, "FILE", 1), ("3", "s1", "a/z.ts", "cc", "FILE", 1), ("4", "s2", "q.ts", "cc", "FILE", 1),
        ("5", "s3", "a/x.ts", "aa", "FILE", 1), ("6", "s3", "./a/y.ts", "bb", "FILE", 1), ("7", "s3", "A/z.ts", "cc", "FILE", 1), ("7", "s3", "A/w.ts", "cc", "FILE", 2), ("8", "s3", "a/s.ts", "ee", "CLASS", 1),
        ("9", None, "a", "b", "FILE", 1), ("10", "s3", None, "b", "FILE", 1),
    ]
    nodes = spark.createDataFrame(n, "id string, snapshot_id string, file_path string, file_hash string, node_type string, created_at long")
    want = {("s3", "a/y.ts", "modified"), ("s3", "a/z.ts", "removed"), ("s3", "A/w.ts", "added")}
    for tree in ({}, {"fan": 2, "depth": 5}):
        assert {tuple(r) for r in snapshot_diff.snapshot_changes(nodes, snaps, **tree).collect()} == want
    assert snapshot_diff.snapshot_changes(nodes.limit(0), snaps).count() == 0


def test_orphans_direct_and_inherited(spark):
    t = {
        "snapshots": spark.createDataFrame([("s",)], "id string"),
        "nodes": spark.createDataFrame([("a", "s", "extra")], "id string, snapshot_id string, level string"),
        "edges": spark.createDataFrame([("e1", "s", "a", "zz", None), ("e1", "s", "a", "zz", None), ("e2", "t", "a", "", None), ("e3", "s", "a", None, None)], "id string, snapshot_id string, source_node_id string, target_node_id string, created_at timestamp"),
        "evidence_links": spark.createDataFrame([("l1", "s", "e1", None), ("l2", "gone", None, None), ("l3", None, "e3", None)], "id string, snapshot_id string, edge_id string, created_at timestamp"),
    }
    got = {(r.table_name, r.row_id, r.field_name, r.level) for r in orphans.orphan_references(t).collect()}
    assert got == {("edges", "e1", "target_node_id", 0), ("edges", "e2", "source_node_id", 0), ("evidence_links", "l2", "snapshot_id", 0), ("evidence_links", "l1", "edge_id", 1), ("evidence_links", "l3", "edge_id", 1)} - {("evidence_links", "l3", "edge_id", 1)}
    empty = {k: v.limit(0) for k, v in t.items()}
    assert orphans.orphan_report(orphans.orphan_references(empty)).count() == 0


def test_orphans_inherit_by_all_columns_and_any_depth(spark):
    keys = (orphans.ForeignKey("rows", "up", "rows", also=(("snap", "snap"),)),)
    chain = [(f"r{i}", "s", f"r{i - 1}" if i else "gone", None) for i in range(8)]
    other = [("r0", "t", None, None), ("x", "t", "r0", None)]  # its parent exists in its own snapshot
    t = {"rows": spark.createDataFrame(chain + other, "id string, snap string, up string, created_at timestamp")}
    got = {(r.row_id, r.level) for r in orphans.orphan_references(t, keys).collect()}
    assert got == {(f"r{i}", i) for i in range(8)}


def test_last_delivery_into_another_snapshot(spark):
    snaps = spark.createDataFrame([("s1", "p", 1, "ACTIVE"), ("s2", "p", 2, "FAILED"), ("s3", "p", 3, "ACTIVE")], "id string, project_id string, version_no long, status string")
    rows = [("1", "s1", "a", "x", "FILE", 1), ("2", "s3", "a", "x", "FILE", 1), ("3", "s3", "b", "x", "FILE", 1), ("3", "s2", "b", "x", "FILE", 2)]
    nodes = spark.createDataFrame(rows, "id string, snapshot_id string, file_path string, file_hash string, node_type string, created_at long")
    assert snapshot_diff.snapshot_changes(nodes, snaps).count() == 0


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "g") for a, b in pairs], "src string, dst string, snapshot_id string")


def test_components_by_task_and_by_joins(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("e", "f")]
    nodes = spark.createDataFrame([(c,) for c in "abcdefxz"], "id string")
    want = {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "x": "x", "z": "z"}
    e = edges(spark, pairs)
    for args in ({}, {"max_group": 2}, {"by": "snapshot_id"}, {"by": "snapshot_id", "max_group": 2}):
        assert {r.id: r.component for r in graph.strong_components(nodes, e, **args).collect()} == want
    assert {r.id: r.component for r in graph.weak_components(nodes, e).collect()} == {**dict.fromkeys("abcdef", "a"), "x": "x", "z": "z"}


def test_bfs_levels_and_budget(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    seeds = spark.createDataFrame([("a",), ("nowhere",)], "seed string")
    assert {tuple(r) for r in graph.bfs(e, seeds, 2).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("nowhere", "nowhere", 0)}
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    assert {r.id: r.level for r in graph.topological_levels(nodes, e).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    items = spark.createDataFrame([("k", i, c) for i, c in enumerate([5, 4, 3, 9, 1, 1])], "g string, i int, c int")
    assert sorted(r.i for r in relational.greedy(items, ["g"], [items.i], "c", 9).collect()) == [0, 1]
    assert sorted(r.i for r in relational.greedy(items, ["g"], [items.i], "c", 10).collect()) == [0, 1, 4]


def test_weak_components_of_long_chains(spark):
    rnd = random.Random(2)
    ids = [f"n{i:04d}" for i in range(1000)]
    rnd.shuffle(ids)
    chains = [ids[:700], ids[700:]]
    e = edges(spark, [(a, b) if rnd.random() < 0.5 else (b, a) for c in chains for a, b in zip(c, c[1:])])
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    for most in (200_000, 100):
        assert {r.id: r.component for r in graph.weak_components(nodes, e, max_group=most).collect()} == {x: min(c) for c in chains for x in c}


def test_strong_components_by_joins_of_long_chains(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(499)]
    rings = [x for i in range(40) for x in ((f"r{i:02d}a", f"r{i:02d}b"), (f"r{i:02d}b", f"r{i:02d}a"), (f"r{i:02d}b", f"r{i + 1:02d}a"))][:-1]
    pairs = chain + rings
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id string")
    got = {r.id: r.component for r in graph.strong_components(nodes, edges(spark, pairs), "snapshot_id", max_group=2).collect()}
    assert got == {x: x[:3] + "a" if x[0] == "r" else x for p in pairs for x in p}


def brute_facts(nodes, pairs):
    out = {v: {b for a, b in pairs if a == v} for v in nodes}
    reach = {}
    for v in nodes:
        seen, todo = set(), list(out[v])
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += out[w]
        reach[v] = seen
    comp = {v: min([v, *(w for w in reach[v] if v in reach[w])]) for v in nodes}
    dag = {(comp[a], comp[b]) for a, b in pairs if comp[a] != comp[b]}

    def longest(v, links):
        return max([0, *(1 + longest(b, links) for a, b in links if a == v)])

    behind = {w for v in nodes if v in reach[v] for w in {v} | reach[v]}
    back = {(b, a) for a, b in pairs}
    around = dict(zip(nodes, nodes))
    for _ in nodes:
        for a, b in pairs:
            around[a] = around[b] = min(around[a], around[b])
    return {v: (comp[v], around[v], longest(comp[v], dag) + 1, None if v in behind else longest(v, back), len(reach[v])) for v in nodes}


def test_facts_by_task_and_by_joins_agree_with_brute_force(spark):
    rnd = random.Random(8)
    names = [f"v{i:02d}" for i in range(26)]
    for size, split in ((30, 13),):
        pairs = [(a, b) for a, b in ((rnd.choice(names), rnd.choice(names)) for _ in range(size)) if (a < names[split - 1]) == (b < names[split - 1])]
        pairs += [("v00", "v01"), ("v01", "v02"), ("v02", "v03"), ("v03", "v03")]
        want = brute_facts(names, set(pairs))
        e = spark.createDataFrame([(a, b, str(a < names[split - 1])) for a, b in pairs], "src string, dst string, snapshot_id string")
        nodes = spark.createDataFrame([(x,) for x in names], "id string")
        for args in ((None, 10_000), ("snapshot_id", 10_000), ("snapshot_id", 8), (None, 1)):
            got = graph.graph_facts(nodes, e, args[0], max_group=args[1]).collect()
            assert {r.id: (r.component, r.weak, r.depth, r.level, r.reach) for r in got} == want
    assert graph.graph_facts(nodes.limit(0), e.limit(0)).count() == 0


def test_chain_of_10000_and_ring_of_1000(spark):
    pairs = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(9_999)] + [(f"r{i:03d}", f"r{(i + 1) % 1000:03d}") for i in range(1000)]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id string")
    for rows in (200_000, 100):
        got = {r.id: r for r in graph.graph_facts(nodes, edges(spark, pairs), None, ("component", "depth"), rows).collect()}
        assert got["c00000"].depth == 10_000 and got["c09999"].depth == 1 and got["c05000"].component == "c05000"
        assert {got[f"r{i:03d}"].component for i in range(1000)} == {"r000"} and got["r500"].depth == 1


def test_walks_by_task_and_by_joins(spark):
    rnd = random.Random(5)
    rows = [(f"{g}{rnd.randrange(9)}", f"{g}{rnd.randrange(9)}", g) for g in "abc" for _ in range(14)]
    e = spark.createDataFrame(rows, "src string, dst string, snapshot_id string")
    seeds = spark.createDataFrame([("a", "a", "a0"), ("a", "a", "a1"), ("b", "x", "b3"), ("c", None, "c1")], "snapshot_id string, seed string, node string")
    for depth, way in ((2, "forward"), (None, "reverse"), (1, "both")):
        want = {tuple(r) for r in graph.bfs(e, seeds, depth, way).collect()}
        for most in (1000, 15, 1):
            assert {tuple(r) for r in graph.bfs(e, seeds, depth, way, "snapshot_id", most).collect()} == want


def test_greedy_takes_late_and_free_rows(spark):
    items = spark.range(100_010).selectExpr("'k' AS g", "CAST(id AS int) AS i", "CASE WHEN id = 0 THEN 7 WHEN id = 100005 THEN 2 WHEN id = 100007 THEN 0 WHEN id = 100008 THEN 1 ELSE 4 END AS c")
    assert sorted(r.i for r in relational.greedy(items, ["g"], [items.i], "c", 10).collect()) == [0, 100_005, 100_007, 100_008]
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([0, 1, 2, 3, 5, 8, 40])) for i in range(600)]
    want, used = set(), {}
    for g, i, c in rows:
        if used.get(g, 0) + c <= 37:
            used[g] = used.get(g, 0) + c
            want.add(i)
    df = spark.createDataFrame(rows, "g string, i int, c int")
    assert {r.i for r in relational.greedy(df, ["g"], [df.i], "c", 37).collect()} == want


def test_running_sums_over_ranges(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, 1, 2, 5])) for i in range(500)]
    want, total = {}, {}
    for g, i, c in rows:
        total[g] = total.get(g, 0) + (c or 0)
        want[i] = total[g]
    df = spark.createDataFrame(rows, "g string, _at int, c int")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["_at"]: r.t for r in relational.running_sum(df, ["g"], [F.col("_at")], F.col("c"), "t").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == want
    assert relational.prefix_budget(df.limit(0), ["g"], [F.col("_at")], "c", 5).count() == 0
