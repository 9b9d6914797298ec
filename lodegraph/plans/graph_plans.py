"""Queries of the graph operators on the version graph, each beside its SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions.scalars import steps
from lodegraph.operators import graph as G
from lodegraph.runtime import load, materialize
from lodegraph.sources import graph as S

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _graph(s, d):
    """Nodes and known edges, each read and cleaned once for all that follows."""
    n = materialize(S.nodes(s, d), "nodes")
    return n, materialize(S.known_edges(s, d, n), "edges")


class Shared:
    """What several metrics of one folder need, each made once, when it is first asked for."""

    def __init__(self, s, d):
        self.s, self.d = s, d

    @cached_property
    def graph(self):
        return _graph(self.s, self.d)

    @cached_property
    def edges(self):
        return materialize(S.edges(self.s, self.d), "all-edges")

    @cached_property
    def fans(self):
        return materialize(G.fans(self.graph[0], self.edges), "fans")

    @cached_property
    def facts(self):
        return materialize(G.graph_facts(*self.graph, "snapshot_id", ("component", "weak", "depth", "reach")), "facts")

    @cached_property
    def start(self):
        return self.graph[1], _seeds(self.graph[1])


def _start(s, d):
    e = materialize(S.known_edges(s, d), "edges")
    return e, _seeds(e)


def _seeds(edges):
    """The source of most edges in each snapshot, the smallest id among equals."""
    deg = edges.groupBy("snapshot_id", F.col("src").alias("seed")).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.col("n").desc(), "seed"))
    return deg.withColumn("r", first).where(F.col("r") == 1).select("snapshot_id", "seed")


SEEDS = ", seeds AS (SELECT src AS seed FROM (SELECT snapshot_id, src, count(*) AS c FROM ge GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY c DESC, src) = 1)"


def _bfs_sql(name: str, step: str, depth: int) -> str:
    return f", {name}_all AS (SELECT seed, seed AS node, 0 AS depth FROM seeds UNION SELECT b.seed, s.t, b.depth + 1 FROM {name}_all b JOIN ({step}) s ON s.f = b.node WHERE b.depth < {depth}), {name} AS (SELECT seed, node, min(depth) AS depth FROM {name}_all GROUP BY 1, 2)"


FWD, REV = "SELECT src AS f, dst AS t FROM ge", "SELECT dst AS f, src AS t FROM ge"
BOTH = FWD + " UNION " + REV
REACH = ", reach AS (SELECT src, dst FROM ge UNION SELECT r.src, g.dst FROM reach r JOIN ge g ON g.src = r.dst)"
SCC = REACH + """, comp AS (SELECT n.id, least(n.id, coalesce(min(a.dst), n.id)) AS component FROM n LEFT JOIN reach a ON a.src = n.id AND EXISTS (SELECT 1 FROM reach b WHERE b.src = a.dst AND b.dst = a.src) GROUP BY n.id)"""
FANS = """, fan AS (SELECT n.id, n.snapshot_id, n.file_path, n.node_type, n.namespace, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out FROM n
  LEFT JOIN (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS c FROM e GROUP BY 1) o USING (id))"""


@query("bfs_forward", S.SQL + SEEDS + _bfs_sql("b", FWD, 10) + " SELECT seed, node, depth FROM b")
def bfs_forward(s, d, g=None):
    return G.bfs(*(g or Shared(s, d)).start, 10, by="snapshot_id")


@query("bfs_reverse_depth2", S.SQL + SEEDS + _bfs_sql("b", REV, 2) + " SELECT seed, node, depth FROM b")
def bfs_reverse(s, d):
    return G.bfs(*_start(s, d), 2, "reverse", "snapshot_id")


@query("neighborhood_both_depth3", S.SQL + SEEDS + _bfs_sql("b", BOTH, 3) + " SELECT seed, count(*) AS node_count, max(depth) AS reached FROM b GROUP BY 1")
def neighborhood(s, d):
    return G.bfs(*_start(s, d), 3, "both", "snapshot_id").groupBy("seed").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").alias("reached"))


@query("blast_radius", S.SQL + SEEDS + _bfs_sql("a", FWD, 5) + _bfs_sql("c", REV, 5) + " SELECT seed, node, min(depth) AS depth, CASE WHEN min(depth) <= 1 THEN 'direct' ELSE 'indirect' END AS impact FROM (SELECT * FROM a UNION ALL SELECT * FROM c) GROUP BY 1, 2")
def blast(s, d, g=None):
    return G.blast_radius(*(g or Shared(s, d)).start, 5, "snapshot_id")


@query("reachability_count", S.SQL + REACH + " SELECT n.id, count(DISTINCT r.dst) AS reach FROM n LEFT JOIN reach r ON r.src = n.id GROUP BY 1")
def reach_count(s, d):
    return G.reach_counts(*_graph(s, d), "snapshot_id")


@query("weak_components", S.SQL + ", w AS (SELECT id, id AS m FROM n UNION SELECT w.id, s.t FROM w JOIN (" + BOTH + ") s ON s.f = w.m) SELECT id, min(m) AS component FROM w GROUP BY 1")
def wcc(s, d, g=None):
    return g.facts.select("id", F.col("weak").alias("component")) if g else G.weak_components(*_graph(s, d), "snapshot_id")


@query("strong_components", S.SQL + SCC + " SELECT id, component FROM comp")
def scc(s, d, g=None):
    return g.facts.select("id", "component") if g else G.strong_components(*_graph(s, d), "snapshot_id")


@query("cycle_members", S.SQL + REACH + " SELECT DISTINCT src AS id FROM reach WHERE src = dst")
def cyc(s, d):
    n, e = _graph(s, d)
    c = G.strong_components(n, e, "snapshot_id")
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return c.join(size, "component", "left_semi").select("id").unionByName(e.where(F.col("src") == F.col("dst")).select(F.col("src").alias("id"))).distinct()


@query(
    "topological_levels",
    S.SQL + REACH + """, behind AS (SELECT DISTINCT n.id FROM n WHERE EXISTS (SELECT 1 FROM reach c WHERE c.src = c.dst AND (c.src = n.id OR EXISTS (SELECT 1 FROM reach r WHERE r.src = c.src AND r.dst = n.id)))),
lv AS (SELECT id, 0 AS level FROM n WHERE id NOT IN (SELECT id FROM behind) UNION SELECT g.dst, lv.level + 1 FROM lv JOIN ge g ON g.src = lv.id WHERE g.dst NOT IN (SELECT id FROM behind))
SELECT id, max(level) AS level, false AS cyclic FROM lv GROUP BY 1 UNION ALL SELECT id, NULL, true FROM behind""",
)
def levels(s, d):
    return G.topological_levels(*_graph(s, d), "snapshot_id")


DEPTH = SCC + """, dag AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM ge JOIN comp a ON a.id = ge.src JOIN comp b ON b.id = ge.dst WHERE a.component <> b.component),
down AS (SELECT DISTINCT component AS id, 1 AS depth, component AS top FROM comp UNION SELECT dag.src, down.depth + 1, down.top FROM down JOIN dag ON dag.dst = down.id),
depths AS (SELECT c.id, max(down.depth) AS depth FROM comp c JOIN down ON down.id = c.component GROUP BY 1)"""


@query("node_depth", S.SQL + DEPTH + " SELECT id, depth FROM depths")
def depth(s, d, g=None):
    return g.facts.select("id", "depth") if g else G.node_depths(*_graph(s, d), "snapshot_id")


@query(
    "depth_histogram",
    S.SQL + DEPTH + """ SELECT snapshot_id, CASE WHEN depth = 0 THEN '0' WHEN depth <= 2 THEN '1-2' WHEN depth <= 5 THEN '3-5' WHEN depth <= 10 THEN '6-10' ELSE '>10' END AS bin, count(*) AS node_count, round(avg(depth), 4) AS mean_depth
FROM depths JOIN n USING (id) GROUP BY 1, 2""",
)
def depth_hist(s, d):
    n, e = _graph(s, d)
    b = F.when(F.col("depth") == 0, "0").when(F.col("depth") <= 2, "1-2").when(F.col("depth") <= 5, "3-5").when(F.col("depth") <= 10, "6-10").otherwise(">10")
    return G.node_depths(n, e, "snapshot_id").join(n.select("id", "snapshot_id"), "id").groupBy("snapshot_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("node_count"), F.round(F.avg("depth"), 4).alias("mean_depth"))


@query(
    "layering_violations",
    S.SQL + DEPTH + FANS + """ SELECT ge.id AS edge_id, a.depth AS src_depth, b.depth AS dst_depth FROM ge JOIN depths a ON a.id = ge.src JOIN depths b ON b.id = ge.dst
JOIN fan fa ON fa.id = ge.src JOIN fan fb ON fb.id = ge.dst WHERE a.depth > b.depth AND fb.fan_in < fa.fan_out""",
)
def layering(s, d):
    n, e = _graph(s, d)
    side = G.fans(n, S.edges(s, d)).select("id", "fan_in", "fan_out").join(G.node_depths(n, e, "snapshot_id"), "id")
    a = side.select(F.col("id").alias("src"), F.col("depth").alias("src_depth"), F.col("fan_out").alias("fo"))
    b = side.select(F.col("id").alias("dst"), F.col("depth").alias("dst_depth"), F.col("fan_in").alias("fi"))
    return e.join(a, "src").join(b, "dst").where((F.col("src_depth") > F.col("dst_depth")) & (F.col("fi") < F.col("fo"))).select(F.col("id").alias("edge_id"), "src_depth", "dst_depth")


LEVEL = "CASE WHEN {0} >= 50 THEN 'CRITICAL' WHEN {0} >= 20 THEN 'HIGH' WHEN {0} >= 10 THEN 'MODERATE' ELSE 'LOW' END"


@query(
    "fan_metrics",
    S.SQL + FANS + f""" SELECT id, snapshot_id, fan_in, fan_out, fan_in + fan_out AS total, CASE WHEN fan_in + fan_out > 0 THEN round(fan_in / (fan_in + fan_out), 4) ELSE 0 END AS concentration,
{LEVEL.format('greatest(fan_in, fan_out)')} AS fan_level, fan_out >= 20 AND fan_in < fan_out * 0.2 AS utility_hotspot, fan_in >= 50 AND fan_out >= 50 AS god_module FROM fan""",
)
def fan_metrics(s, d, g=None):
    return (g.fans if g else G.fans(S.nodes(s, d), S.edges(s, d))).select("id", "snapshot_id", "fan_in", "fan_out", "total", "concentration", "fan_level", "utility_hotspot", "god_module")


@query(
    "fan_edge_driven",
    S.SQL + """, ends AS (SELECT dst AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, id NOT IN (SELECT id FROM n) AS unknown FROM ends GROUP BY 1""",
)
def fan_edges(s, d):
    e = S.edges(s, d)
    ends = e.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    got = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return got.join(S.nodes(s, d).select("id", F.lit(False).alias("unknown")), "id", "left").fillna(True, ["unknown"])


@query(
    "fan_kept_top",
    S.SQL + FANS + f""", r AS (SELECT id, snapshot_id, fan_in + fan_out AS total, {LEVEL.format('greatest(fan_in, fan_out)')} AS fan_level, row_number() OVER (PARTITION BY snapshot_id ORDER BY fan_in + fan_out DESC, id) AS rank_no, count(*) OVER (PARTITION BY snapshot_id) AS v FROM fan)
SELECT id, snapshot_id, total, fan_level FROM r WHERE fan_level <> 'LOW' OR rank_no <= greatest(10, ceil(0.3 * v))""",
)
def fan_top(s, d):
    w = W.partitionBy("snapshot_id")
    r = G.fans(S.nodes(s, d), S.edges(s, d)).withColumn("rank_no", F.row_number().over(w.orderBy(F.col("total").desc(), "id"))).withColumn("v", F.count(F.lit(1)).over(w))
    return r.where((F.col("fan_level") != "LOW") | (F.col("rank_no") <= F.greatest(F.lit(10), F.ceil(F.col("v") * 0.3)))).select("id", "snapshot_id", "total", "fan_level")


@query(
    "instability",
    S.SQL + FANS + """, i AS (SELECT id, CASE WHEN fan_in + fan_out > 0 THEN round(fan_out / (fan_in + fan_out), 4) ELSE 0 END AS instability, fan_in, fan_out FROM fan)
SELECT id, instability, CASE WHEN instability > 0.8 THEN 'VOLATILE' WHEN instability > 0.6 THEN 'UNSTABLE' WHEN instability >= 0.3 THEN 'BALANCED' ELSE 'STABLE' END AS instability_class FROM i""",
)
def instab(s, d, g=None):
    return G.instability(g.fans if g else G.fans(S.nodes(s, d), S.edges(s, d))).select("id", "instability", "instability_class")


@query(
    "centrality",
    S.SQL + SCC + FANS + """, rc AS (SELECT src AS id, count(DISTINCT dst) AS reach FROM reach GROUP BY 1), sz AS (SELECT id, count(*) OVER (PARTITION BY component) AS size FROM comp),
raw AS (SELECT f.id, f.snapshot_id, (f.fan_in * 0.7e0 + f.fan_out * 0.3e0) * coalesce(rc.reach, 0) / count(*) OVER (PARTITION BY f.snapshot_id) * CASE WHEN sz.size > 1 THEN 0.85e0 ELSE 1e0 END * CASE WHEN f.fan_out >= 20 AND f.fan_in <= 5 THEN 0.65e0 ELSE 1e0 END AS raw
  FROM fan f LEFT JOIN rc USING (id) LEFT JOIN sz USING (id)), top AS (SELECT *, max(raw) OVER (PARTITION BY snapshot_id) AS m FROM raw)
SELECT id, snapshot_id, CASE WHEN m > 0 THEN round(raw / m, 4) ELSE 0 END AS score FROM top""",
)
def central(s, d, g=None):
    g = g or Shared(s, d)
    facts = g.facts
    size = facts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return G.centrality(g.fans, facts.select("id", "reach"), facts.join(size, "component").select("id", "size"), "snapshot_id")


@query(
    "graph_density",
    S.SQL + """ SELECT snapshot_id, v, coalesce(c, 0) AS edge_count, round(CASE WHEN v > 1 THEN 2 * coalesce(c, 0) / (v * (v - 1)) ELSE 0 END, 6) AS density FROM (SELECT snapshot_id, count(*) AS v FROM n GROUP BY 1) LEFT JOIN (SELECT snapshot_id, count(*) AS c FROM e GROUP BY 1) USING (snapshot_id)""",
)
def dens(s, d, g=None):
    v = (g.graph[0] if g else S.nodes(s, d)).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("v"))
    c = (g.edges if g else S.edges(s, d)).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return v.join(c, "snapshot_id", "left").fillna(0, ["edge_count"]).withColumn("density", F.round(G.density(F.col("v"), F.col("edge_count")), 6))


@query(
    "edge_concentration",
    S.SQL + FANS + """ SELECT snapshot_id, round(sum(pow((fan_in + fan_out) / (2 * ec), 2)), 6) AS herfindahl FROM fan JOIN (SELECT snapshot_id, count(*) AS ec FROM e GROUP BY 1) USING (snapshot_id) GROUP BY 1""",
)
def herf(s, d):
    c = S.edges(s, d).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("ec"))
    f = G.fans(S.nodes(s, d), S.edges(s, d)).join(c, "snapshot_id")
    return f.groupBy("snapshot_id").agg(F.round(F.sum(F.pow(F.col("total") / (F.col("ec") * 2), 2)), 6).alias("herfindahl"))


@query(
    "fan_in_entropy",
    S.SQL + FANS + """, p AS (SELECT snapshot_id, fan_in / nullif(sum(fan_in) OVER (PARTITION BY snapshot_id), 0) AS p FROM fan)
SELECT snapshot_id, CASE WHEN count(*) > 1 THEN round(coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) END), 0) / log2(count(*)), 4) ELSE 0 END AS entropy FROM p GROUP BY 1""",
)
def ent(s, d):
    return G.entropy(G.fans(S.nodes(s, d), S.edges(s, d)), "snapshot_id", "fan_in")


@query(
    "propagation_risk",
    S.SQL + SCC + FANS + """, sz AS (SELECT id, count(*) OVER (PARTITION BY component) AS size FROM comp), g AS (SELECT snapshot_id, count(*) AS v, avg(fan_in + fan_out) AS mean FROM fan GROUP BY 1),
gc AS (SELECT snapshot_id, count(*) AS ec FROM e GROUP BY 1), x AS (SELECT f.*, g.v, g.mean, coalesce(gc.ec, 0) AS ec, sz.size, CASE WHEN g.v > 1 THEN 2 * coalesce(gc.ec, 0) / (g.v * (g.v - 1)) ELSE 0 END AS dens FROM fan f JOIN g USING (snapshot_id) LEFT JOIN gc USING (snapshot_id) JOIN sz USING (id))
SELECT id, round(least(1, (fan_in / v + fan_out / v + CASE WHEN mean > 0 THEN least(1, fan_in + fan_out / mean) ELSE 0 END + dens + CASE WHEN size > 1 THEN least(1, size / 10) ELSE 0 END) / greatest(1, log2(v + ec))), 4) AS pressure,
round(least(1, dens * fan_out / v), 4) AS amplification, fan_in >= 10 AND fan_out >= 10 AS choke_point FROM x""",
)
def risk(s, d, g=None):
    g = g or Shared(s, d)
    e, comp = g.edges, g.facts.select("id", "component")
    comp = comp.join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("id", "size")
    ec = e.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("ec"))
    f = g.fans
    x = f.join(f.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("v"), F.avg("total").alias("mean")), "snapshot_id").join(comp, "id").join(ec, "snapshot_id", "left").fillna(0, ["ec"])
    dens = G.density(F.col("v"), F.col("ec"))
    depth = F.when(F.col("mean") > 0, F.least(F.lit(1.0), F.col("fan_in") + F.col("fan_out") / F.col("mean"))).otherwise(0.0)
    cyc = F.when(F.col("size") > 1, F.least(F.lit(1.0), F.col("size") / 10)).otherwise(0.0)
    press = (F.col("fan_in") / F.col("v") + F.col("fan_out") / F.col("v") + depth + dens + cyc) / F.greatest(F.lit(1.0), F.log2(F.col("v") + F.col("ec")))
    return x.select("id", F.round(F.least(F.lit(1.0), press), 4).alias("pressure"), F.round(F.least(F.lit(1.0), dens * F.col("fan_out") / F.col("v")), 4).alias("amplification"), ((F.col("fan_in") >= 10) & (F.col("fan_out") >= 10)).alias("choke_point"))


@query("cascade_depth3")
def casc(s, d):
    e, seeds = _start(s, d)
    return G.cascade(e, seeds.select("seed"), 3)


@query(
    "complexity",
    S.SQL + DEPTH + FANS + ", w AS (SELECT id, id AS m FROM n UNION SELECT w.id, s.t FROM w JOIN (" + BOTH + """) s ON s.f = w.m), wc AS (SELECT id, min(m) AS c FROM w GROUP BY 1),
big AS (SELECT snapshot_id, max(k) AS largest FROM (SELECT snapshot_id, c, count(*) AS k FROM wc JOIN n USING (id) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT snapshot_id, fan_in / nullif(sum(fan_in) OVER (PARTITION BY snapshot_id), 0) AS p FROM fan),
ent AS (SELECT snapshot_id, CASE WHEN count(*) > 1 THEN coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) END), 0) / log2(count(*)) ELSE 0 END AS h FROM p GROUP BY 1),
dp AS (SELECT snapshot_id, count(*) AS v, avg(depth) / max(depth) AS ds FROM depths JOIN n USING (id) GROUP BY 1),
cy AS (SELECT snapshot_id, count(*) AS cyc FROM (SELECT id, count(*) OVER (PARTITION BY component) AS k FROM comp) JOIN n USING (id) WHERE k > 1 GROUP BY 1),
ec AS (SELECT snapshot_id, count(*) AS ec FROM ge GROUP BY 1),
f AS (SELECT dp.snapshot_id, least(1, coalesce(ec, 0) / v / 5) AS a, round(h, 4) AS b, 1 - largest / v AS c, coalesce(cyc, 0) / v AS y, ds FROM dp JOIN big USING (snapshot_id) JOIN ent USING (snapshot_id) LEFT JOIN cy USING (snapshot_id) LEFT JOIN ec USING (snapshot_id))
SELECT snapshot_id, round(a, 4) AS density_score, b AS entropy_score, round(c, 4) AS fragmentation, round(y, 4) AS cycle_score, round(ds, 4) AS depth_score, round((a + b + c + y + ds) * 0.2e0, 4) AS final_score,
CASE WHEN (a + b + c + y + ds) * 0.2e0 > 0.75 THEN 'HIGHLY_COMPLEX' WHEN (a + b + c + y + ds) * 0.2e0 > 0.5 THEN 'COMPLEX' WHEN (a + b + c + y + ds) * 0.2e0 > 0.25 THEN 'MODERATE' ELSE 'SIMPLE' END AS complexity_level FROM f""",
)
def complexity(s, d, g=None):
    g = g or Shared(s, d)
    n, e = g.graph
    facts = materialize(g.facts.join(n.select("id", "snapshot_id"), "id"), "placed")
    ds = facts.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("v"), (F.avg("depth") / F.max("depth")).alias("ds"))
    big = facts.groupBy("snapshot_id", "weak").agg(F.count(F.lit(1)).alias("k")).groupBy("snapshot_id").agg(F.max("k").alias("largest"))
    cyc = facts.groupBy("snapshot_id", "component").agg(F.count(F.lit(1)).alias("k")).where("k > 1").groupBy("snapshot_id").agg(F.sum("k").alias("cyc"))
    ec = e.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("ec"))
    ent = G.entropy(g.fans, "snapshot_id", "fan_in")
    x = ds.join(big, "snapshot_id").join(ent, "snapshot_id").join(cyc, "snapshot_id", "left").join(ec, "snapshot_id", "left").fillna(0, ["cyc", "ec"])
    a, c, y = F.least(F.lit(1.0), F.col("ec") / F.col("v") / 5), 1 - F.col("largest") / F.col("v"), F.col("cyc") / F.col("v")
    total = (a + F.col("entropy") + c + y + F.col("ds")) * 0.2
    level = F.when(total > 0.75, "HIGHLY_COMPLEX").when(total > 0.5, "COMPLEX").when(total > 0.25, "MODERATE").otherwise("SIMPLE")
    return x.select("snapshot_id", F.round(a, 4).alias("density_score"), F.col("entropy").alias("entropy_score"), F.round(c, 4).alias("fragmentation"), F.round(y, 4).alias("cycle_score"), F.round("ds", 4).alias("depth_score"), F.round(total, 4).alias("final_score"), level.alias("complexity_level"))


@query("traversal_pressure", S.SQL + FANS + ", p AS (SELECT id, least(1, (fan_in + fan_out) / 20) AS own FROM fan) SELECT p.id, round(p.own + 0.5 * coalesce(sum(q.own), 0), 4) AS pressure FROM p LEFT JOIN ge ON ge.src = p.id LEFT JOIN p q ON q.id = ge.dst GROUP BY p.id, p.own")
def pressure(s, d):
    p = G.fans(S.nodes(s, d), S.edges(s, d)).select("id", F.least(F.lit(1.0), F.col("total") / 20).alias("own"))
    near = S.known_edges(s, d).join(p.select(F.col("id").alias("dst"), F.col("own").alias("o")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("o").alias("s"))
    return p.join(near, "id", "left").select("id", F.round(F.col("own") + F.coalesce("s", F.lit(0.0)) * 0.5, 4).alias("pressure"))


@query("choke_points_top25", S.SQL + FANS + " SELECT id, fan_in + fan_out AS degree FROM fan WHERE fan_in + fan_out >= 5 ORDER BY degree DESC, id LIMIT 25")
def choke(s, d):
    return G.fans(S.nodes(s, d), S.edges(s, d)).where("total >= 5").orderBy(F.col("total").desc(), "id").limit(25).select("id", F.col("total").alias("degree"))


@query(
    "architectural_regions",
    S.SQL + ", w AS (SELECT id, id AS m FROM n UNION SELECT w.id, s.t FROM w JOIN (" + BOTH + """) s ON s.f = w.m), wc AS (SELECT id, min(m) AS region FROM w GROUP BY 1),
k AS (SELECT region, count(*) AS v FROM wc GROUP BY 1), c AS (SELECT wc.region, count(*) AS ec FROM ge JOIN wc ON wc.id = ge.src GROUP BY 1),
r AS (SELECT region, v AS node_count, coalesce(ec, 0) AS edge_count, CASE WHEN v > 1 THEN 2 * coalesce(ec, 0) / (v * (v - 1)) ELSE 0 END AS x FROM k LEFT JOIN c USING (region))
SELECT region, node_count, edge_count, round(x, 4) AS density, CASE WHEN x < 0.1 THEN 'isolated' WHEN x < 0.3 THEN 'weak' ELSE 'well-connected' END AS kind FROM r""",
)
def regions(s, d):
    n, e = _graph(s, d)
    wc = G.weak_components(n, e, "snapshot_id").withColumnRenamed("component", "region")
    c = e.join(wc.withColumnRenamed("id", "src"), "src").groupBy("region").agg(F.count(F.lit(1)).alias("edge_count"))
    x = G.density(F.col("node_count"), F.col("edge_count"))
    return wc.groupBy("region").agg(F.count(F.lit(1)).alias("node_count")).join(c, "region", "left").fillna(0, ["edge_count"]).select("region", "node_count", "edge_count", F.round(x, 4).alias("density"), steps(x, (0.3, "well-connected"), (0.1, "weak"), other="isolated").alias("kind"))


@query(
    "change_impact",
    S.SQL + r""", s AS (SELECT DISTINCT id, project_id, version_no FROM snapshots WHERE status IN ('ACTIVE', 'DEGRADED')), pairs AS (SELECT id AS snapshot_id, lag(id) OVER (PARTITION BY project_id ORDER BY version_no, id) AS base_id FROM s),
chg AS (SELECT a.snapshot_id, a.id FROM n a JOIN pairs p USING (snapshot_id) LEFT JOIN n b ON b.snapshot_id = p.base_id AND b.file_path = a.file_path AND b.node_type = 'FILE' WHERE a.node_type = 'FILE' AND p.base_id IS NOT NULL AND (b.id IS NULL OR b.file_hash IS DISTINCT FROM a.file_hash)),
hit AS (SELECT snapshot_id, id FROM chg UNION SELECT hit.snapshot_id, ge.src FROM hit JOIN ge ON ge.dst = hit.id)
SELECT c.snapshot_id, c.changed, h.affected, CASE WHEN h.affected > 0.5 * t.v THEN 'full' ELSE 'partial' END AS scope FROM (SELECT snapshot_id, count(DISTINCT id) AS changed FROM chg GROUP BY 1) c JOIN (SELECT snapshot_id, count(*) AS affected FROM hit GROUP BY 1) h USING (snapshot_id) JOIN (SELECT snapshot_id, count(*) AS v FROM n GROUP BY 1) t USING (snapshot_id)""",
)
def impact(s, d):
    from lodegraph.operators.snapshot_diff import consecutive

    n, e = _graph(s, d)
    files = n.where("node_type = 'FILE'")
    pairs = consecutive(load(s, d, "snapshots")).where("base_id IS NOT NULL").select("snapshot_id", "base_id")
    old = files.select(F.col("snapshot_id").alias("base_id"), "file_path", F.col("file_hash").alias("h"), F.lit(1).alias("had"))
    changed = files.join(pairs, "snapshot_id").join(old, ["base_id", "file_path"], "left").where(F.col("had").isNull() | ~F.col("h").eqNullSafe(F.col("file_hash"))).select("snapshot_id", "id").distinct()
    changed = materialize(changed, "changed")
    starts = changed.select("snapshot_id", F.col("snapshot_id").alias("seed"), F.col("id").alias("node"))  # one walk a snapshot, from all its changes
    hit = G.bfs(e, starts, None, "reverse", "snapshot_id").select(F.col("seed").alias("snapshot_id"), "node")
    v = n.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("v"))
    x = changed.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("changed")).join(hit.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("affected")), "snapshot_id").join(v, "snapshot_id")
    return x.select("snapshot_id", "changed", "affected", F.when(F.col("affected") > F.col("v") * 0.5, "full").otherwise("partial").alias("scope"))
