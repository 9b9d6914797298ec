"""Queries on metric records, detectors, rules, validation of structure and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import layers as L
from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G
from lodegraph.operators import rules as U
from lodegraph.plans import graph_plans as P
from lodegraph.plans import table_plans as T
from lodegraph.plans.graph_plans import ORACLE as GSQL
from lodegraph.plans.table_plans import ISSUES, LAYER
from lodegraph.runtime import load, materialize, union_all
from lodegraph.sources import graph as S

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


N = S.nodes


def q(name: str) -> str:
    """Another query's SQL as a table."""
    return f"({GSQL.get(name) or T.ORACLE[name]})"


# metric records -----------------------------------------------------------------------------------------------------
RECORDS = f"""nn AS MATERIALIZED ({S.SQL} SELECT * FROM n), place AS (SELECT id, snapshot_id, file_path FROM nn), cen AS MATERIALIZED {q('centrality')}, fm AS MATERIALIZED {q('fan_metrics')}, ins AS {q('instability')}, pr AS MATERIALIZED {q('propagation_risk')}, nd AS MATERIALIZED {q('node_depth')}, gd AS {q('graph_density')}, cx AS {q('complexity')},
rec AS (SELECT snapshot_id, id AS ref, 'CENTRALITY' AS metric_type, 'NODE' AS metric_scope, CAST(score AS DOUBLE) AS metric_value FROM cen WHERE score > 0
UNION ALL SELECT snapshot_id, id, 'FAN_IN', 'NODE', fan_in FROM fm WHERE fan_in > 0 UNION ALL SELECT snapshot_id, id, 'FAN_OUT', 'NODE', fan_out FROM fm WHERE fan_out > 0
UNION ALL SELECT snapshot_id, id, 'INSTABILITY', 'NODE', instability FROM ins JOIN place USING (id) WHERE instability > 0
UNION ALL SELECT snapshot_id, id, 'PROPAGATION_RISK', 'NODE', pressure FROM pr JOIN place USING (id) WHERE pressure > 0
UNION ALL SELECT snapshot_id, id, 'CHOKE_POINT', 'NODE', 1 FROM pr JOIN place USING (id) WHERE choke_point
UNION ALL SELECT snapshot_id, id, 'DEPTH', 'NODE', depth FROM nd JOIN place USING (id)
UNION ALL SELECT snapshot_id, snapshot_id, 'MAX_DEPTH', 'GLOBAL', max(depth) FROM nd JOIN place USING (id) GROUP BY 1
UNION ALL SELECT snapshot_id, snapshot_id, 'COUPLING_DENSITY', 'GLOBAL', density FROM gd WHERE density > 0
UNION ALL SELECT snapshot_id, snapshot_id, 'COMPLEXITY', 'GLOBAL', final_score FROM cx WHERE final_score > 0
UNION ALL SELECT snapshot_id, id, 'INFRASTRUCTURE', 'NODE', 1 FROM (SELECT snapshot_id, id, {LAYER} AS layer FROM place) WHERE layer = 'INFRASTRUCTURE')"""


def records(s, d):
    """(snapshot_id, ref, metric_type, metric_scope, metric_value): the metrics of nodes and snapshots in one long table, zeros left out."""
    g = P.Shared(s, d)
    place = g.graph[0].select("id", "snapshot_id", "file_path")
    near = place.select("id", "snapshot_id")
    depth = P.depth(s, d, g).join(near, "id")
    risk = materialize(P.risk(s, d, g).join(near, "id"), "risk")
    fan = P.fan_metrics(s, d, g)

    def rows(df, ref, kind, scope, value):
        return df.select("snapshot_id", F.col(ref).alias("ref"), F.lit(kind).alias("metric_type"), F.lit(scope).alias("metric_scope"), F.col(value).cast("double").alias("metric_value")).where("metric_value > 0")

    return union_all([
        rows(P.central(s, d, g), "id", "CENTRALITY", "NODE", "score"),
        rows(fan, "id", "FAN_IN", "NODE", "fan_in"),
        rows(fan, "id", "FAN_OUT", "NODE", "fan_out"),
        rows(P.instab(s, d, g).join(near, "id"), "id", "INSTABILITY", "NODE", "instability"),
        rows(risk, "id", "PROPAGATION_RISK", "NODE", "pressure"),
        rows(risk.withColumn("one", F.col("choke_point").cast("int")), "id", "CHOKE_POINT", "NODE", "one"),
        rows(depth, "id", "DEPTH", "NODE", "depth"),
        rows(depth.groupBy("snapshot_id").agg(F.max("depth").alias("m")), "snapshot_id", "MAX_DEPTH", "GLOBAL", "m"),
        rows(P.dens(s, d, g), "snapshot_id", "COUPLING_DENSITY", "GLOBAL", "density"),
        rows(P.complexity(s, d, g), "snapshot_id", "COMPLEXITY", "GLOBAL", "final_score"),
        rows(place.where(L.layer(F.col("file_path")) == "INFRASTRUCTURE").withColumn("one", F.lit(1)), "id", "INFRASTRUCTURE", "NODE", "one"),
    ])


@query("metric_records", f"WITH {RECORDS} SELECT * FROM rec")
def metric_records(s, d):
    return records(s, d)


@query("metrics_by_node", f"WITH {RECORDS} SELECT ref AS id, " + ", ".join(f"max(metric_value) FILTER (metric_type = '{m}') AS {m.lower()}" for m in ("CENTRALITY", "FAN_IN", "FAN_OUT", "INSTABILITY", "PROPAGATION_RISK", "DEPTH")) + " FROM rec WHERE metric_scope = 'NODE' AND metric_type IN ('CENTRALITY', 'FAN_IN', 'FAN_OUT', 'INSTABILITY', 'PROPAGATION_RISK', 'DEPTH') GROUP BY 1")
def by_node(s, d):
    kinds = ["CENTRALITY", "FAN_IN", "FAN_OUT", "INSTABILITY", "PROPAGATION_RISK", "DEPTH"]
    r = records(s, d).where(F.col("metric_type").isin(kinds))
    return r.groupBy(F.col("ref").alias("id")).pivot("metric_type", kinds).agg(F.max("metric_value")).select("id", *[F.col(k).alias(k.lower()) for k in kinds])


@query("metric_order", f"WITH {RECORDS} SELECT snapshot_id, metric_type, ref, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY metric_type, metric_scope, ref) AS INTEGER) AS place_no FROM rec WHERE metric_type IN ('COMPLEXITY', 'COUPLING_DENSITY', 'MAX_DEPTH', 'INSTABILITY')")
def metric_order(s, d):
    r = records(s, d).where(F.col("metric_type").isin("COMPLEXITY", "COUPLING_DENSITY", "MAX_DEPTH", "INSTABILITY"))
    return r.select("snapshot_id", "metric_type", "ref", F.row_number().over(W.partitionBy("snapshot_id").orderBy("metric_type", "metric_scope", "ref")).alias("place_no"))


RULES_SQL = ", ".join(f"('{i}', {n}, '{m}', '{o}', {v}e0)" for i, c, *_ in U.BUILT_IN for n, (m, o, v) in enumerate(c))


@query("builtin_rule_findings", f"""WITH {RECORDS}, ru(rule_id, condition_no, metric_type, operator, value) AS (VALUES {RULES_SQL}),
hit AS (SELECT rule_id, condition_no, snapshot_id, ref FROM rec JOIN ru USING (metric_type) WHERE CASE operator WHEN 'GT' THEN metric_value > value ELSE metric_value >= value END)
SELECT rule_id, snapshot_id, ref FROM (SELECT rule_id, snapshot_id, ref, count(DISTINCT condition_no) AS met FROM hit GROUP BY 1, 2, 3) JOIN (SELECT rule_id, count(*) AS need FROM ru GROUP BY 1) USING (rule_id) WHERE met = need""")
def builtin(s, d):
    return U.evaluate(records(s, d), U.rule_rows(s)).select("rule_id", "snapshot_id", "ref")


# the other detectors ------------------------------------------------------------------------------------------------
@query("insight_cycles", f"WITH c AS {q('strong_components')}, k AS (SELECT component, count(*) AS node_count FROM c GROUP BY 1 HAVING count(*) > 1) SELECT component, node_count, CASE WHEN node_count > 3 THEN 'HIGH' ELSE 'MODERATE' END AS severity FROM k")
def cycles(s, d):
    k = P.scc(s, d).groupBy("component").agg(F.count(F.lit(1)).alias("node_count")).where("node_count > 1")
    return k.withColumn("severity", F.when(F.col("node_count") > 3, "HIGH").otherwise("MODERATE"))


@query("insight_depth", f"WITH x AS {q('node_depth')}, n AS ({S.SQL} SELECT id, snapshot_id FROM n), k AS (SELECT snapshot_id, max(depth) AS max_depth, avg(depth) AS mean FROM x JOIN n USING (id) GROUP BY 1) SELECT snapshot_id, max_depth, round(mean, 2) AS mean_depth, CASE WHEN max_depth > 15 THEN 'CRITICAL' WHEN max_depth > 10 THEN 'HIGH' WHEN max_depth > 5 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM k")
def deep(s, d):
    k = P.depth(s, d).join(N(s, d).select("id", "snapshot_id"), "id").groupBy("snapshot_id").agg(F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 2).alias("mean_depth"))
    m = F.col("max_depth")
    return k.withColumn("severity", F.when(m > 15, "CRITICAL").when(m > 10, "HIGH").when(m > 5, "MODERATE").otherwise("LOW"))


@query("insight_propagation", f"SELECT id, pressure, choke_point, CASE WHEN pressure >= 0.7 AND choke_point THEN 'CRITICAL' WHEN pressure >= 0.5 THEN 'HIGH' WHEN pressure >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM {q('propagation_risk')} WHERE choke_point OR pressure >= 0.3")
def propagation(s, d):
    p = F.col("pressure")
    sev = F.when((p >= 0.7) & F.col("choke_point"), "CRITICAL").when(p >= 0.5, "HIGH").when(p >= 0.2, "MODERATE").otherwise("LOW")
    return P.risk(s, d).where(F.col("choke_point") | (p >= 0.3)).select("id", "pressure", "choke_point", sev.alias("severity"))


@query("insight_coupling", f"SELECT snapshot_id, density, CASE WHEN density >= 0.6 THEN 'HIGH' WHEN density >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM {q('graph_density')} WHERE density > 0.05")
def coupling(s, d):
    return P.dens(s, d).where("density > 0.05").select("snapshot_id", "density", X.steps(F.col("density"), (0.6, "HIGH"), (0.3, "MODERATE"), other="LOW").alias("severity"))


@query("insight_complexity", f"SELECT snapshot_id, final_score, complexity_level, CASE WHEN final_score >= 0.8 THEN 'CRITICAL' WHEN final_score >= 0.5 THEN 'HIGH' ELSE 'MODERATE' END AS severity FROM {q('complexity')} WHERE final_score >= 0.2")
def complex_(s, d):
    return P.complexity(s, d).where("final_score >= 0.2").select("snapshot_id", "final_score", "complexity_level", X.steps(F.col("final_score"), (0.8, "CRITICAL"), (0.5, "HIGH"), other="MODERATE").alias("severity"))


@query("insight_fragmentation", f"WITH c AS {q('complexity')}, k AS (SELECT snapshot_id, count(DISTINCT component) AS parts FROM {q('weak_components')} JOIN ({S.SQL} SELECT id, snapshot_id FROM n) USING (id) GROUP BY 1) SELECT snapshot_id, fragmentation, parts, CASE WHEN fragmentation >= 0.7 AND parts > 10 THEN 'CRITICAL' WHEN fragmentation >= 0.5 THEN 'HIGH' WHEN fragmentation >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM c JOIN k USING (snapshot_id)")
def fragmentation(s, d):
    g = P.Shared(s, d)
    n = g.graph[0]
    k = P.wcc(s, d, g).join(n.select("id", "snapshot_id"), "id").groupBy("snapshot_id").agg(F.count_distinct("component").alias("parts"))
    f = F.col("fragmentation")
    sev = F.when((f >= 0.7) & (F.col("parts") > 10), "CRITICAL").when(f >= 0.5, "HIGH").when(f >= 0.2, "MODERATE").otherwise("LOW")
    return P.complexity(s, d, g).join(k, "snapshot_id").select("snapshot_id", "fragmentation", "parts", sev.alias("severity"))


@query("stability_analysis", f"WITH x AS {q('instability')} SELECT snapshot_id, count(*) FILTER (instability > 0.7) AS unstable, count(*) FILTER (instability < 0.3) AS stable, round(avg(instability) + 1e-9, 4) AS mean_instability FROM x JOIN ({S.SQL} SELECT id, snapshot_id FROM n) USING (id) GROUP BY 1")
def stability(s, d):
    i = F.col("instability")
    return P.instab(s, d).join(N(s, d).select("id", "snapshot_id"), "id").groupBy("snapshot_id").agg(F.count_if(i > 0.7).alias("unstable"), F.count_if(i < 0.3).alias("stable"), F.round(F.avg(i) + 1e-9, 4).alias("mean_instability"))


@query("growth_inference", f"SELECT snapshot_id, round(edge_count / v, 4) AS edge_ratio, CASE WHEN edge_count / v > 2 THEN 'dense growth' ELSE 'normal growth' END AS inference FROM {q('graph_density')} WHERE v > 0")
def growth(s, d):
    r = F.col("edge_count") / F.col("v")
    return P.dens(s, d).where("v > 0").select("snapshot_id", F.round(r, 4).alias("edge_ratio"), F.when(r > 2, "dense growth").otherwise("normal growth").alias("inference"))


@query("impact_narrative", f"""WITH f AS {q('fan_metrics')}, i AS {q('instability')} SELECT id, 'Node ' || id || ' has ' || fan_in || ' dependents and ' || fan_out || ' dependencies; it is ' || lower(instability_class) || '.' AS text FROM f JOIN i USING (id) WHERE fan_in >= 5""")
def narrative(s, d):
    f = P.fan_metrics(s, d).join(P.instab(s, d).select("id", "instability_class"), "id").where("fan_in >= 5")
    return f.select("id", X.render(F.lit("Node {id} has {i} dependents and {o} dependencies; it is {k}."), {"id": F.col("id"), "i": F.col("fan_in"), "o": F.col("fan_out"), "k": F.lower("instability_class")}).alias("text"))


@query("reasoning_chains", "WITH l AS (SELECT DISTINCT id, insight_id, metric_type FROM evidence_links WHERE insight_id IS NOT NULL) SELECT insight_id, count(*) AS evidence, round(least(1, count(DISTINCT metric_type) / 5), 4) AS confidence FROM l GROUP BY 1")
def reasoning(s, d):
    l = load(s, d, "evidence_links").where("insight_id IS NOT NULL").select("id", "insight_id", "metric_type").distinct()
    return l.groupBy("insight_id").agg(F.count(F.lit(1)).alias("evidence"), F.round(F.least(F.lit(1.0), F.count_distinct("metric_type") / 5), 4).alias("confidence"))


# validation of structure --------------------------------------------------------------------------------------------
@query("duplicate_nodes", "SELECT id, count(*) AS deliveries, count(DISTINCT file_path) AS paths FROM nodes GROUP BY 1 HAVING count(*) > 1")
def dup_nodes(s, d):
    return load(s, d, "nodes").groupBy("id").agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct("file_path").alias("paths")).where("deliveries > 1")


@query("missing_classification", S.SQL + f", l AS (SELECT id, snapshot_id, {LAYER} AS layer FROM n WHERE node_type = 'FILE') SELECT id, snapshot_id FROM l WHERE layer = 'UNKNOWN'")
def unclassified(s, d):
    return N(s, d).where("node_type = 'FILE'").where(L.layer(F.col("file_path")) == "UNKNOWN").select("id", "snapshot_id")


@query("loose_clusters", f"WITH c AS {q('domain_clusters')} SELECT n.id, n.namespace, cohesion FROM c JOIN ({S.SQL} SELECT id, snapshot_id, namespace FROM n) n USING (snapshot_id, namespace) WHERE cohesion < 0.3")
def loose(s, d):
    c = T.clusters(s, d).where("cohesion < 0.3").select("snapshot_id", "namespace", "cohesion")
    return N(s, d).select("id", "snapshot_id", "namespace").join(c, ["snapshot_id", "namespace"]).select("id", "namespace", "cohesion")


@query("reexport_cycles", f"WITH c AS {q('strong_components')} SELECT id, 'REEXPORT_CYCLE' AS code FROM c WHERE component IN (SELECT component FROM c GROUP BY 1 HAVING count(*) > 1)")
def reexports(s, d):
    c = materialize(P.scc(s, d), "components")
    return c.join(c.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("id", F.lit("REEXPORT_CYCLE").alias("code"))


@query("broken_aliases", S.SQL + " SELECT id, src, 'BROKEN_ALIAS_TARGET' AS code FROM e WHERE edge_type = 'ALIAS' AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.dst)")
def aliases(s, d):
    e = S.edges(s, d).where("edge_type = 'ALIAS'")
    return e.join(N(s, d).select(F.col("id").alias("dst")), "dst", "left_anti").select("id", "src", F.lit("BROKEN_ALIAS_TARGET").alias("code"))


def eccentric(nodes, edges, limit: int):
    """(id, reached): nodes whose furthest node by the shortest way is more than ``limit`` edges away.

    Only nodes that reach more than ``limit`` nodes at all can be; just those are walked from.
    """
    far = G.reach_counts(nodes, edges, "snapshot_id").where(F.col("reach") > limit).join(nodes.select("id", "snapshot_id"), "id")
    walked = G.bfs(edges, far.select("snapshot_id", F.col("id").alias("seed")), None, "forward", "snapshot_id")
    return walked.groupBy(F.col("seed").alias("id")).agg(F.max("depth").alias("reached")).where(F.col("reached") > limit)


@query("excessive_depth")
def excessive(s, d):
    return eccentric(*P._graph(s, d), 50)


@query("wide_blast", f"WITH b AS {q('blast_radius')}, k AS (SELECT seed, count(*) AS affected FROM b GROUP BY 1) SELECT k.seed, affected, round(affected / v, 4) AS share FROM k JOIN ({S.SQL} SELECT id, count(*) OVER (PARTITION BY snapshot_id) AS v FROM n) n ON n.id = k.seed WHERE affected / v > 0.05")
def wide(s, d):
    k = P.blast(s, d).groupBy("seed").agg(F.count(F.lit(1)).alias("affected"))
    n = N(s, d).select(F.col("id").alias("seed"), "snapshot_id")
    v = n.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("v"))
    share = F.col("affected") / F.col("v")
    return k.join(n, "seed").join(v, "snapshot_id").where(share > 0.05).select("seed", "affected", F.round(share, 4).alias("share"))


@query("traversal_coverage", f"WITH w AS MATERIALIZED {q('weak_components')}, sd AS ({S.SQL}{P.SEEDS} SELECT seed AS id FROM seeds), p AS ({S.SQL} SELECT id, snapshot_id, count(*) OVER (PARTITION BY snapshot_id) AS v FROM n), k AS (SELECT component, count(*) AS reached FROM w GROUP BY 1) SELECT snapshot_id, reached, v, round(reached / v, 4) AS coverage FROM sd JOIN w USING (id) JOIN k USING (component) JOIN p USING (id)")
def coverage(s, d):
    e, seeds = P._start(s, d)
    n = N(s, d)
    v = n.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("v"))
    b = G.bfs(e, seeds, None, "both", "snapshot_id").groupBy("seed").agg(F.count(F.lit(1)).alias("reached"))
    return b.join(seeds, "seed").join(v, "snapshot_id").select("snapshot_id", "reached", "v", F.round(F.col("reached") / F.col("v"), 4).alias("coverage"))


KINDS = "k AS (SELECT snapshot_id, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'ERROR') AS x, count(*) FILTER (severity = 'WARNING') AS w FROM issues GROUP BY 1)"


@query("alternate_score", ISSUES + f", {KINDS} SELECT snapshot_id, round(CAST(greatest(0, least(1, 1 - 0.25 * c - 0.1 * x - 0.02 * w)) AS DOUBLE), 4) AS integrity, round(CAST(greatest(0, least(1, 1 - 0.3 * c - 0.1 * x - 0.02 * w)) AS DOUBLE), 4) AS readiness FROM k")
def alternate(s, d):
    k = T.issues(s, d).groupBy("snapshot_id").agg(*[F.count_if(F.col("severity") == v).alias(a) for v, a in (("CRITICAL", "c"), ("ERROR", "x"), ("WARNING", "w"))])
    score = lambda p: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("c") * p - F.col("x") * 0.1 - F.col("w") * 0.02)), 4)
    return k.select("snapshot_id", score(0.25).alias("integrity"), score(0.3).alias("readiness"))


@query("readiness_checks", ISSUES + f", {KINDS}, v AS (SELECT snapshot_id, count(*) AS v FROM n GROUP BY 1) SELECT snapshot_id, v > 0 AS graph_exists, v >= 3 AS retrieval_ready, coalesce(c, 0) = 0 AS no_critical, coalesce(x, 0) = 0 AS no_error FROM v LEFT JOIN k USING (snapshot_id)")
def checks(s, d):
    k = T.issues(s, d).groupBy("snapshot_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("c"), F.count_if(F.col("severity") == "ERROR").alias("x"))
    v = N(s, d).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("v"))
    return v.join(k, "snapshot_id", "left").fillna(0, ["c", "x"]).select("snapshot_id", (F.col("v") > 0).alias("graph_exists"), (F.col("v") >= 3).alias("retrieval_ready"), (F.col("c") == 0).alias("no_critical"), (F.col("x") == 0).alias("no_error"))


#: Hints by issue code.
HINTS = {"NODE_REF_MISSING_SOURCE": ("graph", "rebuild the edges of the source file"), "NODE_REF_MISSING_TARGET": ("graph", "rebuild the edges of the target file"), "EDGE_SELF_REFERENCE": ("graph", "drop the edge"), "EDGE_DUPLICATE": ("graph", "keep one edge"), "ORPHAN_NODE": ("graph", "check the file is parsed"), "BROKEN_DEP_TARGET": ("dependency", "resolve the import again"), "METRIC_RANGE": ("metrics", "compute the weight again")}


@query("remediation", ISSUES + ", h(code, category, hint) AS (VALUES " + ", ".join(f"('{c}', '{a}', '{b}')" for c, (a, b) in HINTS.items()) + ") SELECT snapshot_id, category, hint, count(*) AS c FROM issues JOIN h USING (code) GROUP BY 1, 2, 3")
def remediation(s, d):
    h = F.broadcast(s.createDataFrame([(c, a, b) for c, (a, b) in HINTS.items()], "code string, category string, hint string"))
    return T.issues(s, d).join(h, "code").groupBy("snapshot_id", "category", "hint").agg(F.count(F.lit(1)).alias("c"))
