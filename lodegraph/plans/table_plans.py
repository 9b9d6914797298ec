"""Queries over nodes, edges, snapshots and side tables: joins, aggregates, diffs, validation, retrieval, memory, rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import layers as L
from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G
from lodegraph.operators import relational as R
from lodegraph.operators.snapshot_diff import consecutive
from lodegraph.runtime import load, union_all
from lodegraph.sources import graph as S

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


N, E = S.nodes, S.edges
FAN = """, fan AS (SELECT n.id, n.snapshot_id, n.file_path, n.node_type, n.namespace, n.language, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out FROM n
  LEFT JOIN (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS c FROM e GROUP BY 1) o USING (id))"""
ENTRIES = "WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY entry_ts DESC) AS r FROM memory_entries) WHERE r = 1)"


def fans(s, d):
    return G.fans(N(s, d), E(s, d))


def entries(s, d):
    """The last delivery of each memory entry."""
    return R.first_per(load(s, d, "memory_entries"), ["id"], [F.col("entry_ts").desc()])


# joins and sets -----------------------------------------------------------------------------------------------------
@query("dependencies", S.SQL + " SELECT e.id, src, dst, edge_type, n.file_path AS path, n.node_type AS kind FROM e JOIN n ON n.id = e.dst")
def dependencies(s, d):
    return R.neighbours(E(s, d), N(s, d), "dst")


@query("dependents", S.SQL + " SELECT e.id, src, dst, edge_type, n.file_path AS path, n.node_type AS kind FROM e JOIN n ON n.id = e.src")
def dependents(s, d):
    return R.neighbours(E(s, d), N(s, d), "src")


@query("induced_subgraph", S.SQL + ", k AS (SELECT id FROM n WHERE regexp_matches(file_path, '/domain/|/service/')) SELECT e.id, e.src, e.dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def induced(s, d):
    return R.induced(N(s, d), E(s, d), F.col("file_path").rlike("/domain/|/service/"))[1].select("id", "src", "dst")


@query("linked_insights", "SELECT DISTINCT insight_id FROM evidence_links l WHERE insight_id IS NOT NULL AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = l.node_id)")
def linked(s, d):
    return load(s, d, "evidence_links").where("insight_id IS NOT NULL").join(load(s, d, "nodes").select(F.col("id").alias("node_id")), "node_id", "left_semi").select("insight_id").distinct()


@query("symbol_references", S.SQL + """, sym AS (SELECT snapshot_id, symbol_name, file_path FROM n WHERE symbol_name IS NOT NULL) SELECT a.snapshot_id, a.symbol_name, count(*) AS pair_count FROM sym a JOIN sym b ON a.snapshot_id = b.snapshot_id AND a.symbol_name = b.symbol_name AND a.file_path < b.file_path GROUP BY 1, 2""")
def symrefs(s, d):
    sym = N(s, d).where("symbol_name IS NOT NULL").groupBy("snapshot_id", "symbol_name", "file_path").agg(F.count(F.lit(1)).alias("k"))
    # ordered pairs of different files without forming them: (n^2 - sum k^2) / 2
    g = sym.groupBy("snapshot_id", "symbol_name").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"))
    return g.select("snapshot_id", "symbol_name", ((F.col("n") * F.col("n") - F.col("q")) / 2).cast("bigint").alias("pair_count")).where("pair_count > 0")


@query("import_path_resolution", S.SQL + r""", f AS (SELECT DISTINCT snapshot_id, file_path FROM n WHERE node_type = 'FILE'),
want AS (SELECT snapshot_id, file_path, regexp_replace(file_path, '\.[^./]*$', '') AS stem FROM f), cand AS (SELECT w.*, c.prio, c.p FROM want w, LATERAL (SELECT unnest([1, 2, 3]) AS prio, unnest([stem || '.ts', stem || '.js', stem || '/index.ts']) AS p) c)
SELECT cand.snapshot_id, cand.file_path, p AS resolved, prio FROM cand JOIN f g ON g.snapshot_id = cand.snapshot_id AND g.file_path = cand.p QUALIFY row_number() OVER (PARTITION BY cand.snapshot_id, cand.file_path ORDER BY prio) = 1""")
def resolve(s, d):
    f = N(s, d).where("node_type = 'FILE'").select("snapshot_id", "file_path").distinct()
    stem = F.regexp_replace("file_path", r"\.[^./]*$", "")
    cand = f.select("snapshot_id", "file_path", F.posexplode(F.array(F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".js")), F.concat(stem, F.lit("/index.ts")))).alias("pos", "resolved"))
    met = cand.join(f.withColumnRenamed("file_path", "resolved"), ["snapshot_id", "resolved"]).withColumn("prio", F.col("pos") + 1)
    return R.first_per(met, ["snapshot_id", "file_path"], [F.col("prio")]).select("snapshot_id", "file_path", "resolved", "prio")


@query("missing_endpoints", S.SQL + " SELECT id, 'src' AS side FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.src) UNION ALL SELECT id, 'dst' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.dst)")
def missing(s, d):
    n, e = N(s, d).select("id"), E(s, d)
    return union_all([e.join(n.withColumnRenamed("id", x), x, "left_anti").select("id", F.lit(x).alias("side")) for x in ("src", "dst")])


@query("orphan_nodes", S.SQL + " SELECT id FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def orphan_nodes(s, d):
    e = E(s, d)
    return N(s, d).select("id").join(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


@query("union_first_wins", "WITH c AS (SELECT symbol_name AS k, 1 AS src FROM high_value_symbols UNION ALL SELECT symbol_name, 2 FROM nodes WHERE symbol_name IS NOT NULL) SELECT k, min(src) AS source FROM c GROUP BY 1")
def union_first(s, d):
    a = load(s, d, "high_value_symbols").select(F.col("symbol_name").alias("k"), F.lit(1).alias("source"))
    b = load(s, d, "nodes").where("symbol_name IS NOT NULL").select(F.col("symbol_name").alias("k"), F.lit(2).alias("source"))
    return a.unionByName(b).groupBy("k").agg(F.min("source").alias("source"))


@query("except_intersect", "SELECT 'only_nodes' AS side, count(*) AS c FROM (SELECT language FROM nodes EXCEPT SELECT language FROM manifest_files) UNION ALL SELECT 'both', count(*) FROM (SELECT language FROM nodes INTERSECT SELECT language FROM manifest_files)")
def sets(s, d):
    a, b = load(s, d, "nodes").select("language"), load(s, d, "manifest_files").select("language")
    return a.subtract(b).agg(F.count(F.lit(1)).alias("c")).select(F.lit("only_nodes").alias("side"), "c").unionByName(a.intersect(b).agg(F.count(F.lit(1)).alias("c")).select(F.lit("both").alias("side"), "c"))


# aggregates ---------------------------------------------------------------------------------------------------------
@query("namespace_ownership", S.SQL + " SELECT snapshot_id, namespace, count(*) AS node_count, min(id) AS first_id, max(id) AS last_id FROM n WHERE node_type = 'FILE' GROUP BY 1, 2")
def ns(s, d):
    return N(s, d).where("node_type = 'FILE'").groupBy("snapshot_id", "namespace").agg(F.count(F.lit(1)).alias("node_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("symbol_ownership", S.SQL + " SELECT snapshot_id, symbol_name, count(DISTINCT file_path) AS files, count(*) AS nodes FROM n WHERE symbol_name IS NOT NULL GROUP BY 1, 2")
def symown(s, d):
    return N(s, d).where("symbol_name IS NOT NULL").groupBy("snapshot_id", "symbol_name").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("nodes"))


@query("module_rollup", S.SQL + " SELECT snapshot_id, module, count(*) FILTER (node_type = 'FILE') AS files, count(*) FILTER (node_type <> 'FILE') AS symbols, count(DISTINCT language) AS languages FROM n GROUP BY 1, 2")
def modules(s, d):
    return N(s, d).groupBy("snapshot_id", "module").agg(F.count_if(F.col("node_type") == "FILE").alias("files"), F.count_if(F.col("node_type") != "FILE").alias("symbols"), F.count_distinct("language").alias("languages"))


@query("node_type_pivot", S.SQL + " SELECT snapshot_id, " + ", ".join(f"count(*) FILTER (node_type = '{t}') AS {t.lower()}" for t in ("FILE", "CLASS", "FUNCTION", "INTERFACE", "VARIABLE")) + " FROM n GROUP BY 1")
def pivot(s, d):
    kinds = ["FILE", "CLASS", "FUNCTION", "INTERFACE", "VARIABLE"]
    p = N(s, d).groupBy("snapshot_id").pivot("node_type", kinds).count().na.fill(0)
    return p.select("snapshot_id", *[F.col(k).alias(k.lower()) for k in kinds])


@query("grouping_sets_summary", "SELECT classification, should_parse, count(*) AS c, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM manifest_files GROUP BY GROUPING SETS ((classification), (should_parse), ())")
def gsets(s, d):
    return load(s, d, "manifest_files").groupingSets([[F.col("classification")], [F.col("should_parse")], []], "classification", "should_parse").agg(F.count(F.lit(1)).alias("c"), F.sum("size_bytes").alias("bytes")).select("classification", "should_parse", "c", "bytes")


@query("role_histogram", "SELECT snapshot_id, array_to_string(list(classification || ':' || c ORDER BY c DESC, classification), ', ') AS roles FROM (SELECT snapshot_id, classification, count(*) AS c FROM manifest_files GROUP BY 1, 2) GROUP BY 1")
def roles(s, d):
    c = load(s, d, "manifest_files").groupBy("snapshot_id", "classification").agg(F.count(F.lit(1)).alias("c"))
    l = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("n"), "classification")))
    return c.groupBy("snapshot_id").agg(l.alias("l")).select("snapshot_id", F.array_join(F.transform("l", lambda x: F.concat(x["classification"], F.lit(":"), (-x["n"]).cast("string"))), ", ").alias("roles"))


@query("language_set", S.SQL + " SELECT snapshot_id, list_sort(list(DISTINCT language)) AS languages FROM n WHERE language IS NOT NULL GROUP BY 1")
def langs(s, d):
    return N(s, d).where("language IS NOT NULL").groupBy("snapshot_id").agg(F.sort_array(F.collect_set("language")).alias("languages"))


@query("duplicate_symbol_owners", S.SQL + " SELECT snapshot_id, symbol_name, count(DISTINCT file_path) AS files FROM n WHERE symbol_name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT file_path) > 1")
def dupsym(s, d):
    return N(s, d).where("symbol_name IS NOT NULL").groupBy("snapshot_id", "symbol_name").agg(F.count_distinct("file_path").alias("files")).where("files > 1")


@query("compression_metrics", "SELECT snapshot_id, count(*) AS files, round(sum(size_bytes) / count(*), 4) AS mean_bytes, round(count(*) FILTER (should_parse) / count(*), 4) AS parse_ratio FROM manifest_files GROUP BY 1")
def compmet(s, d):
    return load(s, d, "manifest_files").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("size_bytes") / F.count(F.lit(1)), 4).alias("mean_bytes"), F.round(F.count_if("should_parse") / F.count(F.lit(1)), 4).alias("parse_ratio"))


@query("internal_external_ratio", S.SQL + """, x AS (SELECT a.snapshot_id, a.id, a.namespace = b.namespace AS inside FROM ge JOIN n a ON a.id = ge.src JOIN n b ON b.id = ge.dst UNION ALL SELECT b.snapshot_id, b.id, a.namespace = b.namespace FROM ge JOIN n a ON a.id = ge.src JOIN n b ON b.id = ge.dst)
SELECT id, count(*) AS degree, round(avg(CASE WHEN inside THEN 1 ELSE 0 END), 4) AS internal_ratio FROM x GROUP BY 1""")
def ratio(s, d):
    p = N(s, d)
    a, b = p.select(F.col("id").alias("src"), F.col("namespace").alias("na")), p.select(F.col("id").alias("dst"), F.col("namespace").alias("nb"))
    ends = S.known_edges(s, d).join(a, "src").join(b, "dst").select(F.explode(F.array("src", "dst")).alias("id"), (F.col("na") == F.col("nb")).cast("int").alias("i"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.round(F.avg("i"), 4).alias("internal_ratio"))


@query("pair_coupling", S.SQL + """ SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS edge_count, round(avg(coalesce(weight, 1)), 6) AS mean_weight, min(id) AS first_edge,
CASE WHEN count(DISTINCT src) > 1 THEN 'CYCLIC' WHEN avg(coalesce(weight, 1)) >= 0.9 THEN 'TIGHT' WHEN avg(coalesce(weight, 1)) >= 0.6 THEN 'MODERATE' ELSE 'LOOSE' END AS coupling FROM e WHERE src <> dst GROUP BY 1, 2""")
def pairs(s, d):
    w = F.avg(F.coalesce("weight", F.lit(1.0)))
    kind = F.when(F.count_distinct("src") > 1, "CYCLIC").when(w >= 0.9, "TIGHT").when(w >= 0.6, "MODERATE").otherwise("LOOSE")
    return E(s, d).where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("edge_count"), F.round(w, 6).alias("mean_weight"), F.min("id").alias("first_edge"), kind.alias("coupling"))


@query("coupling_hotspots", S.SQL + FAN + " SELECT id, snapshot_id, fan_in * fan_out AS product FROM fan WHERE fan_in * fan_out > 0 QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY fan_in * fan_out DESC, id) <= 5")
def hot(s, d):
    f = fans(s, d).withColumn("product", F.col("fan_in") * F.col("fan_out")).where("product > 0")
    return R.first_per(f, ["snapshot_id"], [F.col("product").desc(), F.col("id")], 5).select("id", "snapshot_id", "product")


# snapshots, time and state ------------------------------------------------------------------------------------------
SNAP = "WITH s AS (SELECT DISTINCT id, project_id, version_no, status, created_at, activated_at, compression_ratio, is_degraded, is_frozen FROM snapshots)"


def snaps(s, d):
    return load(s, d, "snapshots").select("id", "project_id", "version_no", "status", "created_at", "activated_at", "compression_ratio", "is_degraded", "is_frozen").distinct()


@query("latest_version", SNAP + " SELECT project_id, max(version_no) AS latest, max(version_no) + 1 AS next_version, arg_max(id, version_no) AS id FROM s GROUP BY 1")
def latest_version(s, d):
    return snaps(s, d).groupBy("project_id").agg(F.max("version_no").alias("latest"), (F.max("version_no") + 1).alias("next_version"), F.max_by("id", "version_no").alias("id"))


@query("active_snapshot", SNAP + " SELECT project_id, id, version_no FROM s WHERE status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY version_no DESC) = 1")
def active(s, d):
    return R.first_per(snaps(s, d).where("status = 'ACTIVE'"), ["project_id"], [F.col("version_no").desc()]).select("project_id", "id", "version_no")


@query("status_transitions", SNAP + """, t AS (SELECT project_id, version_no, lag(status) OVER (PARTITION BY project_id ORDER BY version_no) AS before, status FROM s)
SELECT before, status, count(*) AS c, (before, status) NOT IN (('PENDING', 'ACTIVE'), ('PENDING', 'FAILED'), ('ACTIVE', 'DEGRADED'), ('ACTIVE', 'ACTIVE'), ('DEGRADED', 'ACTIVE')) AS illegal FROM t WHERE before IS NOT NULL GROUP BY 1, 2""")
def transitions(s, d):
    legal = s.createDataFrame([("PENDING", "ACTIVE"), ("PENDING", "FAILED"), ("ACTIVE", "DEGRADED"), ("ACTIVE", "ACTIVE"), ("DEGRADED", "ACTIVE")], "before string, status string").withColumn("illegal", F.lit(False))
    t = snaps(s, d).select(F.lag("status").over(W.partitionBy("project_id").orderBy("version_no")).alias("before"), "status").where("before IS NOT NULL").groupBy("before", "status").agg(F.count(F.lit(1)).alias("c"))
    return t.join(legal, ["before", "status"], "left").fillna(True, ["illegal"])


SERIES = S.SQL + """, sn AS (SELECT DISTINCT id, project_id, version_no FROM snapshots), nn AS (SELECT snapshot_id, count(*) AS v FROM n GROUP BY 1), ee AS (SELECT snapshot_id, count(*) AS c FROM e GROUP BY 1),
ser AS (SELECT project_id, version_no, sn.id, v, coalesce(c, 0) AS c, CASE WHEN v > 1 THEN 2 * coalesce(c, 0) / (v * (v - 1)) ELSE 0 END AS dens FROM sn JOIN nn ON nn.snapshot_id = sn.id LEFT JOIN ee ON ee.snapshot_id = sn.id)"""


def series(s, d):
    v = N(s, d).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("v"))
    c = E(s, d).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("c"))
    x = snaps(s, d).select(F.col("id").alias("snapshot_id"), "project_id", "version_no").join(v, "snapshot_id").join(c, "snapshot_id", "left").fillna(0, ["c"])
    return x.withColumn("dens", G.density(F.col("v"), F.col("c"))).withColumnRenamed("snapshot_id", "id")


def by_version():
    return W.partitionBy("project_id").orderBy("version_no")


@query("architectural_drift", SERIES + """, g AS (SELECT id, sqrt(pow(v - lag(v) OVER w, 2) + pow(c - lag(c) OVER w, 2) + pow(100 * (dens - lag(dens) OVER w), 2)) AS x FROM ser WINDOW w AS (PARTITION BY project_id ORDER BY version_no))
SELECT id, round(x, 4) AS drift, CASE WHEN x > 50 THEN 'severe' WHEN x > 20 THEN 'significant' WHEN x > 5 THEN 'moderate' ELSE 'minor' END AS drift_class FROM g WHERE x IS NOT NULL""")
def drift(s, d):
    step = lambda c: F.col(c) - F.lag(c).over(by_version())
    return series(s, d).withColumn("x", X.drift(step("v"), step("c"), step("dens"), F.lit(0))).where("x IS NOT NULL").select("id", F.round("x", 4).alias("drift"), X.drift_class(F.col("x")).alias("drift_class"))


@query("volatility", SERIES + ", g AS (SELECT project_id, abs(dens - lag(dens) OVER (PARTITION BY project_id ORDER BY version_no)) AS x FROM ser) SELECT project_id, round(avg(x), 6) AS mean_step, round(max(x), 6) AS max_step, count(*) FILTER (x > 0.001) AS events, count(*) FILTER (x > 0.2) AS spikes FROM g GROUP BY 1")
def volatility(s, d):
    x = series(s, d).withColumn("x", F.abs(F.col("dens") - F.lag("dens").over(by_version())))
    return x.groupBy("project_id").agg(F.round(F.avg("x"), 6).alias("mean_step"), F.round(F.max("x"), 6).alias("max_step"), F.count_if(F.col("x") > 0.001).alias("events"), F.count_if(F.col("x") > 0.2).alias("spikes"))


@query("trend", SERIES + ", g AS (SELECT project_id, arg_max(dens, version_no) - arg_min(dens, version_no) AS x FROM ser GROUP BY 1) SELECT project_id, CASE WHEN x > 0.05 THEN 'rising' WHEN x < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM g")
def trend(s, d):
    x = series(s, d).groupBy("project_id").agg((F.max_by("dens", "version_no") - F.min_by("dens", "version_no")).alias("x"))
    return x.select("project_id", F.when(F.col("x") > 0.05, "rising").when(F.col("x") < -0.05, "falling").otherwise("stable").alias("trend"))


@query("regression_signals", SERIES + """, g AS (SELECT id, v, lag(v) OVER (PARTITION BY project_id ORDER BY version_no) AS before FROM ser) SELECT id, round(CASE WHEN before = 0 THEN 100 * v ELSE (v - before) / abs(before) * 100 END, 4) AS percent,
CASE WHEN (v - before) / before > 0.3 THEN 'critical' WHEN (v - before) / before > 0.2 THEN 'warning' ELSE 'info' END AS severity FROM g WHERE before IS NOT NULL AND (v - before) / before > 0.1""")
def regression(s, d):
    x = series(s, d).withColumn("before", F.lag("v").over(by_version())).where("before IS NOT NULL").withColumn("r", (F.col("v") - F.col("before")) / F.col("before")).where("r > 0.1")
    return x.select("id", F.round(X.percent_change(F.col("before"), F.col("v")), 4).alias("percent"), F.when(F.col("r") > 0.3, "critical").when(F.col("r") > 0.2, "warning").otherwise("info").alias("severity"))


@query("evolution_events", SERIES + """, g AS (SELECT id, v - lag(v) OVER w AS dv, c - lag(c) OVER w AS dc, dens - lag(dens) OVER w AS dd FROM ser WINDOW w AS (PARTITION BY project_id ORDER BY version_no)),
u AS (SELECT id, 'nodes' AS kind, CAST(dv AS DOUBLE) AS delta FROM g UNION ALL SELECT id, 'edges', dc FROM g UNION ALL SELECT id, 'density', dd FROM g) SELECT id, kind, round(delta, 6) AS delta FROM u WHERE abs(delta) > 0.01""")
def evolution(s, d):
    x = series(s, d).select("id", *[(F.col(c) - F.lag(c).over(by_version())).cast("double").alias(k) for c, k in (("v", "nodes"), ("c", "edges"), ("dens", "density"))])
    return x.unpivot(["id"], ["nodes", "edges", "density"], "kind", "delta").where(F.abs("delta") > 0.01).select("id", "kind", F.round("delta", 6).alias("delta"))


@query("rolling_failures", "WITH f AS (SELECT DISTINCT snapshot_id, ingest_started_at AS ts, parse_failed FROM ingestion_results WHERE snapshot_status = 'FAILED') SELECT snapshot_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS recent FROM f WHERE ts IS NOT NULL")
def rolling(s, d):
    f = load(s, d, "ingestion_results").where("snapshot_status = 'FAILED'").select("snapshot_id", F.col("ingest_started_at").alias("ts"), "parse_failed").distinct().where("ts IS NOT NULL").withColumn("day", F.date_trunc("month", "ts"))
    # a range join on month buckets instead of one global window
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    a = f.select("snapshot_id", "ts", F.explode(F.sequence(F.to_date(F.expr("ts - INTERVAL 30 DAY")), F.to_date("ts"), F.expr("INTERVAL 1 DAY"))).alias("on"))
    b = f.groupBy(F.col("ts").alias("t2")).agg(F.count(F.lit(1)).alias("k")).withColumn("on", F.to_date("t2"))
    return a.join(b, "on").where((F.col("t2") <= F.col("ts")) & (sec("ts") - sec("t2") <= 30 * 86400)).groupBy("snapshot_id", "ts").agg(F.sum("k").alias("recent")).select("snapshot_id", "recent")


# validation ---------------------------------------------------------------------------------------------------------
ISSUES = S.SQL + """, issues AS (
SELECT snapshot_id, 'NODE_REF_MISSING_SOURCE' AS code, 'CRITICAL' AS severity, id AS ref FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.src)
UNION ALL SELECT snapshot_id, 'NODE_REF_MISSING_TARGET', 'CRITICAL', id FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.dst)
UNION ALL SELECT snapshot_id, 'EDGE_SELF_REFERENCE', 'WARNING', id FROM e WHERE src = dst
UNION ALL SELECT snapshot_id, 'EDGE_DUPLICATE', 'ERROR', id FROM e QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY id) > 1
UNION ALL SELECT snapshot_id, 'ORPHAN_NODE', 'WARNING', id FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)
UNION ALL SELECT snapshot_id, 'BROKEN_DEP_TARGET', 'ERROR', id FROM e WHERE edge_type IN ('IMPORTS', 'DEPENDS_ON') AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.dst)
UNION ALL SELECT snapshot_id, 'METRIC_RANGE', 'ERROR', id FROM e WHERE weight < 0 OR weight > 1)"""


def issues(s, d):
    n, e = N(s, d), E(s, d)
    out = lambda df, code, sev: df.select("snapshot_id", F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col("id").alias("ref"))
    ids = n.select("id")
    no_dst = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    again = e.withColumn("r", F.row_number().over(W.partitionBy("src", "dst").orderBy("id"))).where("r > 1")
    return union_all([
        out(e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "NODE_REF_MISSING_SOURCE", "CRITICAL"),
        out(no_dst, "NODE_REF_MISSING_TARGET", "CRITICAL"),
        out(e.where("src = dst"), "EDGE_SELF_REFERENCE", "WARNING"),
        out(again, "EDGE_DUPLICATE", "ERROR"),
        out(n.join(ends, "id", "left_anti"), "ORPHAN_NODE", "WARNING"),
        out(no_dst.where(F.col("edge_type").isin("IMPORTS", "DEPENDS_ON")), "BROKEN_DEP_TARGET", "ERROR"),
        out(e.where("weight < 0 OR weight > 1"), "METRIC_RANGE", "ERROR"),
    ])


@query("validation_issues", ISSUES + " SELECT * FROM issues")
def validation(s, d):
    return issues(s, d)


@query("validation_summary", ISSUES + " SELECT severity, code, count(*) AS c FROM issues GROUP BY GROUPING SETS ((severity), (code), ())")
def vsummary(s, d):
    return issues(s, d).groupingSets([[F.col("severity")], [F.col("code")], []], "severity", "code").agg(F.count(F.lit(1)).alias("c")).select("severity", "code", "c")


@query("readiness_score", ISSUES + """, k AS (SELECT snapshot_id, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'ERROR') AS x, count(*) FILTER (severity = 'WARNING') AS w FROM issues GROUP BY 1)
SELECT snapshot_id, round(CAST(greatest(0, least(1, 1 - 0.25 * c - 0.1 * x - 0.02 * w)) AS DOUBLE), 4) AS score, CASE WHEN c > 0 THEN 'BLOCKED' WHEN x > 0 THEN 'DEGRADED' ELSE 'READY' END AS state FROM k""")
def readiness(s, d):
    k = issues(s, d).groupBy("snapshot_id").agg(*[F.count_if(F.col("severity") == v).alias(a) for v, a in (("CRITICAL", "c"), ("ERROR", "x"), ("WARNING", "w"))])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("c") * 0.25 - F.col("x") * 0.1 - F.col("w") * 0.02))
    return k.select("snapshot_id", F.round(score, 4).alias("score"), F.when(F.col("c") > 0, "BLOCKED").when(F.col("x") > 0, "DEGRADED").otherwise("READY").alias("state"))


@query("namespace_type_mix", S.SQL + " SELECT snapshot_id, namespace, count(DISTINCT node_type) AS kinds FROM n GROUP BY 1, 2 HAVING count(DISTINCT node_type) > 2")
def mix(s, d):
    return N(s, d).groupBy("snapshot_id", "namespace").agg(F.count_distinct("node_type").alias("kinds")).where("kinds > 2")


@query("evidence_validation", "SELECT DISTINCT id, 'node' AS kind FROM evidence_links l WHERE node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = l.node_id) UNION ALL SELECT DISTINCT id, 'edge' FROM evidence_links l WHERE edge_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.id = l.edge_id)")
def evidence(s, d):
    l = load(s, d, "evidence_links")
    part = lambda c, t, k: l.where(F.col(c).isNotNull()).join(load(s, d, t).select(F.col("id").alias(c)), c, "left_anti").select("id", F.lit(k).alias("kind")).distinct()
    return part("node_id", "nodes", "node").unionByName(part("edge_id", "edges", "edge"))


# diffs --------------------------------------------------------------------------------------------------------------
PAIRS = S.SQL + ", s AS (SELECT DISTINCT id, project_id, version_no FROM snapshots WHERE status IN ('ACTIVE', 'DEGRADED')), pairs AS (SELECT id AS snapshot_id, lag(id) OVER (PARTITION BY project_id ORDER BY version_no, id) AS base_id FROM s)"


def _sides(s, d, df):
    p = consecutive(load(s, d, "snapshots")).where("base_id IS NOT NULL").select("snapshot_id", "base_id")
    return df.join(p.select(F.col("snapshot_id").alias("snap"), F.col("base_id").alias("snapshot_id")), "snapshot_id").drop("snapshot_id").withColumnRenamed("snap", "snapshot_id"), df.join(p.select("snapshot_id"), "snapshot_id")


@query("graph_node_diff", PAIRS + """, k AS (SELECT snapshot_id, file_path, node_type, coalesce(symbol_name, '') AS sym, max_by(file_hash, id) AS h FROM n GROUP BY 1, 2, 3, 4),
a AS (SELECT p.snapshot_id, file_path, node_type, sym, h FROM k JOIN pairs p ON p.base_id = k.snapshot_id), b AS (SELECT k.* FROM k JOIN pairs p USING (snapshot_id) WHERE base_id IS NOT NULL)
SELECT snapshot_id, file_path, node_type, sym, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM b.h THEN 'modified' ELSE 'unchanged' END AS kind FROM (SELECT *, 1 AS x FROM a) a FULL JOIN (SELECT *, 1 AS x FROM b) b USING (snapshot_id, file_path, node_type, sym)""")
def node_diff(s, d):
    k = N(s, d).groupBy("snapshot_id", "file_path", "node_type", F.coalesce("symbol_name", F.lit("")).alias("sym")).agg(F.max(F.struct("id", "file_hash")).alias("m")).withColumn("h", F.col("m.file_hash"))
    old, new = _sides(s, d, k.drop("m"))
    return R.keyed_diff(old, new, ["snapshot_id", "file_path", "node_type", "sym"], "h")


@query("graph_edge_diff", PAIRS + """, k AS (SELECT DISTINCT ge.snapshot_id, a.file_path AS src_path, b.file_path AS dst_path, edge_type FROM ge JOIN n a ON a.id = ge.src JOIN n b ON b.id = ge.dst),
o AS (SELECT p.snapshot_id, src_path, dst_path, edge_type FROM k JOIN pairs p ON p.base_id = k.snapshot_id), w AS (SELECT k.* FROM k JOIN pairs p USING (snapshot_id) WHERE base_id IS NOT NULL)
(SELECT *, 'added' AS kind FROM (SELECT * FROM w EXCEPT SELECT * FROM o)) UNION ALL (SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM w))""")
def edge_diff(s, d):
    p = N(s, d)
    a, b = p.select(F.col("id").alias("src"), F.col("file_path").alias("src_path")), p.select(F.col("id").alias("dst"), F.col("file_path").alias("dst_path"))
    k = S.known_edges(s, d).join(a, "src").join(b, "dst").select("snapshot_id", "src_path", "dst_path", "edge_type").distinct()
    old, new = _sides(s, d, k.withColumn("h", F.lit(1)))
    return R.keyed_diff(old, new, ["snapshot_id", "src_path", "dst_path", "edge_type"], "h").where("kind <> 'unchanged'")


@query("reuse_plan", PAIRS + """, f AS (SELECT snapshot_id, file_path, max(file_hash) AS h, min(id) AS id FROM n WHERE node_type = 'FILE' GROUP BY 1, 2) SELECT b.snapshot_id, a.id AS reused_id, b.id FROM f b JOIN pairs p USING (snapshot_id) JOIN f a ON a.snapshot_id = p.base_id AND a.file_path = b.file_path AND a.h IS NOT DISTINCT FROM b.h""")
def reuse(s, d):
    f = N(s, d).where("node_type = 'FILE'").groupBy("snapshot_id", "file_path").agg(F.max("file_hash").alias("h"), F.min("id").alias("id"))
    old, new = _sides(s, d, f)
    o = old.select("snapshot_id", "file_path", F.col("h").alias("oh"), F.col("id").alias("reused_id"))
    return new.join(o, ["snapshot_id", "file_path"]).where(F.col("h").eqNullSafe(F.col("oh"))).select("snapshot_id", "reused_id", "id")


# semantics, files, ranking ------------------------------------------------------------------------------------------
def _when(rules, col, other):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"


LAYER = r"""CASE WHEN regexp_matches(file_path, '/routes?/|\broutes?/|\bapi\b') THEN 'API_LAYER' WHEN regexp_matches(file_path, '/controllers?/|[.]controller[.]') THEN 'API_LAYER'
 WHEN regexp_matches(file_path, '/services?/|[.]service[.]') THEN 'SERVICE_LAYER' WHEN regexp_matches(file_path, '/repositories?/|/daos?/|/databases?/|/models?/') THEN 'DATA_LAYER'
 WHEN regexp_matches(file_path, '/domain/|/entities?/|/aggregates?/') THEN 'DOMAIN_LAYER' WHEN regexp_matches(file_path, '/infrastructure/|/adapters?/|/providers?/') THEN 'INFRASTRUCTURE'
 WHEN regexp_matches(file_path, '/components?/|/pages?/|/views?/|/ui/|[.](tsx|jsx)$') THEN 'UI_LAYER' WHEN regexp_matches(file_path, '/utils?/|/helpers?/|/lib/|/shared/') THEN 'SHARED_UTILITY'
 WHEN regexp_matches(file_path, '/config/|[.]config[.]|[.]env[.]') THEN 'CONFIGURATION' WHEN regexp_matches(file_path, '[.](test|spec|e2e|integration)[.]|/__tests__/|/__mocks__/|/fixtures?/') THEN 'TESTING'
 WHEN regexp_matches(file_path, '/(build|dist|scripts?)/|[.]dockerfile|\bDockerfile\b') THEN 'BUILD_SYSTEM' WHEN regexp_matches(file_path, '/middleware/|[.]middleware[.]') THEN 'INFRASTRUCTURE'
 WHEN regexp_matches(file_path, '/auth/|/guards?/|/security/') THEN 'SECURITY' WHEN regexp_matches(file_path, '/logging/|/monitoring/|/telemetry/|/tracing/') THEN 'OBSERVABILITY'
 WHEN regexp_matches(file_path, '/migrations?/') THEN 'DATA_LAYER' WHEN regexp_matches(file_path, '/graphql/|/resolvers?/|/schemas?/') THEN 'API_LAYER' ELSE 'UNKNOWN' END"""
IMPORTANCE = """CASE layer WHEN 'DOMAIN_LAYER' THEN 10 WHEN 'SERVICE_LAYER' THEN 8 WHEN 'API_LAYER' THEN 7 WHEN 'DATA_LAYER' THEN 6 WHEN 'SHARED_UTILITY' THEN 5 WHEN 'INFRASTRUCTURE' THEN 4 WHEN 'UI_LAYER' THEN 3
 WHEN 'CONFIGURATION' THEN 2 WHEN 'SECURITY' THEN 2 WHEN 'OBSERVABILITY' THEN 2 WHEN 'TESTING' THEN 1 WHEN 'BUILD_SYSTEM' THEN 1 ELSE 0 END"""


@query("classify_layers", S.SQL + f" SELECT id, {LAYER} AS layer FROM n WHERE node_type = 'FILE'")
def layers(s, d):
    return N(s, d).where("node_type = 'FILE'").select("id", L.layer(F.col("file_path")).alias("layer"))


@query("architectural_slice", S.SQL + f", l AS (SELECT id, {LAYER} AS layer FROM n) SELECT e.id, a.layer AS src_layer, b.layer AS dst_layer FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst WHERE a.layer IN ('DOMAIN_LAYER', 'SERVICE_LAYER') AND b.layer IN ('DOMAIN_LAYER', 'SERVICE_LAYER')")
def aslice(s, d):
    l = N(s, d).select("id", L.layer(F.col("file_path")).alias("layer")).where(F.col("layer").isin("DOMAIN_LAYER", "SERVICE_LAYER"))
    return E(s, d).join(l.select(F.col("id").alias("src"), F.col("layer").alias("src_layer")), "src").join(l.select(F.col("id").alias("dst"), F.col("layer").alias("dst_layer")), "dst").select("id", "src_layer", "dst_layer")


@query("infra_to_domain_edges", S.SQL + f", l AS (SELECT id, {LAYER} AS layer FROM n) SELECT e.id FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst WHERE a.layer = 'INFRASTRUCTURE' AND b.layer = 'DOMAIN_LAYER'")
def infra(s, d):
    l = N(s, d).select("id", L.layer(F.col("file_path")).alias("layer"))
    return E(s, d).join(l.where("layer = 'INFRASTRUCTURE'").select(F.col("id").alias("src")), "src", "left_semi").join(l.where("layer = 'DOMAIN_LAYER'").select(F.col("id").alias("dst")), "dst", "left_semi").select("id")


@query("domain_clusters", S.SQL + """, x AS (SELECT a.snapshot_id, a.namespace AS na, b.namespace AS nb FROM ge JOIN n a ON a.id = ge.src JOIN n b ON b.id = ge.dst), u AS (SELECT snapshot_id, na AS namespace, na = nb AS inside FROM x UNION ALL SELECT snapshot_id, nb, na = nb FROM x),
c AS (SELECT snapshot_id, namespace, CAST(floor(count(*) FILTER (inside) / 2) AS BIGINT) AS i, count(*) FILTER (NOT inside) AS o FROM u GROUP BY 1, 2) SELECT snapshot_id, namespace, i AS internal, o AS external, CASE WHEN i + o > 0 THEN round(i / (i + o), 4) ELSE 0 END AS cohesion FROM c""")
def clusters(s, d):
    p = N(s, d)
    a, b = p.select(F.col("id").alias("src"), F.col("namespace").alias("na")), p.select(F.col("id").alias("dst"), F.col("namespace").alias("nb"))
    u = S.known_edges(s, d).join(a, "src").join(b, "dst").select("snapshot_id", F.explode(F.array("na", "nb")).alias("namespace"), (F.col("na") == F.col("nb")).alias("inside"))
    c = u.groupBy("snapshot_id", "namespace").agg(F.floor(F.count_if("inside") / 2).alias("internal"), F.count_if(~F.col("inside")).alias("external"))
    t = F.col("internal") + F.col("external")
    return c.withColumn("cohesion", F.when(t > 0, F.round(F.try_divide(F.col("internal"), t), 4)).otherwise(0.0))


CLASSES = _when(X.FILE_CLASSES, "file_path", "?").replace(" ELSE '?' END", "")
EXT = r"lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+(\.[^.]*)$', 1))"


@query("file_relevance", S.SQL + f""", k AS (SELECT id, file_path, {CLASSES} WHEN {EXT} IN ({', '.join(repr(x) for x in X.LANGUAGES)}) THEN 'SOURCE_CODE' ELSE 'UNKNOWN' END AS kind FROM n WHERE node_type = 'FILE'),
b AS (SELECT id, file_path, kind, CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in X.BASE_RELEVANCE.items())} END AS base FROM k), c AS (SELECT *, CASE WHEN regexp_matches(file_path, '(^|/)src/') THEN least(base + 0.2, 1) ELSE base END AS x FROM b),
g AS (SELECT *, CASE WHEN kind IN ('GENERATED', 'BINARY') THEN least(x, 0.1) ELSE x END AS y FROM c) SELECT id, kind, round(CAST(CASE WHEN len(string_split(file_path, '/')) > 2 AND kind = 'SOURCE_CODE' THEN least(y + 0.05, 1) ELSE y END AS DOUBLE), 2) AS relevance FROM g""")
def file_relevance(s, d):
    f = N(s, d).where("node_type = 'FILE'").withColumn("kind", X.file_class(F.col("file_path")))
    return f.select("id", "kind", X.relevance(F.col("file_path"), F.col("kind")).alias("relevance"))


@query("composite_ranking", S.SQL + FAN + f""", l AS (SELECT *, {LAYER} AS layer FROM fan), r AS (SELECT id, snapshot_id, round(0.25 * least(1, (fan_in + fan_out) / 20) + 0.25 * {IMPORTANCE} / 10 + 0.25 * CASE WHEN fan_in + fan_out > 0 THEN fan_out / (fan_in + fan_out) ELSE 0 END + 0.25 / (1 + fan_in), 4) AS score FROM l)
SELECT id, snapshot_id, score FROM r QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, id) <= 10""")
def ranking(s, d):
    f = fans(s, d).withColumn("layer", L.layer(F.col("file_path")))
    score = F.least(F.lit(1.0), F.col("total") / 20) * 0.25 + L.importance(F.col("layer")) * 0.25 / 10 + F.coalesce(F.try_divide(F.col("fan_out"), F.col("total")), F.lit(0.0)) * 0.25 + F.lit(0.25) / (F.col("fan_in") + 1)
    return R.first_per(f.select("id", "snapshot_id", F.round(score, 4).alias("score")), ["snapshot_id"], [F.col("score").desc(), F.col("id")], 10)


@query("repository_hash", """WITH b AS (SELECT snapshot_id, substr(sha256(file_path), 1, 3) AS bucket, sha256(string_agg(sha256, '' ORDER BY file_path, sha256)) AS h, count(*) AS files, sum(size_bytes) AS bytes FROM manifest_files WHERE sha256 IS NOT NULL GROUP BY 1, 2)
SELECT snapshot_id, sha256(string_agg(h, '' ORDER BY bucket)) AS repository_hash, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY 1""")
def repohash(s, d):
    """A hash of hashes: files fall into 4,096 ranges, so that no task folds a whole repository."""
    m = load(s, d, "manifest_files").where("sha256 IS NOT NULL").groupBy("snapshot_id", F.substring(F.sha2("file_path", 256), 1, 3).alias("bucket"))
    return _folded(m.agg(F.array_sort(F.collect_list(F.struct("file_path", "sha256"))).alias("l"), F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")), "snapshot_id", "sha256", "", "repository_hash", ["files", "bytes"])


def _folded(parts, key, value, gap, to, sums):
    h = parts.select(key, "bucket", F.sha2(F.array_join(F.transform("l", lambda x: x[value]), gap), 256).alias("h"), *sums)
    g = h.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", "h"))).alias("l"), *[F.sum(c).alias(c) for c in sums])
    return g.select(key, F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ""), 256).alias(to), *sums)


@query("path_scalars", S.SQL + f" SELECT id, namespace, module, {EXT} AS extension, len(list_filter(string_split(file_path, '/'), lambda x: x <> '' AND x <> '.')) - 1 AS depth FROM n")
def paths(s, d):
    p = F.col("file_path")
    return N(s, d).select("id", "namespace", "module", X.extension(p).alias("extension"), X.entry_depth(p).alias("depth"))


@query("stable_ids", S.SQL + " SELECT id, snapshot_id || '-' || node_type || '-' || substr(sha256(node_type || ':' || file_path), 1, 16) AS stable_id FROM n")
def stable(s, d):
    return N(s, d).select("id", F.concat_ws("-", "snapshot_id", "node_type", F.substring(F.sha2(F.concat_ws(":", "node_type", "file_path"), 256), 1, 16)).alias("stable_id"))


# memory -------------------------------------------------------------------------------------------------------------
@query("keep_latest_entry", ENTRIES + " SELECT id, category, parent_id, entry_ts FROM m")
def keep_latest(s, d):
    return entries(s, d).select("id", "category", "parent_id", "entry_ts")


@query("entry_filter", ENTRIES + " SELECT id FROM m WHERE category IN ('evolution', 'architecture') AND list_has_any(tags, ['hot', 'stale']) AND entry_ts >= TIMESTAMP '2024-01-01' AND fingerprint < '8'")
def entry_filter(s, d):
    cond = F.col("category").isin("evolution", "architecture") & F.arrays_overlap("tags", F.array(F.lit("hot"), F.lit("stale"))) & (F.col("entry_ts") >= F.lit("2024-01-01").cast("timestamp_ntz")) & (F.col("fingerprint") < "8")
    return entries(s, d).where(cond).select("id")


@query("term_index", ENTRIES + ", t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{3,}')) AS term FROM m) SELECT term, count(*) AS df FROM t GROUP BY 1")
def term_idx(s, d):
    return R.term_index(entries(s, d), "id", X.terms(F.col("content"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("dedupe_by_fingerprint", ENTRIES + " SELECT fingerprint, min(id) AS id, count(*) AS copies FROM m GROUP BY 1")
def dedupe(s, d):
    return entries(s, d).groupBy("fingerprint").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


@query("retention_by_category", ENTRIES + " SELECT id, category FROM m QUALIFY row_number() OVER (PARTITION BY category ORDER BY id DESC) <= 50")
def retention(s, d):
    return R.first_per(entries(s, d), ["category"], [F.col("id").desc()], 50).select("id", "category")


@query("diversity_round_robin", ENTRIES + ", t AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS t FROM m) SELECT id FROM t ORDER BY t, category LIMIT 40")
def diversity(s, d):
    return R.spread(entries(s, d), "category", [F.col("id")], 40).select("id")


@query("change_index", "WITH u AS (SELECT DISTINCT id, fingerprint, entry_ts FROM memory_entries), g AS (SELECT id, entry_ts, fingerprint, lag(fingerprint) OVER (PARTITION BY id ORDER BY entry_ts) AS before FROM u) SELECT id, entry_ts, CASE WHEN before IS NULL THEN 'created' WHEN before IS DISTINCT FROM fingerprint THEN 'modified' ELSE 'same' END AS change FROM g")
def change_index(s, d):
    u = load(s, d, "memory_entries").select("id", "fingerprint", "entry_ts").distinct().withColumn("before", F.lag("fingerprint").over(W.partitionBy("id").orderBy("entry_ts")))
    return u.select("id", "entry_ts", F.when(F.col("before").isNull(), "created").when(~F.col("before").eqNullSafe(F.col("fingerprint")), "modified").otherwise("same").alias("change"))


@query("tag_hotspots", ENTRIES + ", t AS (SELECT unnest(tags) AS tag FROM m) SELECT tag, count(*) AS c FROM t GROUP BY 1 HAVING count(*) >= 3")
def tags(s, d):
    return entries(s, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("c")).where("c >= 3")


@query("token_estimates", ENTRIES + " SELECT id, CAST(ceil((length(coalesce(content, '')) + length(coalesce(category, ''))) / 4) AS BIGINT) AS tokens FROM m")
def tokens(s, d):
    return entries(s, d).select("id", X.token_estimate(F.col("content"), F.col("category")).alias("tokens"))


@query("budget_prefix", ENTRIES + ", t AS (SELECT id, category, sum(ceil(length(coalesce(content, '')) / 4)) OVER (PARTITION BY category ORDER BY id) AS used FROM m) SELECT id, category FROM t WHERE used <= 2000")
def budget(s, d):
    return R.prefix_budget(entries(s, d).withColumn("c", X.token_estimate(F.col("content"))), ["category"], [F.col("id")], "c", 2000).select("id", "category")


@query("budget_greedy")
def greedy(s, d):
    return R.greedy(entries(s, d).withColumn("c", X.token_estimate(F.col("content"))), ["category"], [F.col("entry_ts").desc(), F.col("id")], "c", 500).select("id", "category")


@query("entry_fingerprints", ENTRIES + " SELECT id, sha256(id || '|' || coalesce(category, '') || '|' || coalesce(content, '')) AS fp FROM m")
def entry_fp(s, d):
    return entries(s, d).select("id", X.fingerprint(F.col("id"), F.col("category"), F.col("content")).alias("fp"))


@query("repository_fingerprint", ENTRIES + ", b AS (SELECT category, substr(sha256(id), 1, 3) AS bucket, sha256(string_agg(id || ':' || fingerprint, '|' ORDER BY id)) AS h FROM m WHERE fingerprint IS NOT NULL GROUP BY 1, 2) SELECT category, sha256(string_agg(h, '' ORDER BY bucket)) AS fp FROM b GROUP BY 1")
def repo_fp(s, d):
    g = entries(s, d).where("fingerprint IS NOT NULL").groupBy("category", F.substring(F.sha2("id", 256), 1, 3).alias("bucket"))
    return _folded(g.agg(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(":", "id", "fingerprint").alias("x")))).alias("l")), "category", "x", "|", "fp", [])


@query("substring_search", ENTRIES + " SELECT id FROM m WHERE contains(lower(content), 'blast radius')")
def search(s, d):
    return entries(s, d).where(F.lower("content").contains("blast radius")).select("id")


@query("paging_segments", ENTRIES + ", t AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM m) SELECT id, category, (r - 1) // 20 AS page FROM t")
def paging(s, d):
    numbered = R.running_sum(entries(s, d).select("id", "category"), ["category"], [F.col("id")], F.lit(1), "r")
    return numbered.select("id", "category", F.floor((F.col("r") - 1) / 20).alias("page"))


# rules and insights -------------------------------------------------------------------------------------------------
INSIGHTS = S.SQL + FAN + """, ins AS (
SELECT snapshot_id, id AS ref, 'HOTSPOT' AS category, CASE WHEN fan_in + fan_out >= 50 THEN 'CRITICAL' WHEN fan_in + fan_out >= 30 THEN 'HIGH' WHEN fan_in + fan_out >= 15 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM fan WHERE fan_in + fan_out >= 5
UNION ALL SELECT snapshot_id, id, 'INSTABILITY', CASE WHEN fan_out / (fan_in + fan_out) >= 0.8 THEN 'CRITICAL' WHEN fan_out / (fan_in + fan_out) >= 0.6 THEN 'HIGH' ELSE 'MODERATE' END FROM fan WHERE fan_in + fan_out > 0 AND fan_out / (fan_in + fan_out) >= 0.3
UNION ALL SELECT snapshot_id, id, 'COUPLING', CASE WHEN weight >= 0.8 THEN 'CRITICAL' WHEN weight >= 0.6 THEN 'HIGH' ELSE 'MODERATE' END FROM e WHERE weight >= 0.3)"""
CAT = {"HOTSPOT": 0.9, "INSTABILITY": 0.8, "COUPLING": 0.75}
SEV = {"CRITICAL": 4, "HIGH": 3, "MODERATE": 2, "LOW": 1}


def insights(s, d):
    f = fans(s, d).withColumn("x", F.coalesce(F.try_divide(F.col("fan_out"), F.col("total")), F.lit(0.0)))
    row = lambda df, cat, sev: df.select("snapshot_id", F.col("id").alias("ref"), F.lit(cat).alias("category"), sev.alias("severity"))
    return union_all([
        row(f.where("total >= 5"), "HOTSPOT", X.steps(F.col("total"), (50, "CRITICAL"), (30, "HIGH"), (15, "MODERATE"), other="LOW")),
        row(f.where("x >= 0.3"), "INSTABILITY", X.steps(F.col("x"), (0.8, "CRITICAL"), (0.6, "HIGH"), other="MODERATE")),
        row(E(s, d).where("weight >= 0.3"), "COUPLING", X.steps(F.col("weight"), (0.8, "CRITICAL"), (0.6, "HIGH"), other="MODERATE")),
    ])


@query("insights", INSIGHTS + " SELECT * FROM ins")
def all_insights(s, d):
    return insights(s, d)


@query("insight_pivot", INSIGHTS + " SELECT category, " + ", ".join(f"count(*) FILTER (severity = '{v}') AS {v.lower()}" for v in SEV) + " FROM ins GROUP BY 1")
def insight_pivot(s, d):
    p = insights(s, d).groupBy("category").pivot("severity", list(SEV)).count().na.fill(0)
    return p.select("category", *[F.col(v).alias(v.lower()) for v in SEV])


@query("insight_priority", INSIGHTS + f""", p AS (SELECT ref, category, round(CASE severity {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SEV.items())} END / 4 * 0.5e0 + CASE category {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in CAT.items())} END * 0.3e0 + 0.6e0 * 0.2e0, 2) AS score FROM ins)
SELECT ref, category, score, CASE WHEN score >= 0.8 THEN 'IMMEDIATE' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM p""")
def priority(s, d):
    score = F.round(X.lookup(SEV, F.col("severity")) / 4 * 0.5 + X.lookup(CAT, F.col("category")) * 0.3 + F.lit(0.6) * 0.2, 2)
    return insights(s, d).select("ref", "category", score.alias("score")).withColumn("label", X.steps(F.col("score"), (0.8, "IMMEDIATE"), (0.6, "HIGH"), (0.4, "MEDIUM"), other="LOW"))


@query("rule_findings", INSIGHTS + ", k AS (SELECT snapshot_id, category, count(*) AS c FROM ins WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY 1, 2) SELECT snapshot_id, category, c, 'Snapshot ' || snapshot_id || ' has ' || c || ' severe findings of ' || category AS message FROM k WHERE c >= 3")
def rule_findings(s, d):
    k = insights(s, d).where(F.col("severity").isin("CRITICAL", "HIGH")).groupBy("snapshot_id", "category").agg(F.count(F.lit(1)).alias("c")).where("c >= 3")
    return k.withColumn("message", X.render(F.lit("Snapshot {s} has {c} severe findings of {k}"), {"s": F.col("snapshot_id"), "c": F.col("c"), "k": F.col("category")}))


@query("evidence_counts", "WITH l AS (SELECT DISTINCT id, insight_id, node_id, edge_id, metric_type FROM evidence_links) SELECT insight_id, count(node_id) AS nodes, count(edge_id) AS edges, count(metric_type) AS metrics FROM l WHERE insight_id IS NOT NULL GROUP BY 1")
def evidence_counts(s, d):
    l = load(s, d, "evidence_links").select("id", "insight_id", "node_id", "edge_id", "metric_type").distinct().where("insight_id IS NOT NULL")
    return l.groupBy("insight_id").agg(F.count("node_id").alias("nodes"), F.count("edge_id").alias("edges"), F.count("metric_type").alias("metrics"))


@query("sanitizer_report", "SELECT classification, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (should_parse) AS candidates FROM manifest_files GROUP BY 1")
def sanitizer(s, d):
    return load(s, d, "manifest_files").groupBy("classification").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if("should_parse").alias("candidates"))


@query("nondeterminism_scan", "WITH l AS (SELECT file_id, unnest(string_split(source_text, chr(10))) AS line, generate_subscripts(string_split(source_text, chr(10)), 1) AS line_no FROM manifest_files) SELECT file_id, line_no FROM l WHERE regexp_matches(line, 'Math[.]random|Date[.]now|new Date\\(\\)|randomUUID|time[.]time|os[.]environ')")
def nondet(s, d):
    l = load(s, d, "manifest_files").select("file_id", F.posexplode(F.split("source_text", "\n")).alias("i", "line"))
    return l.where(F.col("line").rlike(r"Math[.]random|Date[.]now|new Date\(\)|randomUUID|time[.]time|os[.]environ")).select("file_id", (F.col("i") + 1).alias("line_no"))


@query("ingestion_failure_stats", "WITH f AS (SELECT project_id, unnest(failed_files) AS f FROM ingestion_results) SELECT f.error AS error, count(*) AS c, count(DISTINCT project_id) AS projects FROM f GROUP BY 1")
def failures(s, d):
    return load(s, d, "ingestion_results").select("project_id", F.explode("failed_files").alias("f")).groupBy(F.col("f.error").alias("error")).agg(F.count(F.lit(1)).alias("c"), F.count_distinct("project_id").alias("projects"))


@query("metadata_json", "SELECT node_type, count(*) AS nodes, count(metadata_json) AS given, count(*) FILTER (json_valid(metadata_json)) AS valid FROM nodes GROUP BY 1")
def metadata(s, d):
    ok = F.try_parse_json("metadata_json").isNotNull()
    return load(s, d, "nodes").groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"), F.count("metadata_json").alias("given"), F.count_if(ok).alias("valid"))
