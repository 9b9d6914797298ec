"""Queries that retrieve: weighted rankings, slices and contexts, memory retrieval, semantic and compression diffs, roles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import layers as L
from lodegraph.operators import context as C
from lodegraph.operators import graph as G
from lodegraph.operators import relational as R
from lodegraph.plans import graph_plans as P
from lodegraph.plans import table_plans as T
from lodegraph.plans.core import ORACLE as CORE
from lodegraph.plans.graph_plans import ORACLE as GSQL
from lodegraph.plans.table_plans import ENTRIES, LAYER, PAIRS, _sides, entries
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


NODES = f"({S.SQL} SELECT * FROM n)"


# weighted rankings --------------------------------------------------------------------------------------------------
def _ranked(df, score, k=20):
    return R.first_per(df, ["snapshot_id"], [F.col(score).desc(), F.col("id")], k)


@query("metric_weighted_rank", f"SELECT id, snapshot_id, score FROM {q('centrality')} QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, id) <= 20")
def metric_rank(s, d):
    return _ranked(P.central(s, d), "score").select("id", "snapshot_id", "score")


@query("risk_weighted_rank", f"SELECT r.id, snapshot_id, pressure FROM {q('propagation_risk')} r JOIN {NODES} n ON n.id = r.id QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY pressure DESC, r.id) <= 20")
def risk_rank(s, d):
    return _ranked(P.risk(s, d).join(N(s, d).select("id", "snapshot_id"), "id"), "pressure").select("id", "snapshot_id", "pressure")


@query("semantic_weighted_rank", f"WITH l AS (SELECT id, snapshot_id, {LAYER} AS layer FROM {NODES}), w AS (SELECT id, snapshot_id, CAST({T.IMPORTANCE} AS INTEGER) AS weight FROM l) SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY weight DESC, id) <= 20")
def semantic_rank(s, d):
    return _ranked(N(s, d).select("id", "snapshot_id", L.importance(L.layer(F.col("file_path"))).alias("weight")), "weight")


CONTEXT_IMPORTANCE = "CASE layer WHEN 'API_LAYER' THEN 10 WHEN 'SERVICE_LAYER' THEN 9 WHEN 'DOMAIN_LAYER' THEN 8 WHEN 'DATA_LAYER' THEN 7 WHEN 'SECURITY' THEN 6 WHEN 'OBSERVABILITY' THEN 5 WHEN 'INFRASTRUCTURE' THEN 4 WHEN 'SHARED_UTILITY' THEN 3 WHEN 'CONFIGURATION' THEN 2 WHEN 'TESTING' THEN 1 WHEN 'BUILD_SYSTEM' THEN 1 ELSE 0 END"
EXTENDED = f"""nn AS MATERIALIZED {NODES}, cen AS MATERIALIZED {q('centrality')}, pr AS MATERIALIZED {q('propagation_risk')}, ins AS MATERIALIZED {q('instability')}, sc AS MATERIALIZED {q('strong_components')}, fm AS MATERIALIZED {q('fan_metrics')}, bf AS MATERIALIZED {q('bfs_forward')},
big AS (SELECT component FROM sc GROUP BY 1 HAVING count(*) > 1), near AS (SELECT node AS id, min(depth) AS depth FROM bf GROUP BY 1),
l AS (SELECT id, snapshot_id, namespace, {LAYER} AS layer FROM nn), home AS (SELECT n.snapshot_id, min(n.namespace) AS namespace FROM bf JOIN nn n ON n.id = bf.seed GROUP BY 1),
x AS (SELECT l.id, l.snapshot_id, 0.15e0 * cen.score + 0.15e0 * CASE WHEN near.depth IS NULL THEN 0 WHEN near.depth > 0 THEN 1 / (near.depth + 1) ELSE 1 END + ({CONTEXT_IMPORTANCE}) / 10 * 0.15e0 + 0.15e0 * pr.pressure + 0.1e0 * ins.instability
 + 0.1e0 * CASE WHEN fan_in + fan_out > 0 THEN fan_out / (fan_in + fan_out) ELSE 0 END + 0.1e0 * CASE WHEN sc.component IN (SELECT component FROM big) THEN 1 ELSE 0 END + 0.05e0 * CASE WHEN fan_in + fan_out >= 15 THEN 1 ELSE 0 END
 + 0.05e0 * CASE WHEN home.namespace = l.namespace THEN 1 ELSE 0 END AS score
 FROM l JOIN cen USING (id) JOIN pr USING (id) JOIN ins USING (id) JOIN sc USING (id) JOIN fm USING (id) LEFT JOIN near USING (id) LEFT JOIN home ON home.snapshot_id = l.snapshot_id)"""


def _extended(s, d):
    """(id, snapshot_id, score): the nine-factor score of every node, seen from its snapshot's seed."""
    g = P.Shared(s, d)
    n = g.graph[0]
    near = materialize(P.bfs_forward(s, d, g), "near")
    home = near.select(F.col("seed").alias("id")).distinct().join(n.select("id", "snapshot_id", "namespace"), "id").groupBy("snapshot_id").agg(F.min("namespace").alias("home"))
    sc = P.scc(s, d, g)
    big = sc.groupBy("component").count().where("count > 1").select("component", F.lit(1.0).alias("cyclic"))
    cyclic = sc.join(big, "component", "left").select("id", F.coalesce("cyclic", F.lit(0.0)).alias("cyclic"))
    depth = near.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))
    fan = P.fan_metrics(s, d, g).select("id", F.coalesce(F.try_divide(F.col("fan_out"), F.col("total")), F.lit(0.0)).alias("fan_ratio"), (F.col("total") >= 15).cast("double").alias("hotspot"))
    x = n.select("id", "snapshot_id", "namespace", (L.context_importance(L.layer(F.col("file_path"))) / 10).alias("semantic"))
    x = x.join(P.central(s, d, g).select("id", F.col("score").alias("centrality")), "id").join(P.risk(s, d, g).select("id", F.col("pressure").alias("risk")), "id").join(P.instab(s, d, g).select("id", "instability"), "id")
    x = x.join(cyclic, "id").join(fan, "id").join(depth, "id", "left").join(home, "snapshot_id", "left")
    x = x.withColumn("proximity", F.when(F.col("depth") > 0, 1 / (F.col("depth") + 1)).when(F.col("depth") == 0, 1.0)).withColumn("architecture", (F.col("home") == F.col("namespace")).cast("double"))
    return x.select("id", "snapshot_id", F.round(C.extended_score(x) + 1e-9, 4).alias("score"))


@query("extended_score", f"WITH {EXTENDED} SELECT id, snapshot_id, round(score + 1e-9, 4) AS score FROM x")
def extended(s, d):
    return _extended(s, d)


@query("assembled_context", f"WITH {EXTENDED}, r AS (SELECT id, snapshot_id, round(score + 1e-9, 4) AS score FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, id) AS r FROM r) SELECT id, snapshot_id, score, r * 20 AS used FROM o WHERE r * 20 <= 400")
def assembled(s, d):
    return C.assemble(_extended(s, d), "snapshot_id", "score", "id", 400)


@query("critical_propagation_paths", f"SELECT b.seed AS source, b.node AS target, pressure AS risk FROM {q('bfs_forward')} b JOIN {q('propagation_risk')} p ON p.id = b.node WHERE b.node <> b.seed AND pressure > 0.5")
def critical(s, d):
    g = P.Shared(s, d)
    b = P.bfs_forward(s, d, g).where("node <> seed")
    return b.join(P.risk(s, d, g).where("pressure > 0.5").select(F.col("id").alias("node"), "pressure"), "node").select(F.col("seed").alias("source"), F.col("node").alias("target"), F.col("pressure").alias("risk"))


@query("chain_risk", f"SELECT b.seed, count(*) AS nodes, max(depth) AS reached, round(sum(pressure), 4) AS total_risk FROM {q('bfs_forward')} b JOIN {q('propagation_risk')} p ON p.id = b.node GROUP BY 1")
def chain_risk(s, d):
    g = P.Shared(s, d)
    b = P.bfs_forward(s, d, g).join(P.risk(s, d, g).select(F.col("id").alias("node"), "pressure"), "node")
    return b.groupBy("seed").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("reached"), F.round(F.sum("pressure"), 4).alias("total_risk"))


# slices -------------------------------------------------------------------------------------------------------------
SLICES = f"""nn AS MATERIALIZED {NODES}, bf AS MATERIALIZED {q('bfs_forward')}, bl AS MATERIALIZED {q('blast_radius')}, ins AS {q('instability')}, sc AS MATERIALIZED {q('strong_components')}, lay AS (SELECT id, snapshot_id, {LAYER} AS layer FROM nn),
sl AS (SELECT DISTINCT snapshot_id, kind, id FROM (SELECT n.snapshot_id, 'chain' AS kind, bf.node AS id FROM bf JOIN nn n ON n.id = bf.seed UNION ALL SELECT n.snapshot_id, 'blast', bl.node FROM bl JOIN nn n ON n.id = bl.seed
 UNION ALL SELECT snapshot_id, 'domain', id FROM lay WHERE layer = 'DOMAIN_LAYER' UNION ALL SELECT snapshot_id, 'infra', id FROM lay WHERE layer = 'INFRASTRUCTURE' UNION ALL SELECT snapshot_id, 'hotspot', id FROM nn JOIN ins USING (id) WHERE instability >= 0.5
 UNION ALL SELECT snapshot_id, 'cyclic', id FROM nn JOIN sc USING (id) WHERE component IN (SELECT component FROM sc GROUP BY 1 HAVING count(*) > 1)))"""


def _slices(s, d, g=None):
    """(snapshot_id, kind, node): the nodes of each slice of each snapshot."""
    g = g or P.Shared(s, d)
    n = g.graph[0]
    at = n.select("id", "snapshot_id")
    seed = at.withColumnRenamed("id", "seed")
    sc = P.scc(s, d, g)
    cyc = sc.join(sc.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi")
    lay = n.select("id", "snapshot_id", L.layer(F.col("file_path")).alias("layer"))
    row = lambda df, kind, node="id": df.select("snapshot_id", F.lit(kind).alias("kind"), F.col(node).alias("node"))
    return materialize(union_all([
        row(P.bfs_forward(s, d, g).join(seed, "seed"), "chain", "node"),
        row(P.blast(s, d, g).join(seed, "seed"), "blast", "node"),
        row(lay.where("layer = 'DOMAIN_LAYER'"), "domain"),
        row(lay.where("layer = 'INFRASTRUCTURE'"), "infra"),
        row(P.instab(s, d, g).where("instability >= 0.5").join(at, "id"), "hotspot"),
        row(cyc.join(at, "id"), "cyclic"),
    ]).distinct(), "slices")


@query("context_slices", f"WITH {SLICES} SELECT snapshot_id, kind, count(*) AS node_count, count(*) * 20 AS tokens FROM sl GROUP BY 1, 2")
def slices(s, d):
    return C.slice_digests(_slices(s, d), ["snapshot_id", "kind"]).select("snapshot_id", "kind", "node_count", "tokens")


@query("slice_dedupe", f"WITH {SLICES}, g AS (SELECT snapshot_id, kind, list(id ORDER BY id) AS ids FROM sl GROUP BY 1, 2) SELECT snapshot_id, min(kind) AS kind, len(ids) AS node_count, len(ids) * 20 AS tokens, count(*) AS copies FROM g GROUP BY snapshot_id, ids")
def dedupe(s, d):
    return C.dedupe_slices(_slices(s, d), "snapshot_id", "kind")


@query("slice_similarity", f"WITH {SLICES}, k AS (SELECT snapshot_id, kind, count(*) AS n FROM sl GROUP BY 1, 2), c AS (SELECT a.snapshot_id, a.kind AS a, b.kind AS b, count(*) AS common FROM sl a JOIN sl b ON a.snapshot_id = b.snapshot_id AND a.id = b.id AND a.kind < b.kind GROUP BY 1, 2, 3) SELECT c.snapshot_id, c.a, c.b, common, round(common / (x.n + y.n - common), 4) AS similarity FROM c JOIN k x ON x.snapshot_id = c.snapshot_id AND x.kind = c.a JOIN k y ON y.snapshot_id = c.snapshot_id AND y.kind = c.b WHERE common / (x.n + y.n - common) >= 0.5")
def similarity(s, d):
    return C.set_similarity(_slices(s, d), "snapshot_id", "kind", 0.5)


@query("semantic_redundancy", f"WITH {SLICES}, w AS {q('weak_components')}, k AS (SELECT snapshot_id, kind, min(w.component) AS region, count(*) AS node_count FROM sl JOIN w USING (id) GROUP BY 1, 2) SELECT snapshot_id, region, kind, node_count FROM k QUALIFY row_number() OVER (PARTITION BY snapshot_id, region ORDER BY node_count DESC, kind) = 1")
def redundancy(s, d):
    g = P.Shared(s, d)
    w = P.wcc(s, d, g).select(F.col("id").alias("node"), "component")
    k = _slices(s, d, g).join(w, "node").groupBy("snapshot_id", "kind").agg(F.min("component").alias("region"), F.count(F.lit(1)).alias("node_count"))
    return C.one_per_region(k, "snapshot_id", "region", [F.col("node_count").desc(), F.col("kind")]).select("snapshot_id", "region", "kind", "node_count")


@query("semantic_cluster_slice", S.SQL + f", l AS (SELECT id, snapshot_id, {LAYER} AS layer FROM n) SELECT e.id, a.layer FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst WHERE a.layer = b.layer AND a.layer <> 'UNKNOWN'")
def cluster_slice(s, d):
    l = N(s, d).select("id", L.layer(F.col("file_path")).alias("layer")).where("layer <> 'UNKNOWN'")
    e = S.edges(s, d).join(l.select(F.col("id").alias("src"), "layer"), "src").join(l.select(F.col("id").alias("dst"), F.col("layer").alias("to")), "dst")
    return e.where(F.col("layer") == F.col("to")).select("id", "layer")


@query("repository_context", S.SQL + """, f AS (SELECT snapshot_id, count(*) FILTER (node_type = 'FILE') AS files, count(*) FILTER (node_type <> 'FILE') AS symbols, count(DISTINCT module) AS modules, list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)) AS languages FROM n GROUP BY 1), d AS (SELECT snapshot_id, count(*) AS deps FROM e GROUP BY 1)
SELECT snapshot_id, files, symbols, modules, coalesce(deps, 0) AS dependencies, coalesce(languages, []) AS languages, files || ' files in ' || modules || ' modules with ' || symbols || ' symbols and ' || coalesce(deps, 0) || ' dependencies' AS summary FROM f LEFT JOIN d USING (snapshot_id)""")
def repo_context(s, d):
    f = N(s, d).groupBy("snapshot_id").agg(F.count_if(F.col("node_type") == "FILE").alias("files"), F.count_if(F.col("node_type") != "FILE").alias("symbols"), F.count_distinct("module").alias("modules"), F.sort_array(F.collect_set("language")).alias("languages"))  # as many as there are languages
    x = f.join(S.edges(s, d).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("dependencies")), "snapshot_id", "left").fillna(0, ["dependencies"])
    return x.select("snapshot_id", "files", "symbols", "modules", "dependencies", "languages", F.format_string("%d files in %d modules with %d symbols and %d dependencies", "files", "modules", "symbols", "dependencies").alias("summary"))


# roles --------------------------------------------------------------------------------------------------------------
ROLE = r"""CASE WHEN regexp_matches(file_path, '/routes?/|\broutes?/|\bapi\b|/controllers?/|[.]controller[.]') THEN 'API_LAYER' WHEN regexp_matches(file_path, '/services?/|[.]service[.]') THEN 'SERVICE_LAYER' WHEN regexp_matches(file_path, '/repositories?/|/daos?/|/databases?/|/models?/') THEN 'DATA_LAYER'
 WHEN regexp_matches(file_path, '/domain/|/entities?/|/aggregates?/') THEN 'DOMAIN_LAYER' WHEN regexp_matches(file_path, '/infrastructure/|/adapters?/|/providers?/') THEN 'INFRASTRUCTURE' WHEN regexp_matches(file_path, '/components?/|/pages?/|/views?/|/ui/|[.](tsx|jsx)$') THEN 'UI_LAYER'
 WHEN regexp_matches(file_path, '/config/|[.]config[.]|[.]env[.]') THEN 'CONFIGURATION' WHEN regexp_matches(file_path, '[.](test|spec|e2e|integration)[.]|/__tests__/|/__mocks__/|/fixtures?/') THEN 'TESTING' WHEN regexp_matches(file_path, '/middleware/|[.]middleware[.]') THEN 'INFRASTRUCTURE'
 WHEN regexp_matches(file_path, '/utils?/|/helpers?/|/lib/|/shared/') THEN 'SHARED_UTILITY' WHEN regexp_matches(file_path, '/(build|dist|scripts?)/|[.]dockerfile|\bDockerfile\b') THEN 'BUILD_SYSTEM' WHEN regexp_matches(file_path, '/auth/|/guards?/|/security/') THEN 'SECURITY'
 WHEN regexp_matches(file_path, '/logging/|/monitoring/|/telemetry/|/tracing/') THEN 'OBSERVABILITY' WHEN regexp_matches(file_path, '/migrations?/') THEN 'DATA_LAYER' WHEN regexp_matches(file_path, '/graphql/|/resolvers?/|/schemas?/') THEN 'API_LAYER' ELSE 'UNKNOWN' END"""


@query("file_roles", S.SQL + f" SELECT id, {ROLE} AS role FROM n WHERE node_type = 'FILE'")
def roles(s, d):
    return N(s, d).where("node_type = 'FILE'").select("id", L.role(F.col("file_path")).alias("role"))


@query("module_roles", S.SQL + f", r AS (SELECT snapshot_id, module, {ROLE} AS role FROM n WHERE node_type = 'FILE'), k AS (SELECT snapshot_id, module, role, count(*) AS k, sum(count(*)) OVER (PARTITION BY snapshot_id, module) AS t FROM r GROUP BY 1, 2, 3) SELECT snapshot_id, module, role, k AS files, CASE WHEN k / t >= 0.8 THEN 'HIGH' WHEN k / t >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS strength FROM k QUALIFY row_number() OVER (PARTITION BY snapshot_id, module ORDER BY k DESC, role) = 1")
def module_roles(s, d):
    k = N(s, d).where("node_type = 'FILE'").groupBy("snapshot_id", "module", L.role(F.col("file_path")).alias("role")).agg(F.count(F.lit(1)).alias("files"))
    best = k.groupBy("snapshot_id", "module").agg(F.min(F.struct((-F.col("files")).alias("n"), "role")).alias("m"), F.sum("files").alias("t"))
    return best.select("snapshot_id", "module", F.col("m.role").alias("role"), (-F.col("m.n")).alias("files"), L.ratio_strength(-F.col("m.n"), F.col("t")).alias("strength"))


@query("infra_business_paths", S.SQL + r""" SELECT id, regexp_matches(file_path, '/config/|/middleware/|/adapters?/|/providers?/|/infrastructure/|/db/|/databases?/|/migrations?/|/logger/|/logging/|/queue/|/workers?/|/transport/|/gateways?/') AS infrastructure,
regexp_matches(file_path, '/domain/|/services?/|/orchestrators?/|/use-cases?/|/business/|/workflows?/|/state-machines?/|/entities?/|/aggregates?/|/value-objects?/|/validators?/|/rules?/|/policies?/') AS business FROM n WHERE node_type = 'FILE'""")
def paths(s, d):
    p = F.col("file_path")
    return N(s, d).where("node_type = 'FILE'").select("id", L.is_infrastructure(p).alias("infrastructure"), L.is_business(p).alias("business"))


@query("node_layers_with_imports")
def layered(s, d):
    """Layer by path and by imported frameworks: imports win where they are stronger (3 or more of one layer: 3, 2: 2, else 1)."""
    from lodegraph.plans.ingest_plans import _items, files

    f = files(s, d).select("snapshot_id", "file_path").distinct().withColumn("by_path", L.layer(F.col("file_path")))
    i = _items(s, d).where("item = 'import'").select("snapshot_id", "file_path", "line_no", L.framework(F.col("source")).alias("kind"), "source").distinct().where("kind IS NOT NULL")
    k = i.groupBy("snapshot_id", "file_path", "kind").agg(F.count(F.lit(1)).alias("k"))
    best = k.groupBy("snapshot_id", "file_path").agg(F.min(F.struct((-F.col("k")).alias("n"), "kind")).alias("m"))
    x = f.join(best, ["snapshot_id", "file_path"], "left")
    heard = F.least(-F.col("m.n"), F.lit(3))
    wins = F.col("m").isNotNull() & ((F.col("by_path") == "UNKNOWN") | (heard > L.strength_of(F.col("file_path"), F.col("by_path"))))
    return x.select("snapshot_id", "file_path", F.when(wins, F.col("m.kind")).otherwise(F.col("by_path")).alias("layer"), wins.alias("by_imports"))


# diffs of contexts --------------------------------------------------------------------------------------------------
@query("semantic_diff", PAIRS + """, md AS (SELECT snapshot_id, module, list_sort(list(DISTINCT file_path)) AS files FROM n WHERE node_type = 'FILE' GROUP BY 1, 2), dp AS (SELECT ge.snapshot_id, a.module, list_sort(list(DISTINCT b.module)) AS deps FROM ge JOIN n a ON a.id = ge.src JOIN n b ON b.id = ge.dst WHERE a.module <> b.module GROUP BY 1, 2),
c AS (SELECT md.snapshot_id, md.module, files, coalesce(deps, []) AS deps FROM md LEFT JOIN dp USING (snapshot_id, module)), o AS (SELECT p.snapshot_id, module, files, deps FROM c JOIN pairs p ON p.base_id = c.snapshot_id), w AS (SELECT c.* FROM c JOIN pairs p USING (snapshot_id) WHERE base_id IS NOT NULL)
SELECT coalesce(o.snapshot_id, w.snapshot_id) AS snapshot_id, coalesce(o.module, w.module) AS module, CASE WHEN o.module IS NULL THEN 'added' WHEN w.module IS NULL THEN 'removed' WHEN o.files <> w.files OR o.deps <> w.deps THEN 'changed' ELSE 'unchanged' END AS kind FROM o FULL JOIN w ON o.snapshot_id = w.snapshot_id AND o.module = w.module""")
def semantic_diff(s, d):
    n, e = P._graph(s, d)
    f = n.where("node_type = 'FILE'").select("snapshot_id", "module", F.col("file_path").alias("x"), F.lit("f").alias("what"))
    a, b = n.select(F.col("id").alias("src"), "module"), n.select(F.col("id").alias("dst"), F.col("module").alias("x"))
    dep = e.join(a, "src").join(b, "dst").where(F.col("module") != F.col("x")).select("snapshot_id", "module", "x", F.lit("d").alias("what"))
    return _set_diff(s, d, f.unionByName(dep.join(f.select("snapshot_id", "module").distinct(), ["snapshot_id", "module"], "left_semi")), "module", "changed")


def _set_diff(s, d, parts, key, word):
    """(snapshot_id, key, kind) by order-free digests of what belongs to each key, so no set is gathered."""
    h = F.xxhash64("what", "x")
    g = parts.distinct().groupBy("snapshot_id", key).agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("a"), F.sum(F.xxhash64(F.lit(2), "x", "what").bitwiseAND(F.lit(0x7FFFFFFF))).alias("b")).alias("h"))
    old, new = _sides(s, d, g)
    return R.keyed_diff(old, new, ["snapshot_id", key], "h").withColumn("kind", F.when(F.col("kind") == "modified", word).otherwise(F.col("kind")))


@query("compression_diff", PAIRS + """, c AS (SELECT snapshot_id, file_path, list_sort(list(DISTINCT node_type || ':' || coalesce(symbol_name, ''))) AS parts FROM n GROUP BY 1, 2), o AS (SELECT p.snapshot_id, file_path, parts FROM c JOIN pairs p ON p.base_id = c.snapshot_id), w AS (SELECT c.* FROM c JOIN pairs p USING (snapshot_id) WHERE base_id IS NOT NULL)
SELECT coalesce(o.snapshot_id, w.snapshot_id) AS snapshot_id, coalesce(o.file_path, w.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN w.file_path IS NULL THEN 'removed' WHEN o.parts <> w.parts THEN 'changed' ELSE 'unchanged' END AS kind FROM o FULL JOIN w ON o.snapshot_id = w.snapshot_id AND o.file_path = w.file_path""")
def compression_diff(s, d):
    parts = N(s, d).select("snapshot_id", "file_path", F.concat_ws(":", "node_type", F.coalesce("symbol_name", F.lit(""))).alias("x"), F.lit("p").alias("what"))
    return _set_diff(s, d, parts, "file_path", "changed")


# memory -------------------------------------------------------------------------------------------------------------
MEMORY = ENTRIES.replace("WITH m", "WITH RECURSIVE m", 1) + """, sd AS (SELECT id, provenance_id FROM m WHERE category = 'architecture' AND contains(lower(content), 'blast radius')), li AS (SELECT id AS f, parent_id AS t FROM m WHERE parent_id <> '' AND parent_id IN (SELECT id FROM m) UNION SELECT parent_id, id FROM m WHERE parent_id <> '' AND parent_id IN (SELECT id FROM m)),
w AS (SELECT id, 0 AS depth FROM sd UNION SELECT li.t, w.depth + 1 FROM w JOIN li ON li.f = w.id WHERE w.depth < 2), near AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1)"""


def _near(s, d):
    m = materialize(entries(s, d), "entries")
    seeds = materialize(m.where((F.col("category") == "architecture") & F.lower("content").contains("blast radius")), "seeds")
    links = m.where("parent_id <> ''").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    links = links.join(m.select(F.col("id").alias("dst")), "dst", "left_semi")
    near = G.bfs(links, seeds.select(F.lit("").alias("seed"), F.col("id").alias("node")), 2, "both").select(F.col("node").alias("id"), "depth")
    return m, seeds, near


@query("memory_retrieval", MEMORY + " SELECT m.id, m.category, near.depth FROM near JOIN m USING (id) WHERE m.entry_ts >= TIMESTAMP '2023-01-01'")
def memory(s, d):
    m, _, near = _near(s, d)
    return m.join(near, "id").where(F.col("entry_ts") >= F.lit("2023-01-01").cast("timestamp_ntz")).select("id", "category", "depth")


@query("memory_five_factor_score", MEMORY + """ SELECT m.id, round(0.3e0 / (1 + near.depth) + 0.25e0 * CASE WHEN m.provenance_id IN (SELECT provenance_id FROM sd) THEN 0.8 ELSE 0 END + 0.2e0 * CASE WHEN contains(m.category, 'architecture') THEN 0.5 ELSE 0 END
 + 0.15e0 * ((CASE WHEN contains(lower(m.content), 'blast') THEN 1 ELSE 0 END + CASE WHEN contains(lower(m.content), 'cycle') THEN 1 ELSE 0 END) / 2) + 0.1e0 * CASE m.category WHEN 'orchestration' THEN 1.0 WHEN 'execution' THEN 0.8 ELSE 0.2 END, 4) AS score FROM near JOIN m USING (id)""")
def five_factors(s, d):
    m, seeds, near = _near(s, d)
    line = seeds.where("provenance_id IS NOT NULL").select("provenance_id", F.lit(0.8).alias("lineage")).distinct()
    x = m.join(near, "id").join(line, "provenance_id", "left")
    text = F.lower("content")
    said = lambda w: F.coalesce(text.contains(w), F.lit(False)).cast("int")
    kind = F.when(F.col("category") == "orchestration", 1.0).when(F.col("category") == "execution", 0.8).otherwise(0.2)
    place = F.when(F.col("category").contains("architecture"), 0.5).otherwise(0.0)
    score = 0.3 / (F.col("depth") + 1) + F.coalesce("lineage", F.lit(0.0)) * 0.25 + place * 0.2 + (said("blast") + said("cycle")) / 2 * 0.15 + kind * 0.1
    return x.select("id", F.round(score, 4).alias("score"))


@query("memory_by_namespace", ENTRIES + ", t AS (SELECT snapshot_id, category, count(*) AS entries, count(DISTINCT provenance_id) AS sources, min(entry_ts) AS first_ts, max(entry_ts) AS last_ts FROM m GROUP BY 1, 2) SELECT * FROM t")
def memory_ns(s, d):
    return entries(s, d).groupBy("snapshot_id", "category").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("provenance_id").alias("sources"), F.min("entry_ts").alias("first_ts"), F.max("entry_ts").alias("last_ts"))


@query("memory_lineage", "SELECT descendant_id AS id, ancestor_id, distance FROM (" + CORE["p5_descendants"] + ")")
def lineage(s, d):
    """Every ancestor of each entry, with its distance."""
    from lodegraph.operators import hierarchy

    return hierarchy.descendants(hierarchy.resolve_hierarchy(load(s, d, "memory_entries"), paths=True)).select(F.col("descendant_id").alias("id"), "ancestor_id", "distance")


@query("provenance_filter", ENTRIES + " SELECT id, provenance_id FROM m WHERE provenance_id BETWEEN 'prv_1000' AND 'prv_4999' AND category <> 'evolution' AND entry_ts < TIMESTAMP '2024-06-01' AND parent_id IS NOT NULL ORDER BY entry_ts DESC, id LIMIT 100")
def provenance(s, d):
    c = F.col("provenance_id").between("prv_1000", "prv_4999") & (F.col("category") != "evolution") & (F.col("entry_ts") < F.lit("2024-06-01").cast("timestamp_ntz")) & F.col("parent_id").isNotNull()
    return entries(s, d).where(c).orderBy(F.col("entry_ts").desc(), "id").limit(100).select("id", "provenance_id")


@query("stable_edge_order", S.SQL + ", r AS (SELECT id, snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY src, dst, edge_type, id) AS r FROM e) SELECT id, snapshot_id, CAST(r AS INTEGER) AS place_no FROM r")
def edge_order(s, d):
    return S.edges(s, d).select("id", "snapshot_id", F.row_number().over(W.partitionBy("snapshot_id").orderBy("src", "dst", "edge_type", "id")).alias("place_no"))


@query("evolution_summary", "WITH d AS (SELECT DISTINCT snapshot_id, base_snapshot_id, added_count, removed_count, modified_count FROM snapshot_diffs) SELECT diff.project_id, count(*) AS diffs, CAST(sum(added_count) AS BIGINT) AS added, CAST(sum(removed_count) AS BIGINT) AS removed, CAST(sum(modified_count) AS BIGINT) AS modified FROM d JOIN (SELECT DISTINCT id, project_id FROM snapshots) diff ON diff.id = d.snapshot_id GROUP BY 1")
def evolution(s, d):
    x = load(s, d, "snapshot_diffs").select("snapshot_id", "base_snapshot_id", "added_count", "removed_count", "modified_count").distinct()
    p = load(s, d, "snapshots").select(F.col("id").alias("snapshot_id"), "project_id").distinct()
    return x.join(p, "snapshot_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("diffs"), F.sum("added_count").alias("added"), F.sum("removed_count").alias("removed"), F.sum("modified_count").alias("modified"))
