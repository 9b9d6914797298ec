"""Queries that pick, order, summarise and link: retrieval modes, contexts, linkers, rule conditions, reads."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import layers as L
from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G
from lodegraph.operators import relational as R
from lodegraph.plans.table_plans import CAT, ENTRIES, FAN, INSIGHTS, LAYER, PAIRS, _sides, entries, fans, insights
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


N, E = S.nodes, S.edges


@query("ordering_modes", S.SQL + FAN + """, m AS (SELECT 'fan_in' AS mode, snapshot_id, id, fan_in AS k FROM fan UNION ALL SELECT 'fan_out', snapshot_id, id, fan_out FROM fan UNION ALL SELECT 'total', snapshot_id, id, fan_in + fan_out FROM fan)
SELECT mode, snapshot_id, id, CAST(row_number() OVER (PARTITION BY mode, snapshot_id ORDER BY k DESC, id) AS INTEGER) AS rank_no FROM m QUALIFY row_number() OVER (PARTITION BY mode, snapshot_id ORDER BY k DESC, id) <= 5""")
def modes(s, d):
    m = fans(s, d).select("snapshot_id", "id", F.explode(F.array(*[F.struct(F.lit(n).alias("mode"), F.col(c).alias("k")) for n, c in (("fan_in", "fan_in"), ("fan_out", "fan_out"), ("total", "total"))])).alias("x")).select("snapshot_id", "id", "x.mode", "x.k")
    r = F.row_number().over(W.partitionBy("mode", "snapshot_id").orderBy(F.col("k").desc(), "id"))
    return m.withColumn("rank_no", r).where("rank_no <= 5").select("mode", "snapshot_id", "id", "rank_no")


@query("dynamic_predicates", "SELECT id FROM snapshots WHERE status IN ('ACTIVE', 'DEGRADED') AND compression_ratio >= 0.5 AND is_frozen IS NOT NULL")
def predicates(s, d):
    given = {"status": ["ACTIVE", "DEGRADED"], "least_ratio": 0.5, "known": "is_frozen", "project": None}
    conds = [F.col("status").isin(*given["status"]), F.col("compression_ratio") >= given["least_ratio"], F.col(given["known"]).isNotNull()]
    if given["project"]:
        conds.append(F.col("project_id") == given["project"])
    return load(s, d, "snapshots").where(reduce(and_, conds)).select("id")


@query("severity_at_least", INSIGHTS + " SELECT ref, category FROM ins WHERE severity IN ('HIGH', 'CRITICAL')")
def at_least(s, d):
    order = ["LOW", "MODERATE", "HIGH", "CRITICAL"]
    return insights(s, d).where(F.array_position(F.array(*map(F.lit, order)), F.col("severity")) >= order.index("HIGH") + 1).select("ref", "category")


@query("insights_by_scope_cube", INSIGHTS + " SELECT category, severity, count(*) AS c FROM ins GROUP BY CUBE (category, severity)")
def cube(s, d):
    return insights(s, d).cube("category", "severity").agg(F.count(F.lit(1)).alias("c"))


@query("language_by_extension", r"""WITH f AS (SELECT file_id, lower(regexp_extract(file_path, '(\.[^./\\]*)$', 1)) AS ext FROM manifest_files)
SELECT file_id, CASE WHEN ext IN ('.ts', '.mts', '.cts') THEN 'TypeScript' WHEN ext = '.tsx' THEN 'TSX' WHEN ext IN ('.js', '.mjs', '.cjs') THEN 'JavaScript' WHEN ext = '.jsx' THEN 'JSX' WHEN ext = '.py' THEN 'Python' WHEN ext = '.rs' THEN 'Rust' WHEN ext = '.go' THEN 'Go'
 WHEN ext = '.java' THEN 'Java' WHEN ext = '.rb' THEN 'Ruby' WHEN ext = '.php' THEN 'PHP' WHEN ext IN ('.c', '.h') THEN 'C' WHEN ext IN ('.cpp', '.cc', '.cxx', '.hpp') THEN 'Cpp' WHEN ext = '.cs' THEN 'CSharp' WHEN ext = '.swift' THEN 'Swift' WHEN ext IN ('.kt', '.kts') THEN 'Kotlin'
 WHEN ext = '.scala' THEN 'Scala' WHEN ext IN ('.yaml', '.yml') THEN 'Yaml' WHEN ext IN ('.json', '.json5', '.jsonc') THEN 'Json' WHEN ext = '.toml' THEN 'Toml' WHEN ext IN ('.md', '.mdx') THEN 'Markdown' WHEN ext IN ('.sh', '.bash', '.zsh') THEN 'Shell' WHEN ext = '.sql' THEN 'Sql'
 WHEN ext = '.asm' THEN 'Assembly' WHEN ext = '.proto' THEN 'Protobuf' WHEN ext IN ('.graphql', '.gql') THEN 'GraphQL' WHEN ext IN ('.tf', '.tfvars') THEN 'Terraform' END AS language FROM f""")
def lang(s, d):
    return load(s, d, "manifest_files").select("file_id", X.language_of(X.normal_path(F.col("file_path"))).alias("language"))


@query("manifest_consistency", "SELECT f.file_id, f.sha256 IS NOT NULL AND n.h IS NOT NULL AND lower(f.sha256) <> n.h AS differs, n.h IS NULL AS unhashed FROM (SELECT file_id, snapshot_id, sha256, regexp_replace(replace(file_path, '\\', '/'), '^(\\./+)+', '') AS p FROM manifest_files) f LEFT JOIN (SELECT snapshot_id, p, max(h) AS h FROM (SELECT snapshot_id, regexp_replace(replace(file_path, '\\', '/'), '^(\\./+)+', '') AS p, lower(file_hash) AS h FROM nodes WHERE node_type = 'FILE') GROUP BY 1, 2) n ON n.snapshot_id = f.snapshot_id AND n.p = f.p")
def consistency(s, d):
    h = load(s, d, "nodes").where("node_type = 'FILE'").groupBy("snapshot_id", X.normal_path(F.col("file_path")).alias("p")).agg(F.max(F.lower("file_hash")).alias("h"))
    f = load(s, d, "manifest_files").select("file_id", "snapshot_id", "sha256", X.normal_path(F.col("file_path")).alias("p"))
    differs = F.col("sha256").isNotNull() & F.col("h").isNotNull() & (F.lower("sha256") != F.col("h"))
    return f.join(h, ["snapshot_id", "p"], "left").select("file_id", F.coalesce(differs, F.lit(False)).alias("differs"), F.col("h").isNull().alias("unhashed"))


@query("execution_frontier", S.SQL + ", done AS (SELECT id FROM n WHERE node_type <> 'FILE') SELECT n.id, CASE WHEN n.id IN (SELECT id FROM done) THEN 'done' WHEN count(ge.dst) FILTER (ge.dst NOT IN (SELECT id FROM done)) = 0 THEN 'ready' ELSE 'blocked' END AS state FROM n LEFT JOIN ge ON ge.src = n.id GROUP BY n.id")
def frontier(s, d):
    n = N(s, d)
    done = n.where("node_type <> 'FILE'").select("id", F.lit(True).alias("done"))
    waits = S.known_edges(s, d).join(done.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id")).distinct().withColumn("waits", F.lit(True))
    return n.select("id").join(done, "id", "left").join(waits, "id", "left").select("id", F.when(F.col("done"), "done").when(F.col("waits"), "blocked").otherwise("ready").alias("state"))


@query("provenance_links", ENTRIES + " SELECT id, first(id) OVER (PARTITION BY provenance_id ORDER BY id) AS hub, count(*) OVER (PARTITION BY provenance_id) AS members FROM m WHERE provenance_id IS NOT NULL")
def prov_links(s, d):
    m = entries(s, d).where("provenance_id IS NOT NULL")
    hub = m.groupBy("provenance_id").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("members"))
    return m.select("id", "provenance_id").join(hub, "provenance_id").select("id", "hub", "members")


@query("namespace_links", S.SQL + ", h AS (SELECT snapshot_id, namespace, min(id) AS hub FROM n WHERE node_type = 'FILE' GROUP BY 1, 2 HAVING count(*) > 1) SELECT n.id, h.hub FROM n JOIN h USING (snapshot_id, namespace) WHERE n.node_type = 'FILE' AND n.id <> h.hub")
def ns_links(s, d):
    f = N(s, d).where("node_type = 'FILE'")
    h = f.groupBy("snapshot_id", "namespace").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return f.join(h, ["snapshot_id", "namespace"]).where("id <> hub").select("id", "hub")


@query("simple_propagation", S.SQL + FAN + " SELECT id, round(least(1, (0.6e0 * fan_in + 0.4e0 * fan_out) / count(*) OVER (PARTITION BY snapshot_id) * 2), 4) AS risk FROM fan")
def simple_prop(s, d):
    v = F.count(F.lit(1)).over(W.partitionBy("snapshot_id"))
    return fans(s, d).select("id", F.round(F.least(F.lit(1.0), (F.col("fan_in") * 0.6 + F.col("fan_out") * 0.4) / v * 2), 4).alias("risk"))


@query("infra_vs_business", S.SQL + f", l AS (SELECT snapshot_id, {LAYER} AS layer FROM n WHERE node_type = 'FILE'), c AS (SELECT snapshot_id, count(*) FILTER (layer IN ('INFRASTRUCTURE', 'DATA_LAYER', 'CONFIGURATION', 'BUILD_SYSTEM')) AS i, count(*) FILTER (layer IN ('DOMAIN_LAYER', 'SERVICE_LAYER')) AS b FROM l GROUP BY 1) SELECT snapshot_id, i AS infra, b AS business, CASE WHEN i + b = 0 THEN 'unknown' WHEN (i - b) / (i + b) > 0.1 THEN 'infrastructure' WHEN (i - b) / (i + b) < -0.1 THEN 'business' ELSE 'mixed' END AS kind FROM c")
def infra_business(s, d):
    l = L.layer(F.col("file_path"))
    c = N(s, d).where("node_type = 'FILE'").groupBy("snapshot_id").agg(F.count_if(l.isin("INFRASTRUCTURE", "DATA_LAYER", "CONFIGURATION", "BUILD_SYSTEM")).alias("infra"), F.count_if(l.isin("DOMAIN_LAYER", "SERVICE_LAYER")).alias("business"))
    r = F.try_divide(F.col("infra") - F.col("business"), F.col("infra") + F.col("business"))
    return c.withColumn("kind", F.when(r.isNull(), "unknown").when(r > 0.1, "infrastructure").when(r < -0.1, "business").otherwise("mixed"))


@query("diff_metrics", PAIRS + """, f AS (SELECT snapshot_id, file_path, max(file_hash) AS h FROM n WHERE node_type = 'FILE' GROUP BY 1, 2), j AS (SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, a.file_path IS NOT NULL AS was, b.file_path IS NOT NULL AS now, a.h IS NOT DISTINCT FROM b.h AS same
FROM (SELECT p.snapshot_id, file_path, h FROM f JOIN pairs p ON p.base_id = f.snapshot_id) a FULL JOIN (SELECT f.* FROM f JOIN pairs p USING (snapshot_id) WHERE base_id IS NOT NULL) b ON a.snapshot_id = b.snapshot_id AND a.file_path = b.file_path)
SELECT snapshot_id, round(count(*) FILTER (was AND now AND same) / count(*), 4) AS reuse_ratio, round(count(*) FILTER (NOT (was AND now AND same)) / count(*), 4) AS change_ratio FROM j GROUP BY 1""")
def diff_metrics(s, d):
    f = N(s, d).where("node_type = 'FILE'").groupBy("snapshot_id", "file_path").agg(F.max("file_hash").alias("h"))
    old, new = _sides(s, d, f)
    j = R.keyed_diff(old, new, ["snapshot_id", "file_path"], "h")
    same = F.count_if(F.col("kind") == "unchanged")
    return j.groupBy("snapshot_id").agg(F.round(same / F.count(F.lit(1)), 4).alias("reuse_ratio"), F.round((F.count(F.lit(1)) - same) / F.count(F.lit(1)), 4).alias("change_ratio"))


@query("invalidated_modules", PAIRS + """, f AS (SELECT snapshot_id, file_path, module, max(file_hash) AS h FROM n WHERE node_type = 'FILE' GROUP BY 1, 2, 3) SELECT DISTINCT b.snapshot_id, b.module FROM f b JOIN pairs p USING (snapshot_id) LEFT JOIN f a ON a.snapshot_id = p.base_id AND a.file_path = b.file_path WHERE p.base_id IS NOT NULL AND (a.file_path IS NULL OR a.h IS DISTINCT FROM b.h)""")
def invalidated(s, d):
    f = N(s, d).where("node_type = 'FILE'").groupBy("snapshot_id", "file_path", "module").agg(F.max("file_hash").alias("h"))
    old, new = _sides(s, d, f)
    o = old.select("snapshot_id", "file_path", F.col("h").alias("oh"), F.lit(True).alias("was"))
    return new.join(o, ["snapshot_id", "file_path"], "left").where(F.col("was").isNull() | ~F.col("h").eqNullSafe(F.col("oh"))).select("snapshot_id", "module").distinct()


@query("lineage_previous", "WITH s AS (SELECT DISTINCT id, project_id, version_no, status FROM snapshots) SELECT id, lag(id) OVER (PARTITION BY project_id ORDER BY version_no) AS previous_id, first(id) OVER (PARTITION BY project_id ORDER BY version_no) AS root_id FROM s")
def lineage(s, d):
    w = W.partitionBy("project_id").orderBy("version_no")
    return load(s, d, "snapshots").select("id", "project_id", "version_no", "status").distinct().select("id", F.lag("id").over(w).alias("previous_id"), F.first("id").over(w).alias("root_id"))


@query("unreachable_from_first", S.SQL + ", w AS (SELECT id, id AS m FROM n UNION SELECT w.id, s.t FROM w JOIN (SELECT src AS f, dst AS t FROM ge UNION SELECT dst, src FROM ge) s ON s.f = w.m), c AS (SELECT id, min(m) AS c FROM w GROUP BY 1) SELECT n.id FROM n JOIN c USING (id) WHERE c.c <> (SELECT min(k.id) FROM n k WHERE k.snapshot_id = n.snapshot_id)")
def unreachable(s, d):
    n = materialize(N(s, d), "nodes")
    c = G.weak_components(n, S.known_edges(s, d, n), "snapshot_id")
    first = n.groupBy("snapshot_id").agg(F.min("id").alias("first"))
    return n.select("id", "snapshot_id").join(c, "id").join(first, "snapshot_id").where("component <> first").select("id")


@query("file_contexts", S.SQL + ", t AS (SELECT snapshot_id, file_path, node_type, symbol_name FROM n WHERE symbol_name IS NOT NULL) SELECT snapshot_id, file_path, count(*) AS symbols, array_to_string(list(symbol_name ORDER BY symbol_name), ',') AS names FROM t GROUP BY 1, 2")
def file_contexts(s, d):
    t = N(s, d).where("symbol_name IS NOT NULL").groupBy("snapshot_id", "file_path").agg(F.count(F.lit(1)).alias("symbols"), F.array_sort(F.collect_list("symbol_name")).alias("l"))
    return t.select("snapshot_id", "file_path", "symbols", F.array_join("l", ",").alias("names"))


@query("top_symbols_per_module", "WITH h AS (SELECT DISTINCT snapshot_id, symbol_id, symbol_name, centrality_score, array_to_string(string_split(file_path, '/')[1:2], '/') AS module FROM high_value_symbols WHERE centrality_score IS NOT NULL AND NOT isnan(centrality_score)) SELECT module, symbol_id, centrality_score FROM h QUALIFY row_number() OVER (PARTITION BY module ORDER BY centrality_score DESC, symbol_name, symbol_id, snapshot_id) <= 10")
def top_module(s, d):
    h = load(s, d, "high_value_symbols").where("centrality_score IS NOT NULL AND NOT isnan(centrality_score)").select("snapshot_id", "symbol_id", "symbol_name", "centrality_score", F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/").alias("module")).distinct()
    return R.first_per(h, ["module"], [F.col("centrality_score").desc(), F.col("symbol_name"), F.col("symbol_id"), F.col("snapshot_id")], 10).select("module", "symbol_id", "centrality_score")


@query("retrieval_weight", S.SQL + FAN + " SELECT id, round(0.3e0 * least(1, fan_in / 10) + 0.25e0 * CASE WHEN fan_in + fan_out > 0 THEN fan_out / (fan_in + fan_out) ELSE 0 END + 0.2e0 * (fan_in + fan_out) / greatest(fan_in, fan_out, 1), 4) AS weight FROM fan")
def rweight(s, d):
    f = fans(s, d)
    w = F.least(F.lit(1.0), F.col("fan_in") / 10) * 0.3 + F.coalesce(F.try_divide(F.col("fan_out"), F.col("total")), F.lit(0.0)) * 0.25 + F.col("total") * 0.2 / F.greatest("fan_in", "fan_out", F.lit(1))
    return f.select("id", F.round(w, 4).alias("weight"))


@query("must_include_then_fill", ENTRIES + " SELECT id FROM (SELECT id, category FROM m) ORDER BY (category = 'architecture') DESC, id LIMIT 60")
def must(s, d):
    return entries(s, d).orderBy((F.col("category") == "architecture").desc(), "id").limit(60).select("id")


@query("slice_keep_30_percent", S.SQL + ", r AS (SELECT snapshot_id, id, row_number() OVER (PARTITION BY snapshot_id ORDER BY id) AS r, count(*) OVER (PARTITION BY snapshot_id) AS k FROM n) SELECT snapshot_id, id FROM r WHERE r <= ceil(0.3e0 * k)")
def keep30(s, d):
    w = W.partitionBy("snapshot_id")
    r = N(s, d).select("snapshot_id", "id", F.row_number().over(w.orderBy("id")).alias("r"), F.count(F.lit(1)).over(w).alias("k"))
    return r.where(F.col("r") <= F.ceil(F.col("k") * 0.3)).select("snapshot_id", "id")


@query("rule_conditions", S.SQL + FAN + """, x AS (SELECT snapshot_id, avg(fan_in + fan_out) AS mean, max(fan_in + fan_out) AS top, count(*) AS v FROM fan GROUP BY 1) SELECT snapshot_id, 'high-mean-degree' AS rule FROM x WHERE mean > 1.5 UNION ALL SELECT snapshot_id, 'hub-present' FROM x WHERE top >= 10 UNION ALL SELECT snapshot_id, 'small-and-dense' FROM x WHERE v < 50 AND mean > 1""")
def rule_conditions(s, d):
    x = fans(s, d).groupBy("snapshot_id").agg(F.avg("total").alias("mean"), F.max("total").alias("top"), F.count(F.lit(1)).alias("v"))
    rules = {"high-mean-degree": [F.col("mean") > 1.5], "hub-present": [F.col("top") >= 10], "small-and-dense": [F.col("v") < 50, F.col("mean") > 1]}
    hit = F.array_compact(F.array(*[F.when(reduce(and_, c), F.lit(n)) for n, c in rules.items()]))
    return x.select("snapshot_id", F.explode(hit).alias("rule"))


@query("category_weights", INSIGHTS + " SELECT category, count(*) AS c, CAST(CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CAT.items()) + " END AS DOUBLE) AS weight FROM ins GROUP BY 1")
def weights(s, d):
    return insights(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("c")).withColumn("weight", X.lookup(CAT, F.col("category")))


@query("checkpoint_compare", "WITH u AS (SELECT id, fingerprint, row_number() OVER (PARTITION BY id ORDER BY entry_ts) AS r, count(*) OVER (PARTITION BY id) AS k FROM (SELECT DISTINCT id, fingerprint, entry_ts FROM memory_entries)), a AS (SELECT id, fingerprint FROM u WHERE r = 1), b AS (SELECT id, fingerprint FROM u WHERE r = k) SELECT 'added' AS kind, id, fingerprint FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', id, fingerprint FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def compare(s, d):
    u = load(s, d, "memory_entries").select("id", "fingerprint", "entry_ts").distinct()
    a = u.groupBy("id").agg(F.min_by("fingerprint", "entry_ts").alias("fingerprint"))
    b = u.groupBy("id").agg(F.max_by("fingerprint", "entry_ts").alias("fingerprint"))
    return union_all([b.subtract(a).withColumn("kind", F.lit("added")), a.subtract(b).withColumn("kind", F.lit("removed"))])


@query("orphan_free_edge_weights", S.SQL + " SELECT edge_type, count(*) AS c, round(avg(weight), 6) AS mean_weight, count(*) FILTER (weight IS NULL) AS unweighted FROM ge GROUP BY 1")
def edge_weights(s, d):
    return S.known_edges(s, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("c"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.count_if(F.col("weight").isNull()).alias("unweighted"))
