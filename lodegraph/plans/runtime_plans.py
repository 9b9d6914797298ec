"""Queries over what a running system records: load, limits, caches, queues, prompts, templates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.operators import pipeline
from lodegraph.operators import relational as R
from lodegraph.plans.table_plans import ENTRIES, entries
from lodegraph.runtime import load, union_all

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("pressure_levels", "WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS depth FROM events GROUP BY 1), t AS (SELECT hour, depth, depth / max(depth) OVER () AS r FROM h) SELECT hour, depth, CASE WHEN r >= 1 THEN 'CRITICAL' WHEN r > 0.9 THEN 'HIGH' WHEN r > 0.7 THEN 'ELEVATED' ELSE 'NORMAL' END AS level FROM t")
def pressure_levels(s, d):
    h = load(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("depth"))
    most = F.broadcast(h.agg(F.max("depth").alias("m")))
    r = F.col("depth") / F.col("m")
    return h.join(most, F.col("depth") <= F.col("m")).select("hour", "depth", F.when(r >= 1, "CRITICAL").when(r > 0.9, "HIGH").when(r > 0.7, "ELEVATED").otherwise("NORMAL").alias("level"))


@query("memory_pressure", "WITH u AS (SELECT user_id, sum(value) / 2000 AS r FROM events GROUP BY 1) SELECT user_id, round(r + 1e-9, 4) AS ratio, CASE WHEN r >= 0.9 THEN 'CRITICAL' WHEN r >= 0.75 THEN 'HIGH' WHEN r >= 0.6 THEN 'ELEVATED' ELSE 'NORMAL' END AS level FROM u")
def memory_pressure(s, d):
    r = F.col("r")
    u = load(s, d, "events").groupBy("user_id").agg((F.sum("value") / 2000).alias("r"))
    return u.select("user_id", F.round(r + 1e-9, 4).alias("ratio"), X.steps(r, (0.9, "CRITICAL"), (0.75, "HIGH"), (0.6, "ELEVATED"), other="NORMAL").alias("level"))


@query("rate_limited", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n, sum(value) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events) SELECT event_id, n > 3 OR used > 150 AS limited FROM r")
def rate_limited(s, d):
    w = W.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    e = load(s, d, "events")
    return e.select("event_id", ((F.row_number().over(w) > 3) | (F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)) > 150)).alias("limited"))


@query("ttl_cache", "WITH c AS (SELECT event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS age FROM events) SELECT event_id, coalesce(age <= 86400, false) AS hit FROM c")
def ttl_cache(s, d):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    age = sec - F.lag(sec).over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return load(s, d, "events").select("event_id", F.coalesce(age <= 86400, F.lit(False)).alias("hit"))


@query("dequeue_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS INTEGER) AS place_no FROM events")
def dequeue(s, d):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return load(s, d, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(rank, "ts", "event_id")).alias("place_no"))


@query("incident_summary", "WITH f AS (SELECT project_id, snapshot_status, unnest(failed_files).error AS error FROM ingestion_results) SELECT error, snapshot_status, count(*) AS c, count(DISTINCT project_id) AS projects, count(*) FILTER (snapshot_status <> 'ACTIVE') AS open FROM f GROUP BY GROUPING SETS ((error), (snapshot_status), ())")
def incidents(s, d):
    f = load(s, d, "ingestion_results").select("project_id", "snapshot_status", F.explode("failed_files.error").alias("error"))
    g = f.groupingSets([[F.col("error")], [F.col("snapshot_status")], []], "error", "snapshot_status")
    return g.agg(F.count(F.lit(1)).alias("c"), F.count_distinct("project_id").alias("projects"), F.count_if(F.col("snapshot_status") != "ACTIVE").alias("open")).select("error", "snapshot_status", "c", "projects", "open")


@query("quota_check", "WITH u AS (SELECT project_id, CAST(sum(node_count) AS BIGINT) AS nodes, CAST(sum(edge_count) AS BIGINT) AS edges FROM ingestion_results GROUP BY 1) SELECT project_id, nodes, edges, coalesce(nodes <= 50000 AND edges <= 200000, true) AS allowed FROM u")
def quota(s, d):
    u = load(s, d, "ingestion_results").groupBy("project_id").agg(F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("edges"))
    return u.withColumn("allowed", F.coalesce((F.col("nodes") <= 50_000) & (F.col("edges") <= 200_000), F.lit(True)))


#: What is taken out of prompts, or blocks them: name, pattern, replacement, severity.
PROMPT_RULES = (
    ("prompt_injection", r"(?i)\b(ignore\s+(previous|all)\s+(instructions|directions|commands)|forget\s+all\s+instructions|system\s+prompt|you\s+are\s+a(?:n?\s+(?:helpful\s+)?(?:assistant|ai|chatbot|model))?)\b", "[redacted]", "strip"),
    ("replay_poisoning", r"(?i)(?:\breplay\s*[:=]|\[REPLAY\])\s*.+", "[redacted]", "strip"),
    ("governance_bypass", r"(?i)\b(?:bypass\s+(?:governance|policy|restrictions|controls|security)|override\s+(?:policy|rules|restrictions|safeguards)|ignore\s+policy)\b", "", "block"),
    ("recursive_execution", r"(?i)\b(?:repeat\s+(?:this\s+)?(?:indefinitely|forever|continuously|infinitely|ad\s+nauseam)|loop\s+(?:this\s+)?(?:indefinitely|forever)|recursive\s+(?:call|invocation|execution|prompt|loop))\b", "[redacted]", "strip"),
    ("zero_width_unicode", r"[\x{200B}-\x{200D}\x{FEFF}\x{2060}\x{2061}\x{2062}\x{2063}\x{2064}\x{202A}-\x{202E}\x{FFF9}-\x{FFFB}\x{00AD}]", "", "strip"),
    ("homoglyph_attack", r"[Α-ΡΣ-Ωα-ρσ-ωА-Яа-яЁё]", "", "strip"),
    ("bidirectional_text", r"[\x{202A}\x{202B}\x{202C}\x{202D}\x{202E}\x{2066}\x{2067}\x{2068}\x{2069}\x{200E}\x{200F}]", "", "strip"),
)


def sanitized(text):
    """(text without what the rules take out, whether a rule blocks it)."""
    blocked = F.lit(False)
    out = text
    for _, pattern, put, severity in PROMPT_RULES:
        if severity == "block":
            blocked = blocked | F.coalesce(text.rlike(pattern), F.lit(False))
        out = F.regexp_replace(out, pattern, put)
    return out, blocked


def _prompt_sql() -> str:
    out, blocked = "text", "false"
    for _, pattern, put, severity in PROMPT_RULES:
        if severity == "block":
            blocked = f"coalesce(regexp_matches(text, '{pattern}'), false)"
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return f"SELECT doc_id, length({out}) AS kept_chars, {blocked} AS blocked FROM documents"


@query("sanitized_prompts", _prompt_sql())
def prompts(s, d):
    text, blocked = sanitized(F.col("text"))
    return load(s, d, "documents").select("doc_id", F.char_length(text).cast("bigint").alias("kept_chars"), blocked.alias("blocked"))


def render_sections(template, values: dict, flags: dict):
    """``{{#name}}..{{/name}}`` kept where its flag holds, else left out; then ``{{name}}`` replaced, an empty text for null."""
    for k, on in flags.items():
        body = rf"(?s)\{{\{{#{k}\}}\}}(.*?)\{{\{{/{k}\}}\}}"
        template = F.when(F.coalesce(on, F.lit(False)), F.regexp_replace(template, body, "$1")).otherwise(F.regexp_replace(template, body, ""))
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return F.trim(template)


@query("rendered_templates", ENTRIES + " SELECT id, trim('Entry ' || id || CASE WHEN parent_id <> '' THEN ' under ' || parent_id ELSE '' END || ' in ' || coalesce(category, '')) AS text FROM m")
def templates(s, d):
    t = F.lit("Entry {{id}}{{#nested}} under {{parent}}{{/nested}} in {{category}}")
    return entries(s, d).select("id", render_sections(t, {"id": F.col("id"), "parent": F.col("parent_id"), "category": F.col("category")}, {"nested": F.col("parent_id") != ""}).alias("text"))


@query("merged_windows", ENTRIES + ", w AS (SELECT snapshot_id, category, sum(ceil(length(coalesce(content, '')) / 4)) AS tokens FROM m GROUP BY 1, 2) SELECT snapshot_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS windows, sum(tokens) > 200 AS overflow FROM w GROUP BY 1")
def windows(s, d):
    w = entries(s, d).groupBy("snapshot_id", "category").agg(F.sum(X.token_estimate(F.col("content"))).alias("tokens"))
    return w.groupBy("snapshot_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("windows"), (F.sum("tokens") > 200).alias("overflow"))


@query("selection_modes", ENTRIES + ", r AS (SELECT 'recency' AS mode, category, id, row_number() OVER (PARTITION BY category ORDER BY entry_ts DESC, id) AS r FROM m UNION ALL SELECT 'length', category, id, row_number() OVER (PARTITION BY category ORDER BY length(coalesce(content, '')) DESC, id) FROM m) SELECT mode, category, id FROM r WHERE r <= 5")
def selection(s, d):
    e = entries(s, d).select("id", "category", "entry_ts", F.length(F.coalesce("content", F.lit(""))).alias("size"))
    recent = R.first_per(e, ["category"], [F.col("entry_ts").desc(), F.col("id")], 5).withColumn("mode", F.lit("recency"))
    long = R.first_per(e, ["category"], [F.col("size").desc(), F.col("id")], 5).withColumn("mode", F.lit("length"))
    return union_all([recent, long]).select("mode", "category", "id")


@query("clamped_limits", "SELECT project_id, least(max(node_count), 10000) AS max_nodes, least(max(edge_count), 25000) AS budget FROM ingestion_results GROUP BY 1")
def clamped(s, d):
    return load(s, d, "ingestion_results").groupBy("project_id").agg(F.least(F.max("node_count"), F.lit(10_000)).alias("max_nodes"), F.least(F.max("edge_count"), F.lit(25_000)).alias("budget"))


@query("parallel_branches", "SELECT 'large' AS branch, count(*) AS c FROM manifest_files WHERE size_bytes > 2000 UNION ALL SELECT 'parsed', count(*) FROM manifest_files WHERE should_parse")
def branches(s, d):
    steps = {"large": lambda x: x.where("size_bytes > 2000"), "parsed": lambda x: x.where("should_parse")}
    return pipeline.parallel(load(s, d, "manifest_files").select("size_bytes", "should_parse"), "branch", steps).groupBy("branch").agg(F.count(F.lit(1)).alias("c"))


@query("replay_verify", "SELECT true AS same, count(*) AS entries FROM (SELECT DISTINCT id FROM memory_entries)")
def replay(s, d):
    a, b = entries(s, d).select("id", "category", "fingerprint"), entries(s, d).repartition(5).select("fingerprint", "id", "category")
    return s.createDataFrame([(pipeline.replays(a, b), pipeline.digest(a)[0])], "same boolean, entries bigint")
