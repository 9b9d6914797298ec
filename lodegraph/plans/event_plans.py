"""Queries over event logs and queues."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.operators import relational as R
from lodegraph.runtime import load

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("events_by_type_paged", "SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def paged(s, d):
    return load(s, d, "events").where("event_type = 'click'").orderBy(F.col("ts").desc(), "event_id").offset(100).limit(50).select("event_id", "ts", "event_type")


@query("event_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly(s, d):
    return load(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("event_retention", "SELECT count(*) AS kept, min(ts) AS oldest FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(s, d):
    e = load(s, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAY")).agg(F.count(F.lit(1)).alias("kept"), F.min("ts").alias("oldest"))


@query("event_transitions", "WITH t AS (SELECT event_type AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) SELECT before, after, count(*) AS c FROM t WHERE after IS NOT NULL GROUP BY 1, 2")
def markov(s, d):
    t = load(s, d, "events").select(F.col("event_type").alias("before"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("after"))
    return t.where("after IS NOT NULL").groupBy("before", "after").agg(F.count(F.lit(1)).alias("c"))


@query("claim_next_job", "SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def claim(s, d):
    return R.first_per(load(s, d, "orders").where("o_orderstatus = 'O'"), ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderpriority", "o_orderkey")


@query("audit_summary", "SELECT event_type, count(*) AS c, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def audit(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("c"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("failure_actions", """WITH f AS (SELECT unnest(failed_files).error AS error FROM ingestion_results) SELECT error, count(*) AS c, CASE WHEN contains(lower(error), 'timeout') THEN 'RETRY' WHEN contains(lower(error), 'crash') THEN 'RESTART' WHEN contains(lower(error), 'expected') OR contains(lower(error), 'unexpected') OR contains(lower(error), 'unterminated') THEN 'SKIP' ELSE 'ESCALATE' END AS action FROM f GROUP BY 1, 3""")
def actions(s, d):
    e = F.lower("error")
    act = F.when(e.contains("timeout"), "RETRY").when(e.contains("crash"), "RESTART").when(e.contains("expected") | e.contains("unexpected") | e.contains("unterminated"), "SKIP").otherwise("ESCALATE")
    return load(s, d, "ingestion_results").select(F.explode("failed_files.error").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("c")).withColumn("action", act)


@query("running_allocation", "SELECT event_id, round(sum(value) OVER w, 4) AS used, round(max(value) OVER w, 4) AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return load(s, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("used"), F.round(F.max("value").over(w), 4).alias("peak"))


@query("retry_backoff", "SELECT DISTINCT parse_failed AS attempt, CAST(least(1000 * pow(2, parse_failed), 16000) AS BIGINT) AS wait_ms FROM ingestion_results WHERE parse_failed IS NOT NULL")
def backoff(s, d):
    return load(s, d, "ingestion_results").where("parse_failed IS NOT NULL").select(F.col("parse_failed").alias("attempt"), X.backoff_ms(F.col("parse_failed")).alias("wait_ms")).distinct()


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props(s, d):
    return load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("determinism_audit", "WITH u AS (SELECT DISTINCT id, fingerprint FROM memory_entries) SELECT id, count(*) AS versions FROM u GROUP BY 1 HAVING count(*) > 1")
def determinism(s, d):
    return load(s, d, "memory_entries").select("id", "fingerprint").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


@query("order_check", "WITH t AS (SELECT snapshot_id, created_at < lag(created_at) OVER (PARTITION BY snapshot_id ORDER BY id) AS broken FROM edges) SELECT snapshot_id, count(*) FILTER (broken) AS out_of_order FROM t GROUP BY 1")
def order_check(s, d):
    t = load(s, d, "edges").withColumn("broken", F.col("created_at") < F.lag("created_at").over(W.partitionBy("snapshot_id").orderBy("id")))
    return t.groupBy("snapshot_id").agg(F.count_if("broken").alias("out_of_order"))


@query("health_worst", "WITH r AS (SELECT project_id, max(CASE snapshot_status WHEN 'FAILED' THEN 3 WHEN 'DEGRADED' THEN 2 WHEN 'PENDING' THEN 1 ELSE 0 END) AS k FROM ingestion_results GROUP BY 1) SELECT project_id, ['healthy', 'starting', 'degraded', 'unhealthy'][k + 1] AS health FROM r")
def health(s, d):
    k = F.when(F.col("snapshot_status") == "FAILED", 3).when(F.col("snapshot_status") == "DEGRADED", 2).when(F.col("snapshot_status") == "PENDING", 1).otherwise(0)
    return load(s, d, "ingestion_results").groupBy("project_id").agg(F.max(k).alias("k")).select("project_id", F.element_at(F.array(*map(F.lit, ["healthy", "starting", "degraded", "unhealthy"])), F.col("k") + 1).alias("health"))


@query("redacted_metadata", "SELECT id, regexp_replace(metadata_json, '(?i)(\"?(?:password|secret|token|api_?key|authorization)\"?\\s*[:=]\\s*)(\"[^\"]*\"|[^\\s,}]+)', '\\1[REDACTED]', 'g') AS metadata FROM nodes WHERE metadata_json IS NOT NULL")
def redacted(s, d):
    return load(s, d, "nodes").where("metadata_json IS NOT NULL").select("id", X.redact_keys(F.col("metadata_json")).alias("metadata"))


@query("lineitem_pivot", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS o_qty, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS f_qty FROM lineitem GROUP BY 1")
def pivot(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity")).na.fill(0).select("l_returnflag", F.col("O").alias("o_qty"), F.col("F").alias("f_qty"))
