"""The queries of the general operators on snapshots, references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import hierarchy, orphans, snapshot_diff
from lodegraph.runtime import load, materialize


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(load(spark, d, "nodes"), load(spark, d, "snapshots"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = materialize(snapshot_diff.consecutive(load(spark, d, "snapshots")), "pairs")
    states = materialize(snapshot_diff.file_states(load(spark, d, "nodes"), pairs), "states")
    counts = snapshot_diff.change_counts(snapshot_diff.merkle_diff(states, pairs, **snapshot_diff.tree_shape(states)), states, pairs)
    return snapshot_diff.check_records(counts, load(spark, d, "snapshot_diffs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_hierarchy(load(spark, d, "memory_entries")).where(F.col("cycle_id").isNotNull()).select("id", "cycle_id")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = hierarchy.resolve_hierarchy(load(spark, d, "memory_entries"), paths=True)
    return paths.select("id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve_hierarchy(load(spark, d, "memory_entries"), paths=True))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references({t: load(spark, d, t) for t in ("edges", "nodes", "snapshots", "evidence_links")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).where(F.col("level") == 0).select("table_name", "row_id", "field_name")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p5_found, p5_paths, p5_descendants, p6_found, p6_report)}

_PAIRS = """
s AS (SELECT DISTINCT id, project_id, version_no FROM snapshots WHERE status IN ('ACTIVE', 'DEGRADED')),
pairs AS (SELECT id AS snapshot_id, lag(id) OVER (PARTITION BY project_id ORDER BY version_no, id) AS base_id FROM s),
newest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS r FROM nodes),
f AS (SELECT snapshot_id, regexp_replace(replace(file_path, '\\', '/'), '^(\\./+)+', '') AS file_path, max(lower(file_hash)) AS h
      FROM newest WHERE r = 1 AND node_type = 'FILE' GROUP BY 1, 2),
cur AS (SELECT p.snapshot_id, f.file_path, f.h FROM pairs p JOIN f ON f.snapshot_id = p.snapshot_id WHERE base_id IS NOT NULL),
old AS (SELECT p.snapshot_id, f.file_path, f.h FROM pairs p JOIN f ON f.snapshot_id = p.base_id),
both_ AS (SELECT coalesce(c.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(c.file_path, o.file_path) AS file_path,
          CASE WHEN o.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'removed'
               WHEN c.h IS DISTINCT FROM o.h THEN 'modified' ELSE 'unchanged' END AS change_kind
          FROM cur c FULL JOIN old o ON c.snapshot_id = o.snapshot_id AND c.file_path = o.file_path)"""

_ORPHANS = """
WITH RECURSIVE e AS (SELECT id, snapshot_id, source_node_id, target_node_id, min(strftime(created_at, '%Y-%m')) AS month FROM edges GROUP BY ALL),
l AS (SELECT id, snapshot_id, edge_id, min(strftime(created_at, '%Y-%m')) AS month FROM evidence_links GROUP BY ALL),
direct AS (
  SELECT 'edges' AS table_name, id AS row_id, 'source_node_id' AS field_name, month FROM e WHERE source_node_id <> ''
    AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.source_node_id AND n.snapshot_id = e.snapshot_id)
  UNION ALL SELECT 'edges', id, 'target_node_id', month FROM e WHERE target_node_id <> ''
    AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.target_node_id AND n.snapshot_id = e.snapshot_id)
  UNION ALL SELECT 'evidence_links', id, 'snapshot_id', month FROM l WHERE snapshot_id <> ''
    AND NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.id = l.snapshot_id)),
once AS (SELECT table_name, row_id, field_name, min(month) AS month, 0 AS level FROM direct GROUP BY 1, 2, 3),
inherited AS (SELECT 'evidence_links' AS table_name, id AS row_id, 'edge_id' AS field_name, min(month) AS month, 1 AS level
  FROM l WHERE edge_id IN (SELECT row_id FROM once WHERE table_name = 'edges') GROUP BY 2),
found AS (SELECT * FROM once UNION ALL SELECT * FROM inherited)
"""

_TREES = """
WITH RECURSIVE cur AS (
  SELECT id, nullif(parent_id, '') AS parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY entry_ts DESC) AS r FROM memory_entries) WHERE r = 1),
tree AS (
  SELECT c.id, c.id AS root_id, CAST(0 AS BIGINT) AS depth, c.id AS path FROM cur c
  WHERE c.parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM cur p WHERE p.id = c.parent_id)
  UNION ALL
  SELECT c.id, t.root_id, t.depth + 1, t.path || '/' || c.id FROM cur c JOIN tree t ON c.parent_id = t.id)
"""

ORACLE = {
    "p2_found": f"WITH {_PAIRS} SELECT snapshot_id, file_path, change_kind FROM both_ WHERE change_kind <> 'unchanged'",
    "p2_counts": f"""WITH {_PAIRS},
counts AS (SELECT p.snapshot_id, p.base_id AS base_snapshot_id, count(*) FILTER (change_kind = 'added') AS added_count,
  count(*) FILTER (change_kind = 'removed') AS removed_count, count(*) FILTER (change_kind = 'modified') AS modified_count,
  count(*) FILTER (change_kind = 'unchanged') AS unchanged_count
  FROM pairs p LEFT JOIN both_ b USING (snapshot_id) WHERE p.base_id IS NOT NULL GROUP BY 1, 2)
SELECT c.snapshot_id, c.base_snapshot_id, c.added_count, c.removed_count, c.modified_count, c.unchanged_count,
  ['missing', 'wrong', 'incomplete', 'ok'][1 + max(CASE WHEN r.snapshot_id IS NULL THEN 0
    WHEN r.added_count = c.added_count AND r.removed_count = c.removed_count AND r.modified_count = c.modified_count AND r.unchanged_count = c.unchanged_count THEN 3
    WHEN r.added_count IS NULL OR r.removed_count IS NULL OR r.modified_count IS NULL OR r.unchanged_count IS NULL THEN 2 ELSE 1 END)] AS verdict
FROM counts c LEFT JOIN snapshot_diffs r USING (snapshot_id, base_snapshot_id) GROUP BY ALL""",
    "p5_found": """
WITH RECURSIVE cur AS (
  SELECT id, nullif(parent_id, '') AS parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY entry_ts DESC) AS r FROM memory_entries) WHERE r = 1),
tree AS (
  SELECT c.id FROM cur c WHERE c.parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM cur p WHERE p.id = c.parent_id)
  UNION ALL SELECT c.id FROM cur c JOIN tree t ON c.parent_id = t.id),
lost AS (SELECT c.id, c.parent_id FROM cur c WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.id = c.id)),
up AS (SELECT id, parent_id AS node FROM lost UNION SELECT u.id, l.parent_id FROM up u JOIN lost l ON l.id = u.node),
loops AS (SELECT id FROM up WHERE id = node)
SELECT u.id, min(u.node) AS cycle_id FROM up u WHERE u.node IN (SELECT id FROM loops) GROUP BY 1""",
    "p5_paths": _TREES + """, lost AS (SELECT id FROM cur WHERE id NOT IN (SELECT id FROM tree))
SELECT id, root_id, depth, path FROM tree UNION ALL SELECT id, NULL, NULL, NULL FROM lost""",
    "p5_descendants": _TREES + """
SELECT p[i] AS ancestor_id, id AS descendant_id, depth + 1 - i AS distance
FROM (SELECT id, depth, p, unnest(range(1, depth + 1)) AS i FROM (SELECT id, depth, string_split(path, '/') AS p FROM tree WHERE depth > 0))""",
    "p6_found": _ORPHANS + "SELECT table_name, row_id, field_name FROM found WHERE level = 0",
    "p6_report": _ORPHANS + """SELECT table_name, field_name, month, count(*) FILTER (level = 0) AS direct_count, count(*) FILTER (level > 0) AS inherited_count
FROM found GROUP BY 1, 2, 3""",
}
