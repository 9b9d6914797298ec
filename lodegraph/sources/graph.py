"""The version graph as clean DataFrames: one row per node and edge, one spelling of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.scalars import module_path, namespace, normal_path
from lodegraph.runtime import latest, load


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, snapshot_id, file_path, file_hash, node_type, symbol_name, language, namespace, module): the last delivery of each node."""
    rows = latest(load(spark, d, "nodes"), "id", "created_at", "snapshot_id", "file_path", "file_hash", "node_type", "symbol_name", "language")
    path = normal_path(F.col("file_path"))
    return rows.select("id", "snapshot_id", path.alias("file_path"), F.lower("file_hash").alias("file_hash"), "node_type", "symbol_name", F.lower("language").alias("language")).withColumn("namespace", namespace(F.col("file_path"))).withColumn("module", module_path(F.col("file_path")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(id, snapshot_id, src, dst, edge_type, weight): each edge once, edges with a null or empty end left out."""
    rows = load(spark, d, "edges").where((F.col("source_node_id") != "") & (F.col("target_node_id") != ""))
    return rows.groupBy("id", "snapshot_id", F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), "edge_type").agg(F.max("weight").alias("weight"))


def known_edges(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """The edges both of whose ends are nodes (``known``, else those of the folder) of their snapshot."""
    n = (nodes(spark, d) if known is None else known).select("id", "snapshot_id")
    e = edges(spark, d)
    e = e.join(n.withColumnRenamed("id", "src"), ["src", "snapshot_id"], "left_semi")
    return e.join(n.withColumnRenamed("id", "dst"), ["dst", "snapshot_id"], "left_semi").select("id", "snapshot_id", "src", "dst", "edge_type", "weight")


SQL = r"""WITH RECURSIVE
n AS (SELECT id, snapshot_id, file_path, file_hash, node_type, symbol_name, language,
        CASE WHEN instr(file_path, '/') = 0 THEN 'root' ELSE regexp_replace(file_path, '/[^/]*$', '') END AS namespace,
        array_to_string(string_split(file_path, '/')[1:CASE WHEN len(string_split(file_path, '/')) <= 2 THEN 1 ELSE 2 END], '/') AS module
      FROM (SELECT id, snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS file_path, lower(file_hash) AS file_hash,
                   node_type, symbol_name, lower(language) AS language, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS r FROM nodes) WHERE r = 1),
e AS (SELECT id, snapshot_id, source_node_id AS src, target_node_id AS dst, edge_type, max(weight) AS weight
      FROM edges WHERE source_node_id <> '' AND target_node_id <> '' GROUP BY 1, 2, 3, 4, 5),
ge AS (SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.id = e.src AND n.snapshot_id = e.snapshot_id)
                           AND EXISTS (SELECT 1 FROM n WHERE n.id = e.dst AND n.snapshot_id = e.snapshot_id))"""
