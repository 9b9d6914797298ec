"""Queries of ingestion: what the files' texts import, export and declare, and the graph built from that."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.runtime import load, materialize
from lodegraph.sources import code

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


FILES = r"""WITH f AS (SELECT file_id, snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS file_path, classification, language, size_bytes FROM manifest_files)"""


def files(s, d):
    return load(s, d, "manifest_files").withColumn("file_path", X.normal_path(F.col("file_path")))


def _items(s, d):
    return materialize(code.extract_items(files(s, d)), "items")


def _resolved(items, f):
    wanted = items.where("item = 'import' OR item = 'export' AND source IS NOT NULL")
    return materialize(code.resolve_imports(wanted, f), "resolved")


@query("extracted_imports")
def imports(s, d):
    return _items(s, d).where("item = 'import'").select("snapshot_id", "file_path", "name", "source", "is_default", "is_namespace", "line_no")


@query("extracted_exports")
def exports(s, d):
    return _items(s, d).where("item = 'export'").select("snapshot_id", "file_path", "name", "source", "symbol_type", "is_default", "line_no")


@query("extracted_symbols")
def symbols(s, d):
    return _items(s, d).where("item = 'symbol'").select("snapshot_id", "file_path", "name", "symbol_type", "exported", "is_async", "line_no")


@query("resolved_imports")
def resolved(s, d):
    return _resolved(_items(s, d), files(s, d))


@query("export_owners")
def owners(s, d):
    i = _items(s, d)
    return code.symbol_owners(i.where("item = 'import'"), i.where("item = 'export'"), _resolved(i, files(s, d)))


@query("built_nodes")
def built_nodes(s, d):
    return _build(s, d)[0]


@query("built_edges")
def built_edges(s, d):
    return _build(s, d)[1]


def _build(s, d):
    f, i = files(s, d), _items(s, d)
    return code.build_graph(f.withColumn("file_hash", F.lower("sha256")), i, _resolved(i, f))


@query("parse_statistics", """SELECT snapshot_id, count(*) FILTER (should_parse AND source_text IS NOT NULL) AS total, count(*) FILTER (should_parse AND source_text <> '') AS given, count(*) FILTER (NOT should_parse) AS skipped FROM manifest_files GROUP BY 1""")
def parse_statistics(s, d):
    m = load(s, d, "manifest_files")
    return m.groupBy("snapshot_id").agg(F.count_if(F.col("should_parse") & F.col("source_text").isNotNull()).alias("total"), F.count_if(F.col("should_parse") & (F.col("source_text") != "")).alias("given"), F.count_if(~F.col("should_parse")).alias("skipped"))


@query("content_types", FILES + r""", x AS (SELECT file_id, lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+(\.[^.]*)$', 1)) AS e FROM f)
SELECT file_id, CASE e WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' WHEN '.jsx' THEN 'jsx' WHEN '.json' THEN 'json' WHEN '.yaml' THEN 'yaml' WHEN '.yml' THEN 'yaml'
 WHEN '.toml' THEN 'toml' WHEN '.md' THEN 'markdown' WHEN '.mdx' THEN 'markdown' WHEN '.html' THEN 'html' WHEN '.css' THEN 'css' WHEN '.scss' THEN 'scss' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.rs' THEN 'rust'
 WHEN '.sh' THEN 'shell' WHEN '.sql' THEN 'sql' WHEN '.proto' THEN 'protobuf' WHEN '.tf' THEN 'terraform' WHEN '.svg' THEN 'svg' WHEN '.txt' THEN 'text' ELSE 'unknown' END AS content_type FROM x""")
def content_types(s, d):
    return files(s, d).select("file_id", X.content_type(F.col("file_path")).alias("content_type"))
