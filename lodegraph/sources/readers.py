"""Archives, folders and tables in; partitioned tables out."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.scalars import entry_depth, extension, file_class, path_status, relevance
from lodegraph.runtime import ship

#: What a folder scan leaves out.
IGNORED_FOLDERS = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".cache", "__pycache__", "venv", ".venv", "target")
DANGEROUS_EXTENSIONS = (".exe", ".dll", ".so", ".dylib", ".bat", ".cmd", ".com", ".msi", ".scr", ".ps1", ".vbs")


def archive_entries(spark: SparkSession, path: str, max_files: int = 50_000, max_bytes: int = 1 << 30, max_depth: int = 20) -> DataFrame:
    """(archive, path, size_bytes, content, status) for every file entry of the ZIP archives under ``path``.

    ``status`` is OK, ABSOLUTE, TRAVERSAL, DANGEROUS, LIMIT or CORRUPT; only OK
    entries carry content.  Limits count per archive in entry order, entries
    that are refused don't count.  An unreadable archive gives one CORRUPT row.
    """
    ship(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                files = used = 0
                try:
                    z = zipfile.ZipFile(io.BytesIO(data))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(name, None, None, None, "CORRUPT")], columns=["archive", "path", "size_bytes", "content", "status"])
                    continue
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    over = files + 1 > max_files or used + info.file_size > max_bytes or info.filename.strip("/").count("/") > max_depth
                    body = None
                    if not over:
                        try:
                            body = z.read(info)
                        except (zipfile.BadZipFile, RuntimeError, OSError):
                            body = None
                        files, used = files + 1, used + info.file_size
                    yield pd.DataFrame([(name, info.filename, info.file_size, body, "LIMIT" if over else "OK" if body is not None else "CORRUPT")], columns=["archive", "path", "size_bytes", "content", "status"])

    rows = raw.mapInPandas(unpack, "archive string, path string, size_bytes bigint, content binary, status string")
    unsafe = path_status(F.col("path"))
    status = F.when(F.col("status") == "OK", F.coalesce(unsafe, F.lit("OK"))).otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn("content", F.when(F.col("status") == "OK", F.col("content")))


def folder_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, content) of the files under ``path``, ignored folders, hidden files and dangerous kinds left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(kept(F.col("path"))).select("path", F.col("length").alias("size_bytes"), "content")


def kept(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    return ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS))) & ~name.startswith(".") & ~extension(path).isin(*DANGEROUS_EXTENSIONS)


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, size_bytes, classification, relevance, should_parse) of files with content, by path."""
    kind = file_class(F.col("path"))
    rows = files.where(F.col("content").isNotNull()).select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size_bytes"), kind.alias("classification"), entry_depth(F.col("path")).alias("depth"))
    score = relevance(F.col("path"), F.col("classification"))
    return rows.withColumn("relevance", score).withColumn("should_parse", score >= 0.3)


def repository_hash(rows: DataFrame) -> DataFrame:
    """One row: the hash of all file hashes in path order, folded by ranges of paths so that no task holds all."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches) or [pd.DataFrame(columns=["path", "sha256"])])
        if len(whole):
            whole = whole.sort_values("path")
            yield pd.DataFrame({"first": [whole["path"].iloc[0]], "text": ["".join(whole["sha256"])], "n": [len(whole)]})

    parts = rows.select("path", "sha256").repartitionByRange("path").mapInPandas(part, "first string, text string, n bigint").orderBy("first")
    digest, n = hashlib.sha256(), 0
    for r in parts.toLocalIterator():  # one range at a time
        digest.update(r["text"].encode())
        n += r["n"]
    return rows.sparkSession.createDataFrame([(digest.hexdigest(), n)], "repository_hash string, files bigint")


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str, frozen: tuple[str, ...] = ()) -> None:
    """Writes both tables by snapshot; refuses snapshots that are ACTIVE or FAILED already."""
    if frozen and not nodes.where(F.col("snapshot_id").isin(*frozen)).isEmpty():
        raise ValueError("a snapshot that is ACTIVE or FAILED can't be written again")
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.repartition("snapshot_id").write.mode("append").partitionBy("snapshot_id").parquet(f"{folder}/{name}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric records of more than LOW priority."""
    metrics.where(F.col("priority") != "LOW").write.mode("append").parquet(path)


def write_by_snapshot(df: DataFrame, path: str) -> None:
    """A table of contexts, insights, findings, diffs or lineage, a folder per snapshot; a snapshot written again replaces itself only.

    Rows without a snapshot go to a folder of their own.
    """
    spread = df.repartition("snapshot_id", F.pmod(F.xxhash64(*df.columns), F.lit(8)))  # a large snapshot is eight tasks
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def delete_snapshots(spark: SparkSession, path: str, ids: list[str]) -> int:
    """Removes the folders of some snapshots from a table of :func:`write_by_snapshot`; returns how many there were."""
    jvm, gone = spark.sparkContext._jvm, 0
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for i in ids:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot_id={escape(i)}")
        gone += bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
    return gone


def point_lookup(df: DataFrame, ids: list[str], column: str = "id") -> DataFrame:
    """The rows of some ids; the filter reaches the scan, so files whose statistics exclude them are not read."""
    return df.where(F.col(column).isin(*ids))


def delete_older(df: DataFrame, column: str, days: int, now: str) -> DataFrame:
    """Rows that a retention of so many days keeps."""
    return df.where(F.col(column) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def canonical_json(df: DataFrame) -> DataFrame:
    """(json): one text per row with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))
