"""What changed between full snapshots: Merkle digests top-down, rows last.

Every snapshot's keys fall into ``fan ** depth`` hash ranges.  A leaf's digest
combines its rows, a parent's digest its children.  Two snapshots are compared
root first; only below digests that differ does the comparison go on, and rows
are diffed only in leaves whose digests differ.  Unchanged ranges move no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.runtime import latest, materialize

COMPLETE = ("ACTIVE", "DEGRADED")


def relative_path(path: Column) -> Column:
    """One spelling per relative path: ``/`` as separator, no leading ``./``; letter case stays."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./+)+", "")


def consecutive(snapshots: DataFrame, complete: tuple[str, ...] = COMPLETE) -> DataFrame:
    """(snapshot_id, base_id): each complete snapshot and the complete one next below in its project.

    Repeated rows count once; rows without id, project or version take no part;
    a version that names two snapshots is ordered by id.
    """
    rows = (
        snapshots.where(F.col("status").isin(*complete))
        .where(F.col("id").isNotNull() & F.col("project_id").isNotNull() & F.col("version_no").isNotNull())
        .select("id", "project_id", "version_no")
        .distinct()
    )
    before = F.lag("id").over(W.partitionBy("project_id").orderBy("version_no", "id"))
    return rows.select(F.col("id").alias("snapshot_id"), before.alias("base_id"), "project_id", "version_no")


def file_states(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, file_path, file_hash) of FILE nodes: last delivery of each node id, one spelling of paths and hashes.

    Two nodes of one path in one snapshot leave the greatest hash.  ``wanted``
    (snapshot_id) narrows the result to some snapshots, after the last delivery
    is chosen: an id corrected into another snapshot counts there only.
    """
    rows = latest(nodes, "id", "created_at", "snapshot_id", "file_path", "file_hash", "node_type")
    rows = rows.where((F.col("node_type") == "FILE") & F.col("snapshot_id").isNotNull() & F.col("file_path").isNotNull())
    if wanted is not None:
        rows = rows.join(wanted.select("snapshot_id"), "snapshot_id", "left_semi")
    return rows.groupBy("snapshot_id", relative_path(F.col("file_path")).alias("file_path")).agg(F.max(F.lower("file_hash")).alias("file_hash"))


def tree_shape(states: DataFrame, fan: int = 16, leaf_rows: int = 64) -> dict[str, int]:
    """Fan and depth of the tree at which a leaf of the average snapshot holds some ``leaf_rows`` rows."""
    n, snaps = states.agg(F.count(F.lit(1)), F.approx_count_distinct("snapshot_id")).first()
    depth, leaves = 1, fan
    while snaps and leaves * leaf_rows < n / snaps and depth < 6:
        depth, leaves = depth + 1, leaves * fan
    return {"fan": fan, "depth": depth}


def merkle_diff(states: DataFrame, pairs: DataFrame, fan: int = 16, depth: int = 2) -> DataFrame:
    """(snapshot_id, file_path, change_kind) for each pair (snapshot_id, base_id).

    ``states``: (snapshot_id, file_path, file_hash), unique by the first two.
    Digests are two independent 64-bit hashes, combined by xor and by wrapping
    sum beside the row count.  A pair without base_id gives nothing; a base
    without rows makes every path added.  Empty tables give an empty result.
    """
    leaves = fan**depth
    tagged = states.withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), "file_path"), F.lit(leaves)))
    one = F.xxhash64("file_path", "file_hash", F.col("file_hash").isNull())
    two = F.xxhash64(F.lit(1), "file_hash", "file_path").bitwiseAND(F.lit(0x7FFFFFFF))
    digests = [materialize(tagged.groupBy("snapshot_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(two).alias("s")), "leaf")]
    for _ in range(depth):
        up = digests[-1].groupBy("snapshot_id", F.floor(F.col("bucket") / fan).alias("bucket"))
        digests.append(up.agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")))
    open_ = pairs.where(F.col("base_id").isNotNull()).select("snapshot_id", "base_id", F.lit(0).cast("bigint").alias("bucket"))
    for level in range(depth, -1, -1):
        # each side of a pair asks for its digest; a missing digest means an empty range
        sides = open_.select("snapshot_id", "base_id", "bucket", F.explode(F.array(F.struct(F.col("snapshot_id").alias("of"), F.lit(1).alias("sign")), F.struct(F.col("base_id").alias("of"), F.lit(-1).alias("sign")))).alias("_s"))
        sides = sides.select("snapshot_id", "base_id", "bucket", "_s.of", "_s.sign")
        d = digests[level].withColumnRenamed("snapshot_id", "of")
        met = sides.join(d, ["of", "bucket"])
        differing = (
            met.groupBy("snapshot_id", "base_id", "bucket")
            .agg(F.sum(F.col("sign") * F.col("n")).alias("dn"), F.bit_xor("x").alias("dx"), F.sum(F.col("sign") * F.col("s")).alias("ds"), F.count(F.lit(1)).alias("k"))
            .where((F.col("k") == 1) | (F.col("dn") != 0) | (F.col("dx") != 0) | (F.col("ds") != 0))
            .select("snapshot_id", "base_id", "bucket")
        )
        if level:
            open_ = differing.withColumn("bucket", F.explode(F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda i: F.col("bucket") * fan + i)))
        else:
            open_ = differing
    wanted = open_.select("snapshot_id", "bucket", F.explode(F.array(F.struct(F.col("snapshot_id").alias("of"), F.lit(True).alias("now")), F.struct(F.col("base_id").alias("of"), F.lit(False).alias("now")))).alias("_s")).select("snapshot_id", "bucket", "_s.of", "_s.now")
    rows = wanted.join(tagged.withColumnRenamed("snapshot_id", "of"), ["of", "bucket"])
    kind = F.when(F.col("was") == 0, "added").when(F.col("is") == 0, "removed").when(~F.col("h_is").eqNullSafe(F.col("h_was")), "modified")
    return (
        rows.groupBy("snapshot_id", "file_path")
        .agg(F.count_if("now").alias("is"), F.count_if(~F.col("now")).alias("was"), F.max(F.when(F.col("now"), F.col("file_hash"))).alias("h_is"), F.max(F.when(~F.col("now"), F.col("file_hash"))).alias("h_was"))
        .select("snapshot_id", "file_path", kind.alias("change_kind"))
        .where(F.col("change_kind").isNotNull())
    )


def snapshot_changes(nodes: DataFrame, snapshots: DataFrame, **tree: int) -> DataFrame:
    """Changes of file paths of each complete snapshot against the complete one before."""
    pairs = materialize(consecutive(snapshots), "pairs")
    states = materialize(file_states(nodes, pairs), "states")
    return merkle_diff(states, pairs, **(tree or tree_shape(states)))


def change_counts(changes: DataFrame, states: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per compared snapshot the counts that a diff record holds: added, removed, modified, unchanged."""
    size = states.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = changes.groupBy("snapshot_id").agg(*[F.count_if(F.col("change_kind") == k).alias(f"{k}_count") for k in ("added", "removed", "modified")])
    out = pairs.where(F.col("base_id").isNotNull()).join(size, "snapshot_id", "left").join(kinds, "snapshot_id", "left").fillna(0, ["n", "added_count", "removed_count", "modified_count"])
    return out.select("snapshot_id", F.col("base_id").alias("base_snapshot_id"), "added_count", "removed_count", "modified_count", (F.col("n") - F.col("added_count") - F.col("modified_count")).alias("unchanged_count"))


def check_records(counts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Counts beside those a project recorded, with a verdict: ok, wrong, incomplete (a null) or missing.

    Of several records of one pair any that is right makes it ok.
    """
    names = ["added_count", "removed_count", "modified_count", "unchanged_count"]
    right = F.lit(True)
    for n in names:
        right = right & F.col(n).eqNullSafe(F.col(f"r_{n}"))
    lacks = F.lit(False)
    for n in names:
        lacks = lacks | F.col(f"r_{n}").isNull()
    rec = recorded.select("snapshot_id", "base_snapshot_id", F.lit(True).alias("there"), *[F.col(n).alias(f"r_{n}") for n in names])
    rank = F.when(F.col("there").isNull(), 0).when(right, 3).when(lacks, 2).otherwise(1)
    met = counts.join(rec, ["snapshot_id", "base_snapshot_id"], "left")
    best = met.groupBy("snapshot_id", "base_snapshot_id", *names).agg(F.max(rank).alias("v"))
    return best.select("snapshot_id", "base_snapshot_id", *names, F.element_at(F.array(*map(F.lit, ["missing", "wrong", "incomplete", "ok"])), F.col("v") + 1).alias("verdict"))
