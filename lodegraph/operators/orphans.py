"""References to records that do not exist: a fixpoint cascade down the foreign keys.

A row whose reference names no record is a direct orphan.  Rows that refer to an
orphan are inherited orphans, and so on, until a round adds none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import materialize, release, union_all

SCHEMA = "table_name string, row_id string, field_name string, _by string, month string, level int"


@dataclass(frozen=True)
class ForeignKey:
    """``child.field`` names ``parent.key``; ``also`` pairs further child and parent columns that must agree."""

    child: str
    field: str
    parent: str
    key: str = "id"
    also: tuple[tuple[str, str], ...] = ()
    counted: bool = field(default=True)


#: The references of the version graph that reports count; the uncounted ones only pass orphanhood on.
GRAPH_KEYS = (
    ForeignKey("edges", "source_node_id", "nodes", also=(("snapshot_id", "snapshot_id"),)),
    ForeignKey("edges", "target_node_id", "nodes", also=(("snapshot_id", "snapshot_id"),)),
    ForeignKey("evidence_links", "snapshot_id", "snapshots"),
    ForeignKey("evidence_links", "edge_id", "edges", counted=False),
)


def orphan_references(tables: dict[str, DataFrame], keys: tuple[ForeignKey, ...] = GRAPH_KEYS, id_column: str = "id", period: str = "created_at") -> DataFrame:
    """(table_name, row_id, field_name, month, level): level 0 is direct, n inherited over n steps.

    References that are null or empty are no cases.  A repeated row counts once,
    with its earliest month; a null period gives a null month.  An uncounted key
    finds no direct orphans but passes orphanhood on.  An orphan is the row, not
    its id alone: a reference inherits only from a row that it names by all its
    columns.  Tables may be empty and may have other columns of any name.  The
    cascade ends when a round adds nothing, however long it is.
    """
    refs, named = {}, {}
    for i, k in enumerate(keys):
        child = tables[k.child]
        cols = [F.col(id_column).cast("string").alias("row_id"), F.col(k.field).cast("string").alias("k0"), *[F.col(c).cast("string").alias(f"k{j}") for j, (c, _) in enumerate(k.also, 1)]]
        # what others may name this row by, beside its id
        named[i] = sorted({c for q in keys if q.parent == k.child for c in (q.key, *(p for _, p in q.also))})
        more = [F.col(c).cast("string").alias(f"x_{c}") for c in named[i] if c != id_column]
        refs[i] = child.where(F.col(k.field).isNotNull() & (F.col(k.field) != "")).select(*cols, F.date_format(F.col(period), "yyyy-MM").alias("month"), *more)
    direct = []
    for i, k in enumerate(keys):
        if not k.counted:
            continue
        names = _names(k)
        # each distinct reference is looked up once: counting first keeps hubs out of the join
        distinct = refs[i].groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        have = tables[k.parent].select(F.col(k.key).cast("string").alias("k0"), *[F.col(p).cast("string").alias(f"k{j}") for j, (_, p) in enumerate(k.also, 1)])
        missing = distinct.join(have, names, "left_anti").select(*names, "n")
        same = None
        for n in names:
            c = F.col(f"r.{n}").eqNullSafe(F.col(f"m.{n}"))
            same = c if same is None else same & c
        rows = refs[i].alias("r").join(missing.drop("n").alias("m"), same, "left_semi")
        direct.append(_cases(rows, k, 0, named[i], id_column))
    found = [materialize(_once(union_all(direct)) if direct else tables[keys[0].child].sparkSession.createDataFrame([], SCHEMA), "orphans")]
    fresh, level = found[0], 0
    while True:
        level += 1
        new = []
        for i, k in enumerate(keys):
            bad = fresh.where(F.col("table_name") == k.parent).select(*[F.get_json_object("_by", f"$['{p}']").alias(n) for n, p in zip(_names(k), (k.key, *(p for _, p in k.also)))]).distinct()
            new.append(_cases(refs[i].join(bad, _names(k), "left_semi"), k, level, named[i], id_column))
        found_now = materialize(_once(union_all(new)).join(union_all(found).select("table_name", "row_id", "field_name", "_by"), ["table_name", "row_id", "field_name", "_by"], "left_anti"), "orphans")
        if found_now.isEmpty():
            release(found_now)
            break
        found.append(found_now)
        fresh = found_now
        if len(found) > 20:  # a long cascade keeps its plans short
            found = [materialize(union_all(found), "orphans")]
    return union_all(found).groupBy("table_name", "row_id", "field_name").agg(F.min("month").alias("month"), F.min("level").alias("level"))


def _names(k: ForeignKey) -> list[str]:
    return ["k0", *[f"k{j}" for j in range(1, len(k.also) + 1)]]


def _cases(rows: DataFrame, k: ForeignKey, level: int, named: list[str], id_column: str) -> DataFrame:
    """Rows as cases; ``_by`` holds the columns by which other tables may name them."""
    by = [F.col("row_id" if c == id_column else f"x_{c}").alias(c) for c in named] or [F.lit(None).cast("string").alias("_")]
    return rows.select(F.lit(k.child).alias("table_name"), "row_id", F.lit(k.field).alias("field_name"), "month", F.to_json(F.struct(*by)).alias("_by"), F.lit(level).alias("level"))


def _once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("table_name", "row_id", "field_name", "_by").agg(F.min("month").alias("month"), F.min("level").alias("level"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Per table, field and month the direct and the inherited orphans."""
    return orphans.groupBy("table_name", "field_name", "month").agg(F.count_if(F.col("level") == 0).alias("direct_count"), F.count_if(F.col("level") > 0).alias("inherited_count"))
