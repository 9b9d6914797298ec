"""Joins, diffs, summaries and rankings over the version graph and its side tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.runtime import all_of, fresh, materialize


def neighbours(edges: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """Edges with the node at their ``dst`` (dependencies) or ``src`` (dependents)."""
    n = nodes.select(F.col("id").alias(side), F.col("file_path").alias("path"), F.col("node_type").alias("kind"))
    return edges.join(n, side).select("id", "src", "dst", "edge_type", "path", "kind")


def induced(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that ``keep`` holds for and the edges between them."""
    n = nodes.where(keep)
    ids = n.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, e


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys with kind added, removed, modified or unchanged; null values are equal to null only."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified").otherwise("unchanged")
    return a.join(b, list(keys), "full_outer").select(*keys, kind.alias("kind"))


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def spread(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """``n`` rows taken in turns from the groups of ``by``, each group in its own order."""
    turn = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("_t", turn).where(F.col("_t") <= n).orderBy("_t", by).limit(n).drop("_t")


def greedy(df: DataFrame, by: Sequence[str], order: Sequence[Column], cost: str, budget: int) -> DataFrame:
    """Rows a greedy packer takes: in order, each that still fits, skipping those that don't.

    Order-dependent, so a group is one task, but an exactly reduced one: of the
    rows of one cost only the first ``budget / cost`` can be taken, so about
    budget times log budget rows are gathered.  Rows without cost always fit.
    """
    c = F.col(cost)
    free = df.where(c == 0)
    nth = F.row_number().over(W.partitionBy(*by, cost).orderBy(*order))
    fits = df.where((c > 0) & (c <= budget)).withColumn("_n", nth).where(F.col("_n") * c <= budget).drop("_n")
    ranked = materialize(fits.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))), "ranked")
    packed = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(cost).cast("bigint").alias("c")))).alias("_l"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("took"))
    fold = F.aggregate("_l", start, lambda a, x: F.when(a["used"] + x["c"] <= budget, F.struct((a["used"] + x["c"]).alias("used"), F.concat(a["took"], F.array(x["_r"])).alias("took"))).otherwise(a), lambda a: a["took"])
    took = packed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.explode(fold).alias("_t"))
    same = all_of([F.col("_t") == F.col("_r"), *(F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(by))])
    return ranked.join(took, same, "left_semi").drop("_r").unionByName(free)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, to: str) -> DataFrame:
    """``df`` with the sum of ``value`` (null: 0) from the first row of its group to itself, in ``order``, which must be unique in a group.

    Rows are spread by ranges of group and order, so a group of any size is many
    tasks; each range adds up its own rows and the sums of the ranges before it,
    one number a range and group.
    """
    at, own = fresh(df, "_at", "_own")
    spread = df.withColumn(own, F.coalesce(value, F.lit(0))).repartitionByRange(*[F.col(c) for c in by], *order).withColumn(at, F.spark_partition_id())
    held = materialize(spread, "ranges")
    ranges = held.groupBy(*by, at).agg(F.sum(own).alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(at).alias("_ka"), before.alias("_b"))
    here = W.partitionBy(*by, at).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    same = all_of([F.col(at) == F.col("_ka"), *(F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by))])
    summed = held.withColumn(to, F.sum(own).over(here)).join(ranges, same)
    return summed.withColumn(to, F.col(to) + F.col("_b")).select(*df.columns, to)


def prefix_budget(df: DataFrame, by: Sequence[str], order: Sequence[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order until the budget is used up."""
    (used,) = fresh(df, "_used")
    return running_sum(df, by, order, F.col(cost), used).where(F.col(used) <= budget).drop(used)


def term_index(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, key): an inverted index, each pair once."""
    return df.select(key, F.explode(terms).alias("term")).distinct()
