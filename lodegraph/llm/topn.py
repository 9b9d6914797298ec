"""Top N items within every group, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.runtime import MAX_HOT_KEYS, fresh, materialize

#: Histogram cells per factor of two; a cell spans about 1 % of a score.
CELLS_PER_OCTAVE = 64


def score_cell(score: Column) -> Column:
    """A whole number that never falls as the score rises, equally fine at every magnitude."""
    size = F.floor((F.log2(F.abs(score)) + 1100) * CELLS_PER_OCTAVE).cast("long")
    top = F.lit(4_000_000).cast("long")
    size = F.when(F.abs(score) == float("inf"), top).otherwise(F.greatest(size, F.lit(1).cast("long")))
    return F.when(score == 0, F.lit(0).cast("long")).when(score > 0, size).otherwise(-size)


def top_n_per_group(df: DataFrame, group: list[str], score: str, n: int, ties: list[Column], prune_above: int = 64) -> DataFrame:
    """``df``'s rows that rank 1 to ``n`` in their group, with ``rank_no``.

    Order: ``score`` descending, then ``ties``.  Rows whose score is null or NaN
    do not count; a null group is a group; a group with fewer rows gives what it
    has.  Rows equal in score and all ties rank in any order, so give ties that
    are unique.

    A histogram of scores per group, combined map-side, gives the lowest cell
    that is still needed to have ``n`` rows from the top; rows of lower cells
    are dropped before any row is moved.  Groups of up to ``prune_above`` rows
    need no threshold.  The exact rank that follows keeps ``n`` rows of a group
    per partition before the shuffle, so equal scores in one huge group do no
    harm either.
    """
    valid = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    *keys, floor = fresh(df, *[f"_g{i}" for i in range(len(group))], "_floor")
    cells = valid.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)], score_cell(F.col(score)).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    per = W.partitionBy(*keys)
    above = F.sum("_n").over(per.orderBy(F.col("_cell").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    needed = cells.select(*keys, "_cell", above.alias("_above"), F.sum("_n").over(per).alias("_all")).where((F.col("_above") < n) & (F.col("_all") > prune_above))
    floors = materialize(needed.groupBy(*keys).agg(F.min("_cell").alias(floor), F.first("_all").alias("_all")), "floors")
    same = F.lit(True)
    for g, k in zip(group, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    largest = floors.orderBy(F.col("_all").desc(), *keys).limit(MAX_HOT_KEYS)
    kept = valid
    for part in (F.broadcast(largest), floors.join(largest.select(*keys), keys, "left_anti")):
        low = score_cell(F.col(score)) >= F.col(floor)
        kept = kept.join(part.drop("_all"), same, "left").where(F.col(floor).isNull() | low).select(*df.columns)
    order = W.partitionBy(*group).orderBy((F.col(score) + F.lit(0.0)).desc(), *ties)
    return kept.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= n).select(*df.columns, "rank_no")


def top_symbols(symbols: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best symbols of every file: the last computation of each symbol counts; ties by name, then id.

    Names and ids order by code point, nulls last.  Rows without symbol_id are
    one symbol.
    """
    best = F.max(F.struct("computed_at", "centrality_score", "file_path", "symbol_name")).alias("_m")
    current = materialize(symbols.groupBy("symbol_id").agg(best).select("symbol_id", F.col("_m.file_path").alias("file_path"), F.col("_m.symbol_name").alias("symbol_name"), F.col("_m.centrality_score").alias("centrality_score")).where(F.col("centrality_score").isNotNull() & ~F.isnan("centrality_score")), "symbols")
    return top_n_per_group(current, ["file_path"], "centrality_score", n, [F.col("symbol_name").asc_nulls_last(), F.col("symbol_id").asc_nulls_last()])
