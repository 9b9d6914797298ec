"""Contexts for a reader with a limited budget: slices of a graph, their overlap, ranking and what fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.runtime import materialize

#: What one node of a slice is taken to cost.
NODE_TOKENS = 20


def slice_digests(members: DataFrame, by: list[str]) -> DataFrame:
    """(*by, node_count, tokens, one, two) of slices; ``members``: (*by, node), each node of a slice once.

    Two order-free digests stand for the set of nodes, so no set is gathered.
    """
    return members.groupBy(*by).agg(
        F.count(F.lit(1)).alias("node_count"),
        (F.count(F.lit(1)) * NODE_TOKENS).alias("tokens"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.sum(F.xxhash64(F.lit(1), "node").bitwiseAND(F.lit(0x7FFFFFFF))).alias("two"),
    )


def dedupe_slices(members: DataFrame, scope: str, kind: str) -> DataFrame:
    """(scope, kind, node_count, tokens, copies): of slices of one scope with the same nodes the first by ``kind``."""
    d = slice_digests(members, [scope, kind])
    return d.groupBy(scope, "node_count", "tokens", "one", "two").agg(F.min(kind).alias(kind), F.count(F.lit(1)).alias("copies")).select(scope, kind, "node_count", "tokens", "copies")


def set_similarity(members: DataFrame, scope: str, kind: str, least: float) -> DataFrame:
    """(scope, a, b, common, similarity): pairs of slices of one scope by the share of common nodes, from ``least`` on.

    Joined on nodes; ``kind`` must have few values, which bounds the pairs of one node by their square.
    """
    m = materialize(members.select(scope, kind, "node"), "members")
    size = m.groupBy(scope, kind).agg(F.count(F.lit(1)).alias("n"))
    a = m.withColumnRenamed(kind, "a")
    b = m.withColumnRenamed(kind, "b")
    common = a.join(b, [scope, "node"]).where("a < b").groupBy(scope, "a", "b").agg(F.count(F.lit(1)).alias("common"))
    met = common.join(size.select(scope, F.col(kind).alias("a"), F.col("n").alias("na")), [scope, "a"]).join(size.select(scope, F.col(kind).alias("b"), F.col("n").alias("nb")), [scope, "b"])
    s = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return met.where(s >= least).select(scope, "a", "b", "common", F.round(s, 4).alias("similarity"))


def one_per_region(slices: DataFrame, scope: str, region: str, order: list[Column]) -> DataFrame:
    """Of the slices of one region the one that says most, by ``order``."""
    return slices.withColumn("_r", F.row_number().over(W.partitionBy(scope, region).orderBy(*order))).where("_r = 1").drop("_r")


#: Weights of the nine factors of the extended score.
WEIGHTS = {"centrality": 0.15, "proximity": 0.15, "semantic": 0.15, "risk": 0.15, "instability": 0.1, "fan_ratio": 0.1, "cyclic": 0.1, "hotspot": 0.05, "architecture": 0.05}


def extended_score(factors: DataFrame, weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum of the factors, each a column of its name between 0 and 1; null counts as 0."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(F.col(name), F.lit(0.0)) * w
    return out


def assemble(candidates: DataFrame, scope: str, score: str, tie: str, budget: int, cost: Column | None = None) -> DataFrame:
    """Candidates (scope, tie, score, ...) that fit the budget of their scope: each once, by score, ties by ``tie``, with ``used`` tokens so far.

    Rows beyond the budget are cut off where it is first passed; with a fixed
    cost only the first budget / cost rows of a scope are ranked at all.
    """
    once = candidates.groupBy(scope, tie).agg(F.max(score).alias(score))
    order = W.partitionBy(scope).orderBy(F.col(score).desc(), tie)
    if cost is None:
        ranked = once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget // NODE_TOKENS)
        return ranked.withColumn("used", (F.col("_r") * NODE_TOKENS).cast("bigint")).drop("_r")
    return once.withColumn("used", F.sum(cost).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("used") <= budget)
