"""Rules as rows: conditions on metrics, compared and combined by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a rule may compare with.
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "GT": lambda a, b: a > b,
    "GTE": lambda a, b: a >= b,
    "LT": lambda a, b: a < b,
    "LTE": lambda a, b: a <= b,
    "EQ": lambda a, b: a == b,
    "NEQ": lambda a, b: a != b,
}
RULE = "rule_id string, condition_no int, metric_type string, operator string, value double, severity string, title string"
#: The built-in rules: id, conditions (metric, operator, value), severity, title.
BUILT_IN = (
    ("complex-001", (("COMPLEXITY", "GT", 0.5),), "HIGH", "High architecture complexity"),
    ("complex-002", (("COMPLEXITY", "GT", 0.8),), "CRITICAL", "Critical architecture complexity"),
    ("complex-003", (("CYCLIC_NODES", "GT", 0.0),), "HIGH", "Cyclic dependency architecture"),
    ("coup-001", (("COUPLING_DENSITY", "GT", 0.1),), "CRITICAL", "Critical global coupling"),
    ("coup-002", (("COUPLING_CLUSTERS", "GT", 0.0),), "MODERATE", "High number of coupling clusters"),
    ("dep-001", (("CENTRALITY", "GT", 0.7), ("FAN_OUT", "GT", 0.0)), "HIGH", "High-dependency hub detected"),
    ("dep-002", (("COUPLING_DENSITY", "GT", 0.08),), "HIGH", "Excessive global coupling density"),
    ("inst-001", (("INSTABILITY", "GTE", 0.6),), "HIGH", "High instability module"),
    ("inst-002", (("INSTABILITY", "GTE", 0.3), ("INFRASTRUCTURE", "GT", 0.0)), "HIGH", "Unstable infrastructure module"),
    ("layer-001", (("LAYERING_VIOLATIONS", "GT", 0.0),), "HIGH", "Architecture layering violations"),
    ("layer-002", (("MAX_DEPTH", "GT", 10.0),), "HIGH", "Excessive dependency chain depth"),
    ("prop-001", (("CHOKE_POINT", "GT", 0.0),), "HIGH", "Change propagation choke point"),
    ("prop-002", (("PROPAGATION_RISK", "GT", 0.5),), "HIGH", "High propagation pressure"),
)


def rule_rows(spark, rules=BUILT_IN) -> DataFrame:
    """One row per condition of each rule; a user's own rules have the same form."""
    rows = [(i, n, m, o, float(v), sev, title) for i, conditions, sev, title in rules for n, (m, o, v) in enumerate(conditions)]
    return spark.createDataFrame(rows, RULE)


def evaluate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, snapshot_id, ref, severity, title, value): subjects that meet all conditions of a rule.

    ``metrics``: (snapshot_id, ref, metric_type, metric_value), ``ref`` a node or
    the snapshot itself.  ``value`` is that of the rule's first condition, the
    greatest of several.  Null and NaN values meet nothing; a condition with an
    unknown operator or metric is never met.  The rules are few and broadcast.
    """
    few = F.broadcast(rules)
    v, b = F.col("metric_value"), F.col("value")
    met = F.lit(False)
    for name, holds in OPERATORS.items():
        met = met | ((F.col("operator") == name) & holds(v, b))
    hit = metrics.where(v.isNotNull() & ~F.isnan(v)).join(few, "metric_type").where(met)
    need = F.broadcast(rules.groupBy("rule_id").agg(F.count_distinct("condition_no").alias("need")))
    got = hit.groupBy("rule_id", "snapshot_id", "ref").agg(F.count_distinct("condition_no").alias("met"), F.max(F.when(F.col("condition_no") == 0, v)).alias("value"), F.max("severity").alias("severity"), F.max("title").alias("title"))
    return got.join(need, "rule_id").where(F.col("met") == F.col("need")).select("rule_id", "snapshot_id", "ref", "severity", "title", "value")
