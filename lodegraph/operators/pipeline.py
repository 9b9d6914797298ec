"""Steps over DataFrames put together: one after the other, by condition, side by side, and the check that a replay gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import materialize, union_all

Step = Callable[[DataFrame], DataFrame]


def sequence(df: DataFrame, *steps: Step, cut_every: int = 0) -> DataFrame:
    """``df`` through all steps; ``cut_every`` so many the lineage is cut."""
    for i, step in enumerate(steps, 1):
        df = step(df)
        if cut_every and i % cut_every == 0:
            df = materialize(df, "sequence")
    return df


def conditional(df: DataFrame, condition: Column, yes: Step, no: Step) -> DataFrame:
    """Rows for which the condition holds through ``yes``, all others, nulls among them, through ``no``."""
    holds = F.coalesce(condition, F.lit(False))
    return yes(df.where(holds)).unionByName(no(df.where(~holds)))


def parallel(df: DataFrame, branch: str, steps: dict[str, Step]) -> DataFrame:
    """``df`` through each step; the column ``branch`` names the step a row comes from."""
    return union_all([step(df).withColumn(branch, F.lit(name)) for name, step in steps.items()])


def digest(df: DataFrame) -> tuple[int, int, int]:
    """Rows and two order-free sums over all rows and columns, by name; maps don't count."""
    cols = sorted(c for c, t in df.dtypes if not t.startswith("map"))
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in cols])
    one, two = F.xxhash64(*cols, nulls), F.xxhash64(F.lit(1), *reversed(cols), nulls)
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(one), F.lit(0)), F.coalesce(F.sum(two.bitwiseAND(F.lit(0x7FFFFFFF))), F.lit(0))).first()
    return tuple(row)


def replays(df: DataFrame, again: DataFrame) -> bool:
    """Whether two runs gave the same rows, in any order."""
    return sorted(df.columns) == sorted(again.columns) and digest(df) == digest(again)
