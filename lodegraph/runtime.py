"""Cutting lineage, skew-proof joins and a few helpers that all operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so there are at most this many hot keys.
MAX_HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset
    (a local session) a temporary folder of this machine takes its place.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lodegraph-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return "file://" + _own


_own: str | None = None


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it back.

    Cuts the lineage, survives the loss of executors and gives the optimizer
    sizes.  The table goes away with :func:`release` or with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodegraph-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodegraph_path = path
    _written.append((spark.sparkContext.applicationId, path))
    return out


_written: list[tuple[str, str]] = []


def release(df: DataFrame) -> None:
    """Removes a table of :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_lodegraph_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for app, path in _written:
            if app == spark.sparkContext.applicationId:
                _remove(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="lodegraph-py-"), "lodegraph")
    archive = f"{base}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(archive)


_shipped: set[str] = set()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def latest(df: DataFrame, key: str, order: str, *carry: str) -> DataFrame:
    """Of several rows of one ``key`` the one with the greatest ``order``.

    An aggregate with map-side combine, so a key with very many rows is no
    burden.  A null ``order`` is older than any other; rows equal in it are told
    apart by the greatest remaining values, so the result is defined.
    """
    rest = [F.col(c) for c in carry]
    return (
        df.groupBy(F.col(key))
        .agg(F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("_m"))
        .select(key, *[F.col(f"_m.{c}").alias(c) for c in carry])
    )


def hot_keys(df: DataFrame, keys: list[str], max_hot: int = MAX_HOT_KEYS, least: int = 10_000) -> DataFrame | None:
    """Keys with more than one ``max_hot``-th of all rows, so never more than ``max_hot``; None if there are none.

    Keys under ``least`` rows are no burden and don't count.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    top = counts.orderBy(F.col("_n").desc()).limit(max_hot).collect()  # no more than max_hot keys can have so large a share
    if not top:
        return None
    total = df.count()
    rows = [tuple(r)[:-1] for r in top if r["_n"] * max_hot > total]
    found = counts.select(*keys)
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Equi-join to a side with one row per key, safe for hot keys on the left.

    ``hot`` has the keys (few, see :func:`hot_keys`) that carry a large share of
    ``left``.  Their rows of ``right`` are broadcast, at most one per hot key;
    all other rows join by shuffle.  Without ``hot`` it is a plain join, which
    AQE splits where it sees skew.
    """
    if hot is None:
        return left.join(right, keys, how)
    small = F.broadcast(hot.select(*keys))
    marked = right.join(small, keys, "left_semi")
    cold = left.join(small, keys, "left_anti").join(right.join(small, keys, "left_anti"), keys, how)
    warm = left.join(small, keys, "left_semi").join(F.broadcast(marked), keys, how)
    return cold.unionByName(warm)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
