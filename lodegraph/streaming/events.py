"""Streams of events: windows with late data, sessions, a circuit breaker per key, exactly-once sinks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, kind: str, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, kind, n, total): tumbling or sliding windows; rows later than ``late`` are left out."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events without a longer gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def circuit_breaker(events: DataFrame, key: str, ts: str, failed: str, threshold: int = 5, window_s: int = 60, reset_s: int = 30) -> DataFrame:
    """(key, ts, state): CLOSED, OPEN after so many failures within the window, HALF_OPEN once the pause is over.

    State per key is the recent failures, at most ``threshold`` of them, and the
    time it opened.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, opened, mode = state.get if state.exists else ("", -1.0, "CLOSED")
        times = [float(x) for x in recent.split(",") if x]
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for t, bad in zip(rows["ts"], rows["failed"]):
            now = t.timestamp()
            times = [x for x in times if now - x <= window_s][-threshold:]
            if mode == "OPEN" and now - opened >= reset_s:
                mode = "HALF_OPEN"
            if bad:
                times.append(now)
                if mode == "HALF_OPEN" or mode == "CLOSED" and len(times) >= threshold:
                    mode, opened = "OPEN", now
            elif mode == "HALF_OPEN":
                mode, times = "CLOSED", []
            out.append((k[0], t, mode))
        state.update((",".join(map(str, times[-threshold:])), opened, mode))
        yield pd.DataFrame(out, columns=["key", "ts", "state"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(failed).alias("failed"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, state string", "recent string, opened double, mode string", "append", GroupStateTimeout.NoTimeout)


def append_once(events: DataFrame, path: str, checkpoint: str):
    """Appends every batch to its own folder; a batch that runs again overwrites itself."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
