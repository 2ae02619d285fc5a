"""Checks over streams. The batch operators are the reference semantics; these are an addition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, group: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per window and group; rows later than the watermark are left out. events: ts, group, value."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, window), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), group, "n", "total")


def first_seen(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; later ones are repeats."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_checks_on(stream: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs a batch check on every micro-batch and appends its issues; a replayed batch overwrites its own folder, so nothing counts twice."""

    def each(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
