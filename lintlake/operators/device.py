"""Device memory use over snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.asof import asof_join
from lintlake.operators.paging import kept


def memory_percent(used: Column, total: Column) -> Column:
    """Memory in use as a percentage; null when the total is unknown or nothing."""
    return F.when((used >= 0) & (total > 0), used / total * 100)


def memory_change(snapshots: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts",)) -> DataFrame:
    """``keys, before, after, delta``: percentage at the first and the last snapshot of each key."""
    percent = memory_percent(F.col("memory_used"), F.col("memory_total"))
    at = F.struct(*order)
    ends = snapshots.withColumn("_p", percent).groupBy(*keys).agg(
        F.min_by("_p", at).alias("before"), F.max_by("_p", at).alias("after")
    )
    return ends.withColumn("delta", F.col("after") - F.col("before"))


def change_around(
    requests: DataFrame,
    snapshots: DataFrame,
    keys: Sequence[str] = ("device",),
    started: str = "started",
    ended: str = "ended",
    ts: str = "ts",
    tie: Sequence[str] = (),
    bucket_seconds: int = 3600,
) -> DataFrame:
    """``requests`` with ``before``, ``after`` and ``delta``: the percentage of memory in use at the last
    reading up to the start of a request and at the first one from its end on.

    A snapshot without a reading is passed over, so the last known value carries on. A request without a
    reading on either side (or without a device or time) has null there and a null ``delta``.
    """
    percent = memory_percent(F.col("memory_used"), F.col("memory_total"))
    read = snapshots.select(*keys, ts, *tie, percent.alias("percent"))
    # one reading for each key and time, taken out of the snapshots once for both sides
    rank = F.when(F.col("percent").isNotNull(), F.struct(*(tie or ["percent"])))
    known = kept(read.groupBy(*keys, ts).agg(F.max_by("percent", rank).alias("percent")).where("percent IS NOT NULL"))
    at_start = asof_join(requests, known, keys, started, ts, ["percent"], "_before", False, (), bucket_seconds)
    at_end = asof_join(at_start, known, keys, ended, ts, ["percent"], "_after", True, (), bucket_seconds, requests)
    return at_end.select(
        *requests.columns,
        F.col("_before.percent").alias("before"),
        F.col("_after.percent").alias("after"),
        (F.col("_after.percent") - F.col("_before.percent")).alias("delta"),
    )


def device_windows(snapshots: DataFrame, width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """``window_start, device`` with average and peak power, memory and utilisation. Batch or streaming."""
    def known(name: str) -> Column:
        return F.when(F.col(name) >= 0, F.col(name))

    fields = ("power_draw", "memory_used", "gpu_utilization", "temperature")
    aggregates = [f(known(c)).alias(f"{label}_{c}") for c in fields for label, f in (("avg", F.avg), ("max", F.max))]
    return (
        snapshots.groupBy(F.window(ts, width), "device")
        .agg(F.count(F.lit(1)).alias("samples"), *aggregates)
        .select(F.col("window.start").alias("window_start"), "device", "samples", *[a for a in _names(fields)])
    )


def _names(fields: Sequence[str]) -> list[str]:
    return [f"{label}_{c}" for c in fields for label in ("avg", "max")]
