"""As-of join: each row of one table with the nearest earlier (or later) row of another.

Time is cut into buckets and both tables are shuffled by ``keys + bucket``, so a key that owns a third of
all rows spreads over as many tasks as it has buckets. What a bucket has to know from those before it is
one row: the last value. Last values come from an aggregate per bucket and are carried forward over the
buckets of a span, then over the spans of a key, so neither step sees single rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import shuffled

SPAN = 1024  # buckets of a span


def _later(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def carried(lasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, bucket, value``: the last value before each bucket, from ``keys, bucket, value`` (null where a
    bucket has none). A window holds at most ``SPAN`` buckets, or one row for each span of a key."""
    spanned = lasts.withColumn("span", F.expr(f"bucket div {SPAN}L - IF(bucket % {SPAN} < 0, 1, 0)"))
    inside = F.last("value", True).over(_later([*keys, "span"], "bucket"))
    known = F.when(F.col("value").isNotNull(), F.col("bucket"))
    spans = spanned.groupBy(*keys, "span").agg(F.max_by("value", known).alias("value"))
    before = spans.select(*keys, "span", F.last("value", True).over(_later(keys, "span")).alias("before"))
    return spanned.withColumn("inside", inside).join(shuffled(before), [*keys, "span"]).select(
        *keys, "bucket", F.coalesce("inside", "before").alias("value")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    out: str = "found",
    forward: bool = False,
    tie: Sequence[str] = (),
    bucket_seconds: int = 3600,
    places: DataFrame | None = None,
) -> DataFrame:
    """``left`` with ``out``: a struct of ``values`` of the last row of ``right`` at or before ``left_ts``
    (``forward``: the first at or after it) with equal ``keys``; null where there is none.

    Of rows of ``right`` with equal keys and time the one with the largest ``tie`` counts (largest values
    without one). Rows of ``left`` whose key or time is null find nothing and stay, as do repeated rows; such rows of
    ``right`` are never found. ``bucket_seconds`` bounds what one task sorts: rows of a key in that time.
    ``left`` is computed once if ``places`` has its ``keys`` and ``left_ts`` too, from a table that is cheap to read again;
    ``right`` is read twice.
    """
    width = bucket_seconds * 1_000_000
    names = [f"_k{i}" for i in range(len(keys))]

    def placed(df: DataFrame, ts: str, *columns: Column) -> DataFrame:
        micros = F.unix_micros(F.col(f"`{ts}`").cast("timestamp"))
        at = -micros if forward else micros
        rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], at.alias("at"), *columns)
        return rows.withColumn("bucket", F.expr(f"`at` div {width}L - IF(`at` % {width}L < 0, 1, 0)"))

    def complete(rows: DataFrame) -> Column:
        found = F.col("at").isNotNull()
        for n in names:
            found = found & F.col(n).isNotNull()
        return found

    value = F.struct(*[F.col(f"`{v}`").alias(v) for v in values])
    rank = F.struct(*[F.col(f"`{t}`") for t in tie]) if tie else value
    theirs = placed(right, right_ts, rank.alias("rank"), value.alias("value"))
    # one row for each key and time; equal times are settled before anything is sorted
    theirs = theirs.where(complete(theirs)).groupBy(*names, "bucket", "at").agg(F.max_by("value", "rank").alias("value"))
    mine = placed(left, left_ts, F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns]).alias("row"))
    # rows that find nothing go along, in a bucket for each partition
    mine = mine.withColumn("bucket", F.when(complete(mine), F.col("bucket")).otherwise(F.spark_partition_id()))
    aims = placed(left if places is None else places, left_ts)

    lasts = theirs.groupBy(*names, "bucket").agg(F.max_by("value", "at").alias("value"))
    wanted = aims.where(complete(aims)).select(*names, "bucket").distinct().withColumn("value", F.lit(None).cast(lasts.schema["value"].dataType))
    buckets = lasts.unionByName(wanted).groupBy(*names, "bucket").agg(F.max_by("value", F.col("value").isNotNull()).alias("value"))
    first = carried(buckets, names).where("value IS NOT NULL").withColumn("at", F.lit(-(1 << 63)).cast("bigint"))

    nothing = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    side = [*names, "bucket", "at"]
    meeting = (
        theirs.unionByName(first).select(*side, F.lit(0).alias("side"), nothing(mine, "row"), "value")
        .unionByName(mine.select(*side, F.lit(1).alias("side"), "row", nothing(theirs, "value")))
    )
    so_far = Window.partitionBy(*names, "bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = meeting.withColumn("value", F.last("value", True).over(so_far)).where("side = 1")
    met = met.select("row", F.when(complete(met), F.col("value")).alias("value"))
    return met.select(*[F.col(f"row.`{c}`").alias(c) for c in left.columns], F.col("value").alias(out))
