"""Ordered text per key, in pages of bounded size.

A key may own a third of all rows, so nothing here gathers a key of unknown size
in one task. Large keys are ranked by slices (a slice never outgrows one task),
and text is aggregated per ``(key, page)``. A key with up to ``PAGE_ROWS`` rows and
``PAGE_BYTES`` bytes has the one page 0, which is its complete text; pages of a larger
key follow each other in page order and nothing is left out.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import shuffled

PAGE_ROWS = 65_536
PAGE_BYTES = 1 << 28
SLICE_ROWS = 512  # positions of a slice, which goes to one page as a whole


def page_of(pos: str, rows: int = PAGE_ROWS) -> Column:
    return F.expr(f"`{pos}` div {rows}L")


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")
    return f"'{escaped}'"


def ordered_text(text: str, order: Sequence[str], sep: str) -> Column:
    """Ordered string aggregate; the caller's grouping has to bound the group."""
    by = ", ".join(f"`{c}`" for c in order)
    return F.expr(f"listagg(`{text}`, {_quoted(sep)}) WITHIN GROUP (ORDER BY {by})")


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys meet, with the key columns of the left side."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(shuffled(other), condition, how).drop(*[f"_r_{k}" for k in keys])


def text_pages(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    text: str,
    sep: str = "\n",
    out: str = "text",
    rows: int = PAGE_ROWS,
    then: Sequence[str] = (),
    size: int = PAGE_BYTES,
) -> DataFrame:
    """``keys, page, out``: ``text`` joined in the order of ``pos`` (a whole number), then of ``then``.

    Positions need not be dense. A key's rows fall into slices by position; the rows and bytes of the
    slices before give a slice its page, so a key of up to ``rows`` rows and ``size`` bytes has page 0
    alone, however far apart its positions lie. Page numbers rise with ``pos`` and may leave gaps.
    """
    sliced = df.withColumn("_slice", page_of(pos, min(rows, SLICE_ROWS)))
    sizes = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("_bytes")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_n", "_bytes")})
    pages = ahead.select(*keys, "_slice", F.expr(f"greatest(_n div {rows}L, _bytes div {size}L)").alias("page"))
    paged = _join_on(sliced, pages, [*keys, "_slice"], "inner")
    return paged.groupBy(*keys, "page").agg(ordered_text(text, [pos, *then], sep).alias(out))


def small_text_pages(
    df: DataFrame, keys: Sequence[str], pos: str, text: str, sep: str = "\n", out: str = "text", rows: int = PAGE_ROWS, size: int = PAGE_BYTES
) -> DataFrame:
    """As :func:`text_pages`, for tables in which few keys are larger than a page.

    A key of up to ``rows`` rows and ``size`` bytes is one aggregate. Only larger keys are cut into pages, and
    the few keys whose hash is that of a larger one. The hashes are broadcast: there is at most one for ``rows``
    rows or ``size`` bytes.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    sizes = hashed.groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("_bytes")
    )
    large = F.broadcast(sizes.filter((F.col("_n") > rows) | (F.col("_bytes") >= size)).select("_hash"))
    joined = hashed.join(large, "_hash", "left_anti").groupBy(*keys).agg(ordered_text(text, [pos], sep).alias(out))
    single = joined.select(*keys, F.lit(0).cast("bigint").alias("page"), out)
    rest = hashed.join(large, "_hash", "left_semi").drop("_hash")
    return single.unionByName(text_pages(rest, keys, pos, text, sep, out, rows, size=size))


def dense_text_pages(
    df: DataFrame, keys: Sequence[str], pos: str, text: str, sep: str = "\n", out: str = "text", rows: int = PAGE_ROWS
) -> DataFrame:
    """As :func:`text_pages` for positions that count 0, 1, 2 ...: one aggregate, which a stream can run as well."""
    paged = df.withColumn("page", page_of(pos, rows))
    return paged.groupBy(*keys, "page").agg(ordered_text(text, [pos], sep).alias(out))


def _rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based rank per key from per-slice ranks and the sizes of the slices before."""
    sizes = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        _join_on(df, offsets, [*keys, "_slice"], "inner")
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_slice", "_offset")
    )


def positions(df: DataFrame, keys: Sequence[str], pos: str, out: str = "rank", rows: int = PAGE_ROWS) -> DataFrame:
    """Dense 0-based rank of a whole-number ``pos`` (unique per key). Lazy, two shuffles."""
    return _rank(df.withColumn("_slice", page_of(pos, rows)), keys, [pos], out)


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once for all that read it: kept by the executors from its first use on, which starts no
    job here, and computed again by the same shuffle where an executor is lost.

    A number makes each plan its own, so that a table that changed meanwhile is never taken for the old one.
    ``spark.catalog.clearCache()`` frees what is kept.
    """
    return df.withColumn("_build", F.lit(random.getrandbits(62))).persist().drop("_build")


def sorted_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """Dense 0-based rank by any sort columns (unique per key). Lazy.

    A range shuffle on ``keys + order`` cuts large keys into slices. The rows and the sizes of the slices
    have to come from one and the same shuffle, so its result is kept (see :func:`kept`).
    """
    laid_out = kept(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    return _rank(laid_out, keys, order, out)


def sorted_text_pages(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    sep: str = "\n",
    out: str = "text",
    rows: int = PAGE_ROWS,
    size: int = PAGE_BYTES,
) -> DataFrame:
    """As :func:`text_pages`, ordered by any columns. Lazy.

    The rows are computed once (see :func:`kept`). Keys of at most ``rows`` rows and ``size`` bytes are one
    aggregate; only larger keys are ranked. Without any, that branch is empty once the sizes are known.
    """
    held = kept(df.select(*keys, *[c for c in dict.fromkeys([*order, text]) if c not in keys]))
    sizes = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("_bytes")
    )
    large = sizes.filter((F.col("_n") > rows) | (F.col("_bytes") > size)).select(*keys)
    joined = _join_on(held, large, keys, "left_anti").groupBy(*keys).agg(ordered_text(text, order, sep).alias(out))
    single = joined.select(*keys, F.lit(0).cast("bigint").alias("page"), out)
    ranked = sorted_positions(_join_on(held, large, keys, "left_semi"), keys, order, "_rank")
    return single.unionByName(text_pages(ranked, keys, "_rank", text, sep, out, rows, size=size))
