"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are turned into the basis of their principal components, so most of a product comes from the
first dimensions. Each label's distinct vectors are dealt into tiles; every pair of tiles is one
group of bounded size. Inside it products are summed over the leading dimensions first; the norms of
what is left bound the rest, and pairs that can no longer reach the threshold are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import written
from lintlake.llm.components import components, local_roots

THRESHOLD = 0.98
TILE = 1024
MOST_DIMS = 512  # beyond, the axes stay as they are: any orthogonal basis gives the same links
STEPS = (8, 16, 32, 64, 128, 256, 512)
_MARGIN = 1e-9


def basis_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, by falling variance) of the unit vectors of each dimension count.

    Sums of products are added up per task and then by Spark; the driver gets d * d sums.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.column(0):
                x = np.array(row.values.to_numpy(zero_copy_only=False), np.float64)
                if len(x) <= MOST_DIMS:
                    x /= np.linalg.norm(x)
                    sums.setdefault(len(x), []).append(x)
            for d, rows in sums.items():
                if isinstance(rows, list):
                    x = np.stack(rows)
                    sums[d] = x.T @ x
            yield from _entries(sums)
            sums = {}

    def _entries(sums):
        for d, total in sums.items():
            i = np.arange(d * d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(i), pa.array(total.ravel())], names=["d", "i", "v"])

    rows = vectors.select("embedding").mapInArrow(run, "d long, i long, v double").groupBy("d", "i").agg(F.sum("v").alias("v")).collect()
    totals: dict[int, np.ndarray] = {}
    for row in rows:
        totals.setdefault(row["d"], np.zeros(row["d"] ** 2))[row["i"]] = row["v"]
    out = {}
    for d, total in totals.items():
        _, axes = np.linalg.eigh(total.reshape(d, d))
        out[d] = axes[:, ::-1].copy()
    return out


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of two blocks whose cosine is at least ``threshold``."""
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    unit_a, unit_b = a / norm_a[:, None], b / norm_b[:, None]
    p, q = (unit_a @ axes, unit_b @ axes) if axes is not None else (unit_a, unit_b)
    dims = p.shape[1]
    i = j = None
    dense = np.zeros((len(a), len(b)))
    sums, done = dense, 0
    for stop in [*(s for s in STEPS if s < dims), dims]:
        rest = np.sqrt(np.maximum(0, (p[:, stop:] ** 2).sum(axis=1))), np.sqrt(np.maximum(0, (q[:, stop:] ** 2).sum(axis=1)))
        if i is None:
            dense += p[:, done:stop] @ q[:, done:stop].T
            alive = dense + rest[0][:, None] * rest[1][None, :] >= threshold - _MARGIN
            if alive.sum() * 16 <= alive.size or stop == dims:
                i, j = np.nonzero(alive)
                sums = dense[i, j]
        else:
            for at in range(0, len(i), 1 << 17):
                own = slice(at, at + (1 << 17))
                sums[own] += np.einsum("ij,ij->i", p[i[own], done:stop], q[j[own], done:stop])
            alive = sums + rest[0][i] * rest[1][j] >= threshold - _MARGIN
            i, j, sums = i[alive], j[alive], sums[alive]
        done = stop
    close = np.flatnonzero(np.abs(sums - threshold) <= _MARGIN)  # decided on the vectors as they are
    sure = sums >= threshold
    for at in close:
        sure[at] = a[i[at]] @ b[j[at]] / (norm_a[i[at]] * norm_b[j[at]]) >= threshold
    return i[sure], j[sure]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Links between vectors of equal, non-null label with cosine >= ``threshold`` (double precision).

    Takes vec_id (long), embedding (array of numbers), label; other columns are not read. Returns one row per
    input row: vec_id, label, n_links (other rows linked directly), component_id (least vec_id reachable,
    itself included), kept. Rows whose vector is null, empty, zero or holds null or non-finite
    numbers, whose label is null or whose vec_id is null link with nothing; vectors of different
    lengths never link. Equal vectors of a label are compared once and counted with their number.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = (
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 "
        "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    )
    usable = F.coalesce(F.expr(good), F.lit(False))
    valid = rows.where(usable)
    classes = written(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    axes = classes.sparkSession.sparkContext.broadcast(basis_of(classes))

    tiles = classes.groupBy("label", F.size("embedding").alias("d")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.withColumn("d", F.size("embedding")).join(tiles, ["label", "d"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = met.select(
        "label", "d", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "rep", "copies", "embedding"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf.ta.iloc[0] == pdf.tb.iloc[0]
        x = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
        left = np.arange(len(pdf)) if same else np.flatnonzero(pdf.tile.to_numpy() == pdf.ta.iloc[0])
        right = left if same else np.flatnonzero(pdf.tile.to_numpy() == pdf.tb.iloc[0])
        i, j = linked(x[left], x[right], axes.value.get(x.shape[1]), threshold)
        if same:
            i, j = i[i < j], j[i < j]
        i, j = left[i], right[j]
        copies = pdf.copies.to_numpy()
        links = np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
        roots = local_roots(len(pdf), i, j)
        some = links > 0
        reps = pdf.rep.to_numpy()
        return pd.DataFrame({"rep": reps[some], "root": reps[roots[some]], "links": links[some].astype(np.int64)})

    found = pairs.groupBy("label", "d", "ta", "tb").applyInPandas(compare, "rep long, root long, links long")
    found = written(found, "links")
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    decided = (
        classes.select("label", "embedding", "rep", "copies")
        .join(counts, "rep", "left")
        .join(parts, F.col("rep") == F.col("node"), "left")
        .select(
            "label", "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    known = valid.join(decided, ["label", "embedding"]).select("vec_id", "label", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
