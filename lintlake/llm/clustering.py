"""Centroid clustering in exact integers; the nearest centroid is found by the threshold algorithm.

Every dimension has its own list of centroids, sorted by their value there. A vector walks each list
outward from its own value, one centroid a step and list; a centroid met for the first time is
compared exactly in all dimensions. The gaps at the frontiers of the lists, squared and summed, bound
from below the distance of every centroid not met yet, so a vector is done as soon as that sum strictly
exceeds its best distance (on equality an unmet centroid of smaller number might tie).

The driver holds the centroids only: ``k`` times ``dims`` numbers, whatever the size of the table.
Each round is one narrow pass over the written vectors; sums leave a task once per cluster and dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import written

K = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3
SAFE = 1 << 27  # up to this magnitude 64 squared differences fit 64 bits; beyond, Python integers are used
MOST = 1 << 52  # components from here on are not exact integers of a double any more
LONG = (1 << 63) - 1
_CELLS = 1 << 20  # numbers held at once per chunk of vectors


class SortedLists:
    """The centroids of each dimension in the order of their values there."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid (the smaller number on ties),
        and how many exact distances were computed."""
        n, dims = x.shape
        k = len(self.centroids)
        cluster, distance, compared = np.zeros(n, np.int64), np.zeros(n, x.dtype), 0
        rows = np.arange(n)
        dim = np.arange(dims)[None, :]
        right = np.stack([np.searchsorted(self.values[:, d], x[:, d]) for d in range(dims)], axis=1).astype(np.int64)
        left = right - 1
        far = 1 << 62 if x.dtype == np.int64 else 1 << 200
        exact = np.full((n, k), far, x.dtype)
        met = np.zeros((n, k), bool)
        for depth in range(k):
            below = np.where(left >= 0, x - self.values[np.maximum(left, 0), dim], far)
            above = np.where(right < k, self.values[np.minimum(right, k - 1), dim] - x, far)
            down = below <= above
            gap = np.where(down, below, above)
            who = self.order[np.where(down, left, right), dim]
            left, right = left - down, right + ~down
            fresh = np.zeros_like(met)
            fresh[np.arange(len(rows))[:, None], who] = True
            at, centroid = np.nonzero(fresh & ~met)
            met |= fresh
            apart = x[at] - self.centroids[centroid]
            exact[at, centroid] = (apart * apart).sum(axis=1)
            compared += len(at)
            best = exact.min(axis=1)
            open_ = (gap * gap).sum(axis=1) <= best
            done = ~open_.astype(bool) | met.all(axis=1) | (depth == k - 1)
            cluster[rows[done]] = exact[done].argmin(axis=1)
            distance[rows[done]] = best[done]
            if done.all():
                break
            keep = ~done
            rows, x, left, right, exact, met = (a[keep] for a in (rows, x, left, right, exact, met))
        return cluster, distance, compared


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): rows of exactly ``dims`` finite components, each turned into floor(scale * value)."""
    good = f"size(embedding) = {dims} AND forall(embedding, v -> v IS NOT NULL AND abs(v * {scale}) < {MOST}D)"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    integers = F.transform("embedding", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return rows.where(F.coalesce(F.expr(good), F.lit(False))).select("vec_id", integers.alias("x"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The ``k`` rows whose ids have the smallest sha256 of ``seed:id``, in that order."""
    named = rows.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "x")
    return [list(r["x"]) for r in named.orderBy("hash", "x").limit(k).collect()]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assigned(batch: pa.RecordBatch, at: int, lists: dict[bool, SortedLists], dims: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, clusters, distances) of a batch, in chunks of bounded size."""
    x = _matrix(batch.column(at), dims)
    step = max(1, _CELLS // max(dims, len(lists[True].centroids)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        small = False in lists and np.abs(part).max() <= SAFE
        part = part if small else part.astype(object)
        cluster, distance, _ = lists[not small].nearest(part)
        yield slice(lo, lo + len(part)), part, cluster, distance


def _lists(centroids: list[list[int]]) -> dict[bool, SortedLists]:
    """Sorted lists by whether their integers are of any size."""
    found = {True: SortedLists(np.array(centroids, object))}
    if all(abs(v) <= SAFE for c in centroids for v in c):
        found[False] = SortedLists(np.array(centroids, np.int64))
    return found


def moved(rows: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round over ``rows``; a centroid without vectors stays."""

    def run(batches):
        lists, k = _lists(centroids), len(centroids)
        sums, counts = [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            for _, x, cluster, _ in _assigned(batch, 0, lists, dims):
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    counts[c] += len(own)
                    sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0).tolist(), strict=True)]
        some = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c in some for _ in range(dims)], pa.int32()),
                pa.array([d for _ in some for d in range(dims)], pa.int32()),
                pa.array([counts[c] for c in some for _ in range(dims)], pa.int64()),
                pa.array([Decimal(v) for c in some for v in sums[c]], pa.decimal128(38, 0)),
            ],
            names=["cluster", "dim", "n", "total"],
        )

    parts = rows.select("x").mapInArrow(run, "cluster int, dim int, n long, total decimal(38,0)")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k * dims rows
        out[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
    return out


def nearest_centroids(rows: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every row; a distance beyond 64 bits is null."""
    kind = rows.schema["vec_id"].dataType

    def run(batches):
        lists = _lists(centroids)
        for batch in batches:
            for at, _, cluster, distance in _assigned(batch, 1, lists, dims):
                far = [v if v <= LONG else None for v in distance.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at], pa.array(cluster.astype(np.int32)), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"]
                )

    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return rows.select("vec_id", "x").mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Cluster the vectors of ``vectors`` (vec_id, embedding) around ``k`` centroids.

    Vectors of another length than ``dims``, or with components that are null, not finite or of an
    integer of 2**52 or more, are left out. Each component becomes floor(``scale`` * component). The
    centroids start as the ``k`` vectors with the smallest sha256 of ``seed:vec_id`` and are replaced
    ``rounds`` times by the floors of their vectors' means; empty ones stay. A round that moves nothing
    ends the rounds, as later ones would move nothing either.

    Returns one row per kept row: vec_id, cluster, distance (squared, exact), cluster_inertia, inertia
    (sums of distances) and centroid_sha256; sums and distances beyond 64 bits are null. Repeated rows
    count each; of equal ids the smaller vector comes first; null ids are clustered but never start a
    centroid. Fewer vectors than ``k`` give fewer centroids; without any vector that has an id there
    are no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, dims, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")]))
    for _ in range(rounds):
        after = moved(rows, centroids, dims)
        if after == centroids:
            break
        centroids = after
    found = written(nearest_centroids(rows, centroids, dims), "assigned")
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.count(F.when(F.col("distance").isNull(), 1)).alias("beyond")
    )
    inertia = {r["cluster"]: None if r["beyond"] else int(r["inertia"]) for r in sums.collect()}  # k rows
    whole = None if None in inertia.values() else sum(inertia.values())
    fits = lambda v: v if v is not None and v <= LONG else None
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(c, fits(own), fits(whole), digests[c]) for c, own in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same rows in DuckDB SQL, one pair of tables a round (all pairs of vectors and centroids)."""
    parts = [
        f"""rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {scale}) AS HUGEINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims})""",
        f"cells AS MATERIALIZED (SELECT r, unnest(range({dims})) AS d, unnest(x) AS v FROM rows)",
        f"""c0 AS MATERIALIZED (
  SELECT n, unnest(range({dims})) AS d, unnest(x) AS v
  FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), x) - 1 AS n, x FROM rows WHERE vec_id IS NOT NULL)
  WHERE n < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(n, (dist, n)) AS n, min(dist) AS dist
  FROM (SELECT r, n, sum((cells.v - c{i}.v) * (cells.v - c{i}.v)) AS dist FROM cells JOIN c{i} USING (d) GROUP BY r, n)
  GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT n, d, coalesce(CAST((s - ((s % m) + m) % m) // m AS HUGEINT), c{i}.v) AS v
  FROM c{i} LEFT JOIN (SELECT n, d, sum(v) AS s, count(*) AS m FROM cells JOIN a{i} USING (r) GROUP BY n, d) USING (n, d))"""
            )
    parts.append(f"names AS (SELECT n, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY n)")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(n AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
       CAST(sum(dist) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM rows JOIN a{rounds} USING (r) JOIN names USING (n)"""
    )
