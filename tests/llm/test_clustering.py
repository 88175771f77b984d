"""Centroid clustering against a plain computation over all pairs."""

import math
from hashlib import sha256

import numpy as np
import pytest

from lintlake.llm import clustering, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, `a.b` int"
KEEP = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * v) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    named = sorted((sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in named[:k]]
    assign = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        found = [(assign(x)[1], x) for _, x in kept]
        for n in range(len(centroids)):
            own = [x for c, x in found if c == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *reversed(assign(x))) for i, x in kept]
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda v: v if v < 1 << 63 else None
    return [(i, c, d, fits(sum(e for _, o, e in found if o == c)), fits(sum(e for _, _, e in found)), digest[c]) for i, c, d in found]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def vectors(seed, n, scale=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    return [(i, [float(np.float32(v)) for v in scale * (middles[i % 5] + 0.4 * rng.normal(size=64))]) for i in range(n)]


@pytest.fixture()
def rows():
    found = vectors(1, 120)
    found += [(200, found[3][1]), (3, found[3][1]), (201, [0.0] * 64), (202, [-0.0001] * 64), (None, found[7][1])]
    found += [(203, None), (204, []), (205, [1.0] * 63), (206, [1.0] * 63 + [None]), (207, [1.0] * 63 + [math.nan]), (208, [math.inf] * 64)]
    return found


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 2) for i, e in rows], SCHEMA)


def result(df):
    assert tuple(df.columns) == KEEP
    return order(tuple(r) for r in df.collect())


def test_equals_plain(spark, rows):
    assert result(clustering.cluster(table(spark, rows))) == order(plain(rows))


@pytest.mark.parametrize("k, rounds", [(1, 3), (3, 0), (40, 2)])
def test_other_settings(spark, rows, k, rounds):
    assert result(clustering.cluster(table(spark, rows), k=k, rounds=rounds)) == order(plain(rows, k, rounds))


def test_large_integers(spark):
    rows = vectors(2, 40, scale=3e5)  # squared distances beyond 64-bit sums of the fast path
    assert result(clustering.cluster(table(spark, rows))) == order(plain(rows))


def test_distances_beyond_64_bits_are_null(spark):
    found = result(clustering.cluster(table(spark, [(1, [0.0] * 64), (2, [4e11] * 64)]), k=1))
    assert [r[2] for r in found] == [None, None] and [r[4] for r in found] == [None, None]


def test_empty_and_few(spark):
    assert result(clustering.cluster(table(spark, []))) == []
    one = [(9, [0.5] * 64)]
    assert result(clustering.cluster(table(spark, one))) == plain(one)


def test_stops_before_all_centroids_are_compared():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-4000, 4000, (32, 64))
    x = centroids[rng.integers(0, 32, 500)] + rng.integers(-60, 60, (500, 64))
    cluster, distance, compared = clustering.SortedLists(centroids).nearest(x)
    want = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    assert compared < 500 * 32  # some are never met


def test_ties_take_the_smaller_number():
    centroids = np.array([[4, 0], [0, 4], [0, 4], [-4, 0]], np.int64)
    cluster, distance, _ = clustering.SortedLists(centroids).nearest(np.array([[0, 0], [0, 4], [-2, 2], [2, 2]], np.int64))
    assert cluster.tolist() == [0, 1, 1, 0] and distance.tolist() == [16, 0, 8, 8]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(queries.op11(spark, sf)) == order(plain(rows))
