"""Clusters by bounds against all distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def _plain(rows, k, rounds):
    """rows: (vec_id, list of ints); all distances, in Python's integers."""
    order = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted((r for r in rows if r[0] is not None), key=order)[:k]]
    for step in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in rows]
        if step == rounds:
            return own, centroids
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, at) in zip(rows, own, strict=True) if at == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]


def _order():
    return F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)


@pytest.mark.parametrize(("kind", "k", "n"), [("grid", 6, 300), ("grid", 40, 30), ("close", 7, 250), ("far", 5, 200), ("same", 4, 50), ("blobs", 8, 400)])
def test_clusters(spark, kind, k, n):
    """Many ties on grids, components near the largest, copies, and fewer vectors than clusters."""
    from tidemark.llm.elkan import LARGEST, clustered

    rng = np.random.default_rng(n)
    x = {"grid": rng.integers(-2, 3, (n, 4)), "close": rng.integers(-300, 300, (n, 4)), "far": rng.choice([-LARGEST, LARGEST, 0, LARGEST - 1], (n, 4)), "same": np.full((n, 4), 9), "blobs": rng.integers(0, 4, (n, 1)) * 1000 + rng.integers(-40, 40, (n, 4))}[kind]
    rows = [(i if i % 37 else None, v) for i, v in enumerate(x.tolist())] + [(1, x[1].tolist()), (2, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, vector array<int>").repartition(3)
    want, centroids = _plain(rows, k, 3)
    got = clustered(df, k, 3, _order(), 4).collect()
    assert sorted((r.vec_id or -1, r.cluster, r.distance) for r in got) == sorted((i or -1, j, d) for (i, _), (d, j) in zip(rows, want, strict=True))
    assert all(r.centroid == centroids[r.cluster] and r.cluster_inertia == sum(d for d, j in want if j == r.cluster) and r.inertia == sum(d for d, _ in want) for r in got)


def test_bounds_save_distances():
    """Bounds pass most distances over, and never the nearest."""
    from tidemark.llm.elkan import _down, _up, assigned, between, squared

    rng = np.random.default_rng(5)
    where = rng.integers(-5000, 5000, (12, 8))
    x = where[rng.integers(0, 12, 2000)] + rng.integers(-60, 60, (2000, 8))
    centroids = where + rng.integers(-50, 50, where.shape)
    own, upper, lower = np.zeros(2000, dtype=np.int64), np.full(2000, np.inf), np.zeros((2000, 12))
    assert assigned(x, centroids, between(centroids), own, upper, lower) < 2000 * 12
    moved = centroids + rng.integers(-3, 4, centroids.shape)
    by = _up(np.sqrt(squared(moved, centroids).astype(float)))
    upper, lower = _up(upper + by[own]), _down(lower - by, lower + by)
    took = assigned(x, moved, between(moved), own, upper, lower)
    d = np.stack([squared(x, c) for c in moved], axis=1)
    assert np.array_equal(own, d.argmin(axis=1)) and took < 2000 * 2 and (lower**2 <= d).all() and (upper**2 >= d.min(axis=1)).all()


def test_odd_vectors(spark):
    from tidemark.llm.elkan import LARGEST, clustered, quantised

    rows = [(0, [0.5, -0.001]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, []), (7, [1e30, -1e30]), (None, [0.25, 0.0]), (0, [0.5, -0.001])]
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "vec_id long, embedding array<float>, cluster string, distance double")
    found = quantised(df, 2)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(0, [128, -1]), (0, [128, -1]), (7, [LARGEST, -LARGEST]), (None, [64, 0])]))
    assert clustered(found, 3, 2, _order(), 2).count() == 4
    none = clustered(found.limit(0), 3, 2, _order(), 2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
