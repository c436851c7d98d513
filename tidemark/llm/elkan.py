"""Exact k-means on integer vectors with Elkan's bounds.

A vector keeps its cluster, an upper bound of its distance to that centroid and a lower
bound of its distance to each. After the centroids have moved, the bounds move by as much,
and only what they and the distances between centroids leave open is computed. Bounds are
rounded away from what they bound, and a centroid is passed over only where it is strictly
farther, so that ties fall to the smaller number as if all distances had been computed.
Those that decide are exact integers.

A round reads a table of the shared folder and writes the next: what is kept of a vector
is k floats and no row meets another. Only k sums of vectors leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import batches, spent, table

#: Components are held within plus or minus this, so that squared distances fit a long.
LARGEST = 1 << 27
#: Bounds give way by this share of what went into them, far more than any rounding.
SLACK = 2.0**-20
_SCHEMA = "vec_id long, vector array<int>, cluster int, upper float, lower binary, distance long"


def quantised(vectors: DataFrame, dims: int, scale: int = 256, column: str = "embedding") -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component, of vectors with exactly dims, all finite.

    Other vectors, null ones too, are left out. Integers beyond LARGEST are held there.
    """
    x = lambda v: v.cast("double")
    bad = lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf"))
    # in steps: filters of their own let no element be null below
    good = vectors.where(F.size(column) == dims).where(~F.exists(column, bad))
    held = lambda v: F.floor(F.least(F.greatest(scale * x(v), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int")
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, held).alias("vector"))


def first_centroids(vectors: DataFrame, k: int, order: Column) -> np.ndarray:
    """The k vectors of smallest order, by which they also stand; ties by the vector. Fewer, if there are fewer."""
    rows = vectors.select(order.alias("by"), "vector").where("by is not null").orderBy("by", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _down(x: np.ndarray, of: np.ndarray | float = 0.0) -> np.ndarray:
    """Less than x; of: what x is a difference of."""
    return np.maximum(x - (np.abs(x) + of) * SLACK, 0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and y."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half of the distances between centroids, rounded down."""
    d = centroids[:, None, :] - centroids[None, :, :]
    return _down(np.sqrt(np.einsum("ijk,ijk->ij", d, d).astype(np.float64)) / 2)


def assigned(x: np.ndarray, centroids: np.ndarray, half: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move own, upper and lower, in place, to the nearest centroids; how many distances that took."""
    k, took = len(centroids), 0
    near = np.where(np.eye(k, dtype=bool), np.inf, half).min(axis=1)
    rows = np.flatnonzero(~(upper < near[own]))
    if not len(rows):
        return 0
    part, mine = x[rows], own[rows]
    least = squared(part, centroids[mine])
    took += len(rows)
    best, low = _up(np.sqrt(least.astype(np.float64))), lower[rows]
    low[np.arange(len(rows)), mine] = _down(np.sqrt(least.astype(np.float64)))
    for j in range(k):
        on = np.flatnonzero((mine != j) & ~(best < low[:, j]) & ~(best < half[mine, j]))
        if not len(on):
            continue
        d = squared(part[on], centroids[j])
        took += len(on)
        root = np.sqrt(d.astype(np.float64))
        low[on, j] = _down(root)
        closer = (d < least[on]) | ((d == least[on]) & (j < mine[on]))
        to = on[closer]
        mine[to], least[to], best[to] = j, d[closer], _up(root[closer])
    own[rows], upper[rows], lower[rows] = mine, best, low
    return took


def _numbers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column(1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.int64)


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """The state after one assignment. moved: how far centroids went since the last, none at first; last: distances are wanted, bounds no more."""
    half, (k, dims) = between(centroids), centroids.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch, dims)
            if moved is None:
                own, upper, lower = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros((n, k))
            else:
                own = batch.column(2).to_numpy().astype(np.int64)
                upper = batch.column(3).to_numpy().astype(np.float64)
                lower = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.float32).reshape(n, k).astype(np.float64)
                upper = _up(upper + moved[own])
                lower = _down(lower - moved, lower + moved)
            assigned(x, centroids, half, own, upper, lower)
            bounds = pa.nulls(n, pa.binary()) if last else pa.array([v.tobytes() for v in _down(lower).astype(np.float32)], pa.binary())
            distance = pa.array(squared(x, centroids[own])) if last else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(_up(upper).astype(np.float32)), bounds, distance], names=["vec_id", "vector", "cluster", "upper", "lower", "distance"])

    return table(batches(state, run, _SCHEMA))


def _sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the clusters' vectors: each task adds up its own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in it:
            x, own = _numbers(batch, dims), batch.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            kinds, at, n = np.unique(own[order], return_index=True, return_counts=True)
            if len(kinds):
                total[kinds] += np.add.reduceat(x[order], at, axis=0)
                count[kinds] += n
        some = np.flatnonzero(count)
        place = np.tile(np.arange(dims + 1, dtype=np.int32), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 1).astype(np.int32)), pa.array(place), pa.array(np.hstack([total, count[:, None]])[some].reshape(-1))], names=["cluster", "place", "n"])

    # k * (dims + 1) rows, whatever the number of vectors; sums in decimals as they may be beyond a long
    parts = batches(state.select("cluster", "vector"), run, "cluster int, place int, n long")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    total, count = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object)
    for r in rows:
        if r["place"] == dims:
            count[r["cluster"]] = int(r["n"])
        else:
            total[r["cluster"], r["place"]] = int(r["n"])
    return total, count


def clustered(vectors: DataFrame, k: int, rounds: int, order: Column, dims: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of its components).

    vectors: (vec_id, vector) as quantised() gives them. The first centroids are the k vectors
    of smallest order. Each round assigns all vectors to their nearest centroid, the smaller
    number on ties, then moves each centroid that has vectors to floor(sum / count); a last
    assignment follows. distance is squared and exact.

    Rows that repeat are vectors of their own. Vectors with a null order, as of a null id,
    begin no cluster but are assigned. Fewer than k vectors make fewer clusters; none, no rows.
    """
    base = table(vectors.select("vec_id", "vector", F.lit(0).alias("cluster"), F.lit(0).cast("float").alias("upper"), F.lit(None).cast("binary").alias("lower"), F.lit(None).cast("long").alias("distance")))
    centroids, moved, state = first_centroids(base, k, order), None, base
    if not len(centroids):
        return state.limit(0).select("vec_id", "cluster", "distance", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.col("vector").cast("array<long>").alias("centroid"))
    for step in range(rounds + 1):
        after = _round(state, centroids, moved, step == rounds)
        spent(state)
        state = after
        if step == rounds:
            break
        total, count = _sums(state, len(centroids), dims)
        new = centroids.copy()
        for j in np.flatnonzero(count):
            new[j] = [int(v) // int(count[j]) for v in total[j]]
        moved = _up(np.sqrt(squared(new, centroids).astype(np.float64)))
        centroids = new
    # k rows at most
    per = {r["cluster"]: r["sum"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    every = sum(per.values())
    rows = [(j, per[j], every, centroids[j].tolist()) for j in sorted(per)]
    known = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
