"""Centroid clustering (Lloyd's rounds on integer vectors) with Ptolemaic pivots.

For any four points Ptolemy's inequality gives d(x, c) d(p, q) >= |d(x, p) d(c, q) - d(x, q) d(c, p)|. With fixed
pivots p, q whose distances to every vector are stored beside it, each pair of pivots bounds the distance of a vector
from a centroid from below, without a look at the vector. A round takes the centroid of least bound first, and
computes exactly only those whose bound does not exceed the best exact distance so far. Bounds are floating point and
rounded down by more than their error; distances and sums are integers, so the result is exact.

Vectors stay where they are: a round is one scan that yields counts and componentwise sums per (task, cluster), added
up by Spark; k rows reach the driver. Nothing is grouped by vector, so copies of one vector are no hot spot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import pin, unpin

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
PIVOTS = 5  # ten pairs
LARGEST = 1 << 24  # of a component; squared distances stay below 2**56
SLACK = 1e-9  # relative; the error of a bound is below 1e-14 of its terms

VECTORS = "vec_id bigint, v array<int>, to_pivot array<double>"


def vectors(frame: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors, components as integers floor(scale * x).

    A vector is left out if it is null, has another number of components, or one that is null or not finite. A
    component beyond LARGEST fails the job, because its distances would not fit in a long.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e * scale))
    checked = F.when(F.forall(whole, lambda e: F.abs(e) <= LARGEST), whole).otherwise(
        F.raise_error(F.lit(f"a component of {scale} * embedding is beyond {LARGEST}")))
    kept = frame.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), checked.cast("array<int>").alias("v"))


def first_vectors(frame: DataFrame, salt: str, count: int) -> list[np.ndarray]:
    """The ``count`` vectors of least sha256 of ``salt:vec_id``; a null id is empty text, ties go by components."""
    named = frame.withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    return [np.array(r.v, np.int64) for r in named.orderBy("h", "v").limit(count).collect()]


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def squared(v: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from a point."""
    apart = v - point
    return np.einsum("ij,ij->i", apart, apart)


def with_pivots(frame: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """Vectors with their distances from the pivots."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), len(pivots[0]), np.int64)
            far = np.sqrt(np.stack([squared(v, p) for p in pivots], axis=1).astype(np.float64)).reshape(-1)
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(far))],
                                             ["vec_id", "v", "to_pivot"])

    return frame.mapInArrow(measured, VECTORS)


def bounds(to_pivot: np.ndarray, centroid: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """A lower bound of the squared distance of each vector from the centroid, by the best pair of pivots."""
    of = np.sqrt(np.array([((centroid - p) ** 2).sum() for p in pivots], np.float64))
    low = np.zeros(len(to_pivot))
    for a, b in combinations(range(len(pivots)), 2):
        between = np.sqrt(np.float64(((pivots[a] - pivots[b]) ** 2).sum()))
        if between > 0:
            one, other = to_pivot[:, a] * of[b], to_pivot[:, b] * of[a]
            np.maximum(low, (np.abs(one - other) - SLACK * (one + other)) / between, out=low)
    return low * low * (1 - SLACK)


def nearest(v: np.ndarray, to_pivot: np.ndarray, centroids: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed); of equally near centroids the smaller number."""
    rows = np.arange(len(v))
    low = np.stack([bounds(to_pivot, c, pivots) for c in centroids], axis=1)
    cluster = low.argmin(axis=1)
    distance, computed = np.zeros(len(v), np.int64), len(v)
    for k, c in enumerate(centroids):  # the most promising centroid of each vector
        mine = rows[cluster == k]
        distance[mine] = squared(v[mine], c)
    guess = cluster.copy()
    for k, c in enumerate(centroids):
        left = rows[(low[:, k] <= distance) & (guess != k)]
        computed += len(left)
        exact = squared(v[left], c)
        better = (exact < distance[left]) | ((exact == distance[left]) & (k < cluster[left]))
        cluster[left[better]], distance[left[better]] = k, exact[better]
    return cluster, distance, computed


def _assigned(frame: DataFrame, centroids: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), len(centroids[0]), np.int64)
            cluster, distance, _ = nearest(v, _matrix(batch.column("to_pivot"), len(pivots), np.float64), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])

    return frame.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint")


def _moved(frame: DataFrame, centroids: list[np.ndarray], pivots: list[np.ndarray]) -> list[np.ndarray]:
    """The centroids after a round: floor of the mean of their vectors, or as they were without one."""
    width = len(centroids[0])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), width), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), width, np.int64)
            cluster, _, _ = nearest(v, _matrix(batch.column("to_pivot"), len(pivots), np.float64), centroids, pivots)
            for k in np.unique(cluster):
                sums[k] += v[cluster == k].sum(axis=0)
            counts += np.bincount(cluster, minlength=len(centroids))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), *[pa.array(sums[some, i]) for i in range(width)]],
                                         ["cluster", "n", *[f"s{i}" for i in range(width)]])

    shape = "cluster int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width))
    # decimals, because the sum of all tasks may be beyond a long
    total = frame.mapInArrow(summed, shape).groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    out = list(centroids)
    for row in total.collect():
        out[row.cluster] = np.array([int(row[f"s{i}"]) // row.n for i in range(width)], np.int64)
    return out


def clustered(frame: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = "3") -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the vectors of least sha256 of ``salt:vec_id``; with fewer vectors than ``count`` there are as
    many centroids. Repeated rows and ids are vectors of their own; a null id stays null. Other columns are not read.
    An empty table, or one without a usable vector, gives no row.
    """
    spark = frame.sparkSession
    shape = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    plain = vectors(frame, dimensions, scale)
    centroids = first_vectors(plain, salt, count)
    if not centroids:
        return spark.createDataFrame([], shape)
    pivots = first_vectors(plain, "pivot", PIVOTS)
    stored = pin(with_pivots(plain, pivots), "vectors")
    for _ in range(rounds):
        centroids = _moved(stored, centroids, pivots)
    final = pin(_assigned(stored, centroids, pivots), "assigned")
    unpin(stored)
    sums = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = spark.createDataFrame([(k, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest())
                                   for k, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return final.join(F.broadcast(about), "cluster").select(*[c.split()[0] for c in shape.split(", ")])  # one row per centroid
