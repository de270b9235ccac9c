"""Centroid clustering in whole numbers, by equal-average equal-variance nearest-centroid search.

Vectors become whole numbers, so assignments, means and sums are exact and do not depend on how
rows are dealt to tasks. A round is one pass over the vectors: each task assigns its rows and adds
them up by centroid, and only those sums, one row for each centroid, component and task, are
shuffled. The search sorts the centroids by the mean of their components. For a vector of d
components with mean m and deviation v (the norm of what is left without its mean),
d * (m - m_c)^2 + (v - v_c)^2 is at most the squared distance to centroid c. So from the vector's
mean it goes outward in both directions, ends a direction once the means alone are too far apart,
passes over a centroid whose deviation is too different, and finishes the others in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.batches import received, sent
from factloom.llm.vectors import binary, finite, integers, matrix, unpacked
from factloom.session import written


class Sorted:
    """Centroids by the mean of their components, with their deviations."""

    def __init__(self, centroids: np.ndarray) -> None:
        sums = centroids.sum(axis=1)
        self.number = np.lexsort((np.arange(len(centroids)), sums))
        self.centroid = centroids[self.number]
        self.sum = sums[self.number].astype(np.float64)
        self.deviation, self.norm = _deviation(self.centroid)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance to it, distances computed) of the rows of `x`.

        Of several at the least distance, the smallest number. Bounds are doubles with a margin over
        their rounding, and a candidate at a bound equal to the best distance is still computed.
        """
        n, d = x.shape
        sums = x.sum(axis=1).astype(np.float64)
        deviation, norm = _deviation(x)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, len(self.number))
        start = np.searchsorted(self.sum, sums)
        going = [np.arange(n), np.arange(n)]
        done = 0
        for step in range(len(self.number)):
            for way in (0, 1):
                rows = going[way]
                at = start[rows] - 1 - step if way else start[rows] + step
                inside = (at >= 0) & (at < len(self.number))
                rows, at = rows[inside], at[inside]
                most = best[rows] * (1 + 1e-9) + 1 + 1e-15 * (norm[rows] + self.norm[at])**2
                means = (sums[rows] - self.sum[at])**2 / d
                near = means <= most
                rows, at, most, means = rows[near], at[near], most[near], means[near]
                going[way] = rows
                alike = means + (deviation[rows] - self.deviation[at])**2 <= most
                rows, at = rows[alike], at[alike]
                if not len(rows):
                    continue
                apart = x[rows] - self.centroid[at]
                far = (apart * apart).sum(axis=1)
                done += len(rows)
                better = (far < best[rows]) | (far == best[rows]) & (self.number[at] < number[rows])
                rows = rows[better]
                best[rows], number[rows] = far[better], self.number[at[better]]
            if not len(going[0]) and not len(going[1]):
                break
        return number, best, done


def _deviation(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norm without the mean component, norm) of each row."""
    y = x.astype(np.float64)
    return np.linalg.norm(y - y.mean(axis=1, keepdims=True), axis=1), np.linalg.norm(y, axis=1)


@dataclass(frozen=True)
class Clustering:
    """(vec_id, cluster, distance) of every vector, and the centroids, row by row."""

    assigned: DataFrame
    centroids: np.ndarray


def whole(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): rows (vec_id, embedding) with `dims` finite components, each floor(scale * x), as packed integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "x": binary(integers(matrix(batch.column("embedding"), dims), scale))})
    kept = rows.where(finite("embedding", dims)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.mapInArrow(run, "vec_id long, x binary")


def first_centroids(vectors: DataFrame, k: int, dims: int, key: Column) -> np.ndarray:
    """The `k` vectors of the smallest keys (equal keys: the smaller vector; null ids last); all, if fewer."""
    rows = vectors.select("x", key.alias("_key")).orderBy(F.asc_nulls_last("_key"), "x").limit(k).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in rows], np.int64).reshape(-1, dims)


def _assigned(vectors: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    shipped = sent(vectors, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Sorted(received(shipped))
        for batch in batches:
            if batch.num_rows:
                number, far, _ = index.nearest(unpacked(batch.column("x"), "<i4", dims).astype(np.int64))
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": pa.array(number.astype(np.int32)), "distance": pa.array(far)})
    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _moved(vectors: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after one round: each the componentwise floor of its vectors' mean, an empty one as it was."""
    shipped = sent(vectors, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = received(shipped)
        index, sums = Sorted(held), np.zeros((len(held), dims + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column("x"), "<i4", dims).astype(np.int64)
                number, _, _ = index.nearest(x)
                for c in np.unique(number):
                    mine = x[number == c]
                    sums[c, :dims] += mine.sum(axis=0)
                    sums[c, dims] += len(mine)
        some = np.flatnonzero(sums[:, dims])
        # the last component of a centroid is its count
        yield pa.record_batch({"cluster": pa.array(np.repeat(some, dims + 1).astype(np.int32)), "component": pa.array(np.tile(np.arange(dims + 1, dtype=np.int32), len(some))),
                               "total": pa.array(sums[some].ravel())})
    totals = vectors.mapInArrow(run, "cluster int, component int, total long").groupBy("cluster", "component").agg(F.sum("total").alias("total"))
    found = np.zeros((len(centroids), dims + 1), np.int64)
    # as many rows as the centroids have components
    for r in totals.collect():
        found[r["cluster"], r["component"]] = r["total"]
    n = found[:, dims:]
    return np.where(n > 0, found[:, :dims] // np.maximum(n, 1), centroids)


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, key: Column | None = None) -> Clustering:
    """Clusters of `rows` (vec_id, embedding) by `rounds` rounds of exact k-means over whole numbers.

    Vectors without exactly `dims` components, or with a null or non-finite one, take no part; each
    other component x becomes floor(scale * x). The first centroids are the vectors of the smallest
    `key`, by default the sha256 of `3:` and the id, and are numbered in its order; with fewer
    vectors than `k` there are fewer centroids, and of an empty table there are none. Distances are
    squared and Euclidean; of equally near centroids the smaller number has the vector. Repeated
    rows count each; rows without an id are clustered and give no first centroid while others can;
    further columns are ignored. A component of 2^27 or more is an error.

    The centroids, k times `dims` numbers, are what is broadcast and what a round gives the driver.
    """
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256) if key is None else key
    vectors = written(whole(rows, dims, scale))
    centroids = first_centroids(vectors, k, dims, key)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids, dims)
    return Clustering(_assigned(vectors, centroids, dims), centroids)


def summarised(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of a clustering.

    Inertias are the distances added up, of the cluster and of all; the checksum is of the
    centroid's components in decimal, joined by commas.
    """
    rows = written(found.assigned)
    totals = rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    every = sum(r["inertia"] for r in totals)
    named = [(r["cluster"], r["inertia"], every, hashlib.sha256(",".join(map(str, found.centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in totals]
    # a row for each centroid
    table = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
