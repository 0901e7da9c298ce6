"""Clusters of integer vectors: nearest centroid by a tournament of bisectors, exact means, exact distances.

The vectors nearer to centroid b than to a lie on one side of the plane halfway between them. For integer vectors its
normal 2 (b - a) and threshold |b|^2 - |a|^2 are integers, so the sign of ``x . normal - threshold`` says exactly who is
nearer. Of k centroids, k - 1 such tests leave the nearest one: the winner so far meets the next number, and a zero
keeps the smaller number. Only the distance to the last winner is then computed.

Vectors stay distributed. What travels to tasks is k centroids; what comes back from a task is k counts and sums.

Rows that are dropped, as they have no integer vector: null vectors, other lengths, null or non-finite components, and
components of 2^53 or more after scaling, beyond which doubles skip integers. A vector that occurs twice counts twice.
Rows without vec_id are clustered, and seed a centroid only after all others; rows with one hash seed in order of their
components. With fewer vectors than k there are as many centroids as vectors; without any there is no row. A squared
distance or a sum of them that a long can't hold is null. Columns besides the two named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

BLOCK = 2048
LONG = 1 << 63


@dataclass(frozen=True)
class ClusterParams:
    size: int = 64
    clusters: int = 40
    rounds: int = 5
    scale: int = 256
    seed: str = "2"


Centroids = list[list[int]]


def integer_vectors(rows: DataFrame, params: ClusterParams, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of every row with an integer vector; x holds floor(scale * component) as doubles, all of them exact."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fits = F.coalesce(F.forall("x", lambda c: c.isNotNull() & (F.abs(c) * params.scale < float(1 << 53))), F.lit(False))
    found = rows.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).filter((F.size("x") == params.size) & fits)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("x")
            whole = pa.array(np.floor(params.scale * lists.flatten().to_numpy(zero_copy_only=False)))
            offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * params.size)
            yield pa.record_batch([b.column("vec_id"), pa.ListArray.from_arrays(offsets, whole)], names=["vec_id", "x"])

    return found.mapInArrow(scaled, "vec_id long, x array<double>")


def first_centroids(vectors: DataFrame, params: ClusterParams) -> Centroids:
    """The vectors with the smallest hashes of their ids, in hash order; at most ``clusters`` rows reach the driver."""
    mark = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "x").limit(params.clusters).select("x").collect()
    return [[int(c) for c in r.x] for r in rows]


class Bisectors:
    """The planes between all pairs of centroids, in the number type that keeps every step exact."""

    def __init__(self, centroids: Centroids, largest: int) -> None:
        self.size = len(centroids[0])
        reach = max(largest, max(abs(c) for row in centroids for c in row), 1)
        # Bound of every product sum below: normals reach 4 * reach, distances 4 * reach^2 per component.
        bound = 8 * self.size * reach * reach
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < LONG else object
        self.points = np.array(centroids, dtype=object)
        squares = (self.points * self.points).sum(axis=1)
        self.normals = (2 * (self.points[None, :, :] - self.points[:, None, :])).astype(self.kind)
        self.thresholds = (squares[None, :] - squares[:, None]).astype(self.kind)
        self.points = self.points.astype(self.kind)

    def exact(self, x: np.ndarray) -> np.ndarray:
        if self.kind is object:
            return np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)
        return x.astype(self.kind)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of every row; ties go to the smaller number."""
        best = np.zeros(len(x), np.int64)
        for rival in range(1, len(self.points)):
            side = (x * self.normals[best, rival]).sum(axis=1) - self.thresholds[best, rival]
            best[np.asarray(side > 0, dtype=bool)] = rival
        return best

    def distance(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        away = x - self.points[best]
        return (away * away).sum(axis=1)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix) of at most BLOCK vectors at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            yield part.column("vec_id"), part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _planes(known: Bisectors | None, centroids: Centroids, x: np.ndarray) -> Bisectors:
    """Planes in a number type wide enough for x; they are built again only where a wider one is needed."""
    largest = int(np.abs(x).max(initial=0))
    if known is None or known.kind is not object and 8 * known.size * largest * largest >= (1 << 53 if known.kind is np.float64 else LONG):
        return Bisectors(centroids, largest)
    return known


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids after one round: floor of the mean of the vectors each wins, or itself where it wins none."""
    size = len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, count = None, [0] * len(centroids)
        total = [[0] * size for _ in centroids]
        for _, raw in blocks(batches, size):
            planes = _planes(planes, centroids, raw)
            best = planes.nearest(planes.exact(raw))
            # Wide enough for a block: components stay below 2^53, of which 2^11 are added.
            whole = raw.astype(np.int64) if np.abs(raw).max(initial=0) < 1 << 51 else np.array([[int(c) for c in r] for r in raw.tolist()], dtype=object)
            for c in np.unique(best).tolist():
                won = whole[best == c]
                count[c] += len(won)
                total[c] = [a + int(b) for a, b in zip(total[c], won.sum(axis=0))]
        held = [c for c in range(len(centroids)) if count[c]]
        yield pa.record_batch([
            pa.array(held, pa.int32()), pa.array([count[c] for c in held], pa.int64()),
            pa.array([total[c] for c in held], pa.list_(pa.decimal128(38, 0))),
        ], names=["cluster", "n", "total"])

    parts = vectors.select("vec_id", "x").mapInArrow(sums, "cluster int, n long, total array<decimal(38,0)>")
    cells = parts.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    after = [list(c) for c in centroids]
    for r in cells.collect():
        after[r.cluster][r.at] = int(r.total) // r.n
    return after


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    size = len(centroids[0]) if centroids else 0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for ids, raw in blocks(batches, size):
            planes = _planes(planes, centroids, raw)
            x = planes.exact(raw)
            best = planes.nearest(x)
            away = [int(d) if d < LONG else None for d in planes.distance(x, best).tolist()]
            yield pa.record_batch([ids, pa.array(best.astype(np.int32)), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(nearest, "vec_id long, cluster int, distance long")


def fitted(vectors: DataFrame, params: ClusterParams) -> Centroids:
    """Centroids after all rounds. The driver holds clusters * size numbers, whatever the number of vectors."""
    centroids = first_centroids(vectors, params)
    for _ in range(params.rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    return centroids


def clustered(rows: DataFrame, params: ClusterParams = ClusterParams()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    vectors = durable(integer_vectors(rows, params))
    centroids = fitted(vectors, params)
    found = durable(assigned(vectors, centroids))
    exact = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per_cluster = found.groupBy("cluster").agg(exact.alias("part"), F.count(F.lit(1)).alias("n"))
    # One row per cluster: at most ``clusters`` of them are summed and sent to tasks.
    sums = [(r.cluster, None if r.part is None else int(r.part)) for r in per_cluster.collect()]
    whole = None if any(s is None for _, s in sums) else sum(s for _, s in sums)
    long = lambda s: s if s is not None and s < LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = [(c, long(s), long(whole), digests[c]) for c, s in sums]
    facts = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
