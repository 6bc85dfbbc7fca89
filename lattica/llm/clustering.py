"""Centroid clustering of integer vectors, with distances screened by block norms.

Vectors are turned into integers and written once, with the norms of their
segments.  By Cauchy and Schwarz, a vector and a centroid are at least as far
apart as their segments' norms differ:

    |x - c|^2  >=  sum over segments of (|x_s| - |c_s|)^2

so a pass first takes these bounds from the norms alone, measures the centroid
of the least bound exactly, and then measures only the centroids whose bound does
not exceed that distance.  Distances are 64-bit integers; the bounds, in doubles,
are lowered by more than their rounding.  A round is one pass: every task adds up
its vectors' components by cluster, and a few hundred sums a task are shuffled.
Centroids are the only thing that the driver holds.

Only vectors of ``dim`` components, none null or non-finite, take part; so that
squared distances stay within 64 bits, components of ``2**27 / scale`` and more
in size make a vector unusable too.  Each usable row is a vector of its own, with
or without an id, repeated or not; a start needs an id, and starts with equal ids
go by their components.  With fewer usable rows than ``k`` there are as many
centroids as rows with an id; with none, or for an empty table, there is no result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Integers beyond this make a vector unusable.
LARGEST = 1 << 27


def whole_vectors(rows: DataFrame, dim: int = 64, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, q): the usable vectors as integers floor(scale * x)."""
    v = F.transform(F.col(vector), lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = (F.size(F.col(vector)) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST)))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x).cast("int")).alias("q"))


def segment_norms(x: np.ndarray, segment: int) -> np.ndarray:
    """The Euclidean norm of each run of ``segment`` components."""
    starts = np.arange(0, x.shape[1], segment)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1))


def screened(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many distances were measured.

    Of equal distances the smaller number wins.
    """
    c_norms = segment_norms(centroids, segment)
    sizes = (norms**2).sum(axis=1)[:, None] + (c_norms**2).sum(axis=1)[None, :]
    bound = sizes - 2.0 * norms @ c_norms.T - 1e-9 * sizes - 1e-6  # below the true bound, whatever the rounding
    everyone = np.arange(len(x))
    exact = lambda i, c: ((x[i] - centroids[c]) ** 2).sum(axis=1)
    best = np.argmin(bound, axis=1)
    least = exact(everyone, best)
    measured = len(x)
    open_ = bound <= least[:, None]
    open_[everyone, best] = False
    for c in np.flatnonzero(open_.any(axis=0)):
        rows = np.flatnonzero(open_[:, c] & (bound[:, c] <= least))
        d = exact(rows, np.full(len(rows), c))
        measured += len(rows)
        nearer = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
        best[rows[nearer]], least[rows[nearer]] = c, d[nearer]
    return best, least, measured


def _numbers(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def cluster(
    rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, segment: int = 8, seed: int = 1,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance) of the usable vectors, and the centroids.

    The starts are the ``k`` vectors whose ``seed:vec_id`` has the least SHA-256.
    After ``rounds`` rounds of assigning and replacing centroids by the floors of
    their means, vectors are assigned once more.  Centroids without vectors stay.
    """
    width = -(-dim // segment)

    def compress(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            norms = segment_norms(_numbers(part["q"], "int64", dim), segment)
            own = pa.ListArray.from_arrays(pa.array(np.arange(0, norms.size + 1, width, dtype=np.int32)), pa.array(norms.ravel()))
            yield pa.RecordBatch.from_arrays([part["vec_id"], part["q"], own], names=["vec_id", "q", "norms"])

    vectors = cut(whole_vectors(rows, dim, scale, vec_id, vector).mapInArrow(compress, "vec_id long, q array<int>, norms array<double>"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = vectors.where("vec_id is not null").select("q", digest.alias("h")).orderBy("h", "q").limit(k).collect()
    centroids = np.array([r.q for r in sorted(starts, key=lambda r: (r.h, r.q))], np.int64).reshape(-1, dim)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0), centroids

    def nearest(part: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _numbers(part["q"], "int64", dim)
        return x, *screened(x, _numbers(part["norms"], "float64", width), centroids, segment)[:2]

    def sums(centroids: np.ndarray):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for part in parts:
                x, at, _ = nearest(part, centroids)
                order = np.argsort(at, kind="stable")
                own, first = np.unique(at[order], return_index=True)
                if len(own):
                    total[own] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(at, minlength=len(n))
            c, d = np.divmod(np.arange(total.size), dim)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total.ravel()), pa.array(n[c])], names=["c", "d", "s", "n"])

        return run

    for _ in range(rounds):
        added = vectors.mapInArrow(sums(centroids), "c long, d long, s long, n long").groupBy("c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        new = centroids.copy()
        for r in added.collect():  # k times dim rows
            if r.n:
                new[r.c, r.d] = r.s // r.n
        centroids = new

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            _, at, distance = nearest(part, centroids)
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(at.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned(vec_id, cluster, distance)`` with cluster_inertia, inertia and centroid_sha256."""
    assigned = cut(assigned)
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    own = cut(own)  # at most one row a centroid
    own = own.crossJoin(F.broadcast(own.agg(F.sum("cluster_inertia").alias("inertia"))))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    named: Column = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests else F.lit(None).cast("string")
    own = own.withColumn("centroid_sha256", named)
    return assigned.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
