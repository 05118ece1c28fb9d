"""Exact integer clustering around centroids, filtered by an n-simplex projection.

Components become integers floor(256 * x).  The squared distances of a vector
to a few pivots (starting centroids far from each other's span) fix the apex of
a simplex over the pivots: its coordinates in their span and its height over
it.  Two apexes bound the distance of their vectors: with both heights on one
side from below, with one of them turned over from above.  The pivots stay the
same, so the apexes of all vectors are computed once and kept beside them; a
round projects the centroids only.  A centroid whose lower bound is above the
least upper bound, or above the distance of a centroid already compared, is
passed over; the others are compared in exact integers, so the filter changes
no result.  Sums of the clusters are gathered in each task (one row a cluster)
and added by Spark; the driver holds centroids and pivots alone.

Vectors that are null, of another length than ``size`` or hold null or
non-finite components take no part; null ids never precede others as starting
centroids, equal ids start in the order of their components, repeated rows are
vectors of their own, extra columns are ignored, an empty table gives no row.
With fewer vectors than ``k`` there are as many centroids as vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import dropped, stored
from ledgerlens.llm.quantized import lists, matrix, squared, whole_vectors

#: Most pivots; a pivot must rise over the others' span by this share of the widest distance.
PIVOTS, LEAST_HEIGHT = 16, 0.05
#: Share of the squared lengths by which bounds may be off in floating point.
SLACK = 1e-7
#: Rows that are compared at once.
ROWS = 8192


@dataclass
class Simplex:
    """Pivots, and the coordinates of all but the first in their own span (lower triangular)."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, most: int = PIVOTS) -> Simplex:
        """Pivots among ``points``: each next one has the greatest height over the span so far."""
        rest = (points - points[:1]).astype(float)
        heights = np.einsum("ij,ij->i", rest, rest)
        widest, chosen = heights.max(initial=0.0), [0]
        while len(chosen) < min(most, len(points)):
            at = int(heights.argmax())
            if heights[at] <= LEAST_HEIGHT**2 * widest or at in chosen:
                break
            unit = rest[at] / np.sqrt(rest[at] @ rest[at])
            rest -= np.outer(rest @ unit, unit)
            heights = np.einsum("ij,ij->i", rest, rest)
            chosen.append(at)
        pivots = points[chosen]
        gram = (pivots[1:] - pivots[0]).astype(float)
        return cls(pivots, np.linalg.cholesky(gram @ gram.T) if len(gram) else np.empty((0, 0)))

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Apex of each row from its distances to the pivots: coordinates in the span, then the height."""
        d = np.stack([squared(x, p) for p in self.pivots], axis=1).astype(float)
        known = np.einsum("ij,ij->i", self.base, self.base)
        y = np.linalg.solve(self.base, (d[:, :1] - d[:, 1:] + known).T / 2).T if len(known) else np.empty((len(x), 0))
        return np.column_stack([y, np.sqrt(np.maximum(d[:, 0] - np.einsum("ij,ij->i", y, y), 0))])


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties to the smaller number), its squared distance, and the exact comparisons made."""
    span = ((apex * apex).sum(1)[:, None] - 2 * apex[:, :-1] @ tops[:, :-1].T + (tops * tops).sum(1))
    turn = 2 * np.outer(apex[:, -1], tops[:, -1])
    lower, upper = span - turn, span + turn
    slack = SLACK * ((apex * apex).sum(1)[:, None] + (tops * tops).sum(1)) + 1e-3
    near = lower.argmin(1)
    best = squared(x, centroids[near])
    left = (lower <= upper.min(1)[:, None] + slack) & (lower <= best[:, None] + slack)
    left[np.arange(len(x)), near] = False
    compared = len(x)
    for c in np.flatnonzero(left.any(0)).tolist():
        rows = np.flatnonzero(left[:, c])
        rows = rows[lower[rows, c] <= best[rows] + slack[rows, c]]
        d = squared(x[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < near[rows]))
        near[rows[better]], best[rows[better]] = c, d[better]
        compared += len(rows)
    return near, best, compared


def _project(batches: Iterator[pa.RecordBatch], simplex: Simplex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column("q"), simplex.pivots.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), lists(simplex.apexes(x), pa.float64())], ["vec_id", "q", "apex"])


def _assigned(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    tops = simplex.apexes(centroids)
    for whole in batches:
        for a in range(0, len(whole), ROWS):
            batch = whole.slice(a, ROWS)
            x = matrix(batch.column("q"), centroids.shape[1])
            apex = np.asarray(batch.column("apex").flatten()).reshape(len(x), -1)
            yield batch, x, *nearest(x, apex, centroids, tops)[:2]


def _sums(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows and componentwise sums of each cluster in this task."""
    n, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for _, x, near, _ in _assigned(batches, simplex, centroids):
        n += np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        met, first = np.unique(near[order], return_index=True)
        total[met] += np.add.reduceat(x[order], first, axis=0)
    full = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), lists(total[full], pa.int64())], ["cluster", "n", "total"])


def _final(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, _, near, best in _assigned(batches, simplex, centroids):
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])


def clusters(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2", id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of ``size`` finite components.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:id``; each round replaces every
    centroid that has vectors by their componentwise floored mean; then the vectors are assigned once more."""
    spark = df.sparkSession
    vectors = whole_vectors(df, F.col(id_col).cast("long").alias("vec_id"), column=column, size=size)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(mark.asc_nulls_last(), "q").limit(k).collect()  # k rows
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["q"] for r in start], np.int64)
    simplex = Simplex.of(centroids)
    projected = stored(vectors.mapInArrow(partial(_project, simplex=simplex), "vec_id long, q array<int>, apex array<double>"), "apexes")
    for _ in range(rounds):
        parts = projected.select("q", "apex").mapInArrow(partial(_sums, simplex=simplex, centroids=centroids), "cluster int, n long, total array<bigint>")
        before, centroids = centroids, centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(size)]).collect():  # k rows
            centroids[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(size)]
        if (before == centroids).all():  # later rounds would change nothing
            break
    final = stored(projected.mapInArrow(partial(_final, simplex=simplex, centroids=centroids), "vec_id long, cluster int, distance long"), "clusters")
    dropped(projected)
    inertia = {r["cluster"]: int(r["d"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    facts = [(c, d, sum(inertia.values()), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    return final.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
