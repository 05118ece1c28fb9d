"""Embedding columns as flat binary rows, bounded samples of them, and k-means on a sample."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of the vectors, the smaller of equals; 0 without any."""
    row = df.filter(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return row[0]["n"] if row else 0


def dtype(df: DataFrame, column: str = "embedding") -> str:
    """float32 where the column holds floats, which it keeps exactly; else float64."""
    return "<f4" if dict(df.dtypes)[column] == "array<float>" else "<f8"


def _flat(batches: Iterator[pa.RecordBatch], dim: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        lengths = np.asarray(column.value_lengths().fill_null(0))
        rows = batch.filter(pa.array((lengths == dim) & np.asarray(column.is_valid()) & np.asarray(batch.column("vec_id").is_valid())))
        if not len(rows):
            continue
        values = rows.column("embedding").flatten()
        x = np.asarray(values.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        x = np.ascontiguousarray(x[good].astype(kind))
        yield pa.RecordBatch.from_pydict({"vec_id": rows.column("vec_id").filter(pa.array(good)), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def usable(df: DataFrame, dim: int, kind: str, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of ``dim`` finite components, not all zero, with an id; x holds the components' bytes."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    return rows.mapInArrow(partial(_flat, dim=dim, kind=kind), "vec_id long, x binary")


def matrix(column: pa.Array | pa.ChunkedArray, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, in double precision, of the original components."""
    a, b = np.abs(x).max(1), np.abs(y).max(1)
    x, y = x / a[:, None], y / b[:, None]  # powers of scale cancel; squares of large components stay finite
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def sample(rows: DataFrame, total: int, most: int, kind: str, dim: int) -> np.ndarray:
    """About ``most`` unit vectors at most, picked by the hash of their ids, on the driver."""
    if not total:
        return np.empty((0, dim))
    share = min(1.0, most / total)
    picked = rows.filter(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("x").toArrow()
    return units(matrix(picked.column("x"), kind, dim)) if picked.num_rows else np.empty((0, dim))


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centers."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centers of at most ``k`` clusters; empty clusters take the rows farthest from theirs."""
    k = max(1, min(k, len(x)))
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = distances(x, centers)
        near = d.argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        full = count > 0
        centers[full] = total[full] / count[full][:, None]
        far = np.argsort(-d[np.arange(len(x)), near], kind="stable")
        centers[~full] = x[far[: (~full).sum()]]
    return centers
