"""Vectors as exact integers: floor(256 * x) of every component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256.0
#: Integers up to this size keep squared distances of 512 components inside a long.
LARGEST = 1 << 26


def finite(column: str) -> Column:
    """True for a vector that is not null and has only finite components, and at least one."""
    v = F.col(column).cast("array<double>")
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))


def integers(column: str) -> Column:
    """floor(256 * x) of each component as int; an error for a component beyond LARGEST, whose distances a long cannot hold."""
    v = F.transform(F.col(column).cast("array<double>"), lambda x: x * F.lit(SCALE))
    fits = F.forall(v, lambda x: F.abs(x) < float(LARGEST))
    return F.when(fits, F.transform(v, lambda x: F.floor(x).cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {SCALE:g} is beyond {LARGEST}")).cast("array<int>"))


def whole_vectors(df: DataFrame, *columns: Column, column: str = "embedding", size: int | None = None) -> DataFrame:
    """``columns`` and q, the vector's integers, of rows with a finite vector, of ``size`` components where given."""
    keep = finite(column) if size is None else finite(column) & (F.size(column) == size)
    return df.filter(keep).select(*columns, integers(column).alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of the rows of ``x``."""
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(x.ravel(), kind))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows with rows."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)
