"""Vectors as exact integers: floor(scale * x), for operators whose scores are integers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = 2.0**53


def dimension(df: DataFrame, vec_col: str) -> int:
    """The most frequent vector length (the larger of equally frequent ones); 0 without vectors."""
    first = (df.filter(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count()
             .orderBy(F.desc("count"), F.desc("d")).first())
    return int(first.d) if first else 0


def limit(dim: int) -> int:
    """Components beyond this are cut to it: sums of ``dim`` squared differences stay below 2^63."""
    return min(2**31 - 1, math.isqrt((2**63 - 1) // max(dim, 1)) // 2)


def integers(col: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector of ``dim`` finite components, zero vectors included; their integers)."""
    col = col.cast(pa.list_(pa.float64()))
    size = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((size == dim) & (size > 0))
    x = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim).astype(float)
    ok = np.isfinite(x).all(1)
    most = limit(dim)
    with np.errstate(over="ignore"):
        return rows[ok], np.clip(np.floor(x[ok] * scale), -most, most).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``; in floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` and ``b``."""
    most = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    if 4 * most * most * a.shape[1] < EXACT:
        return (a * a).sum(1)[:, None] - 2 * products(a, b) + (b * b).sum(1)[None, :]
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)
