"""Iterative quantisation: a learned rotation to balanced 64-bit codes, and valid vectors.

Valid vectors have the model's dimension, only finite components and a
non-zero norm. The fit reads a bounded sample: the ``SAMPLE`` rows with the least
hash of their id among those that hold such vectors; everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
BITS = 64
ROUNDS = 40
SUBSTRINGS = 4
SUB_BITS = BITS // SUBSTRINGS


@dataclass
class Rotation:
    dim: int
    mean: np.ndarray
    turn: np.ndarray   # (dim, BITS)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One unsigned 64-bit code per row of ``x``."""
        if not len(x):
            return np.zeros(0, np.uint64)
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        bits = ((unit - self.mean) @ self.turn > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def vectors(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the batch that hold a valid vector, the vectors in double precision)."""
    col = col.cast(pa.list_(pa.float64()))
    size = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    if dim is None:
        known = size[size > 0]
        dim = int(np.bincount(known).argmax()) if len(known) else 0
    rows = np.flatnonzero((size == dim) & (size > 0))
    if not len(rows):
        return rows, np.zeros((0, dim))
    flat = col.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim).astype(float)
    ok = np.isfinite(x).all(1)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = (x * x).sum(1)
    ok &= np.isfinite(norm) & (norm > 0)
    return rows[ok], x[ok]


def sample_vectors(df: DataFrame, id_col: str, vec_col: str, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """The valid vectors among the ``sample`` rows of least hash that hold finite, not all zero components."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    usable = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    got = (df.filter(F.coalesce(usable, F.lit(False))).select(vec_col, F.xxhash64(F.col(id_col), F.lit(seed)).alias("_o"))
           .orderBy("_o").limit(sample).select(vec_col).toArrow())
    return vectors(got.column(0).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64())))[1]


def learn(x: np.ndarray, seed: int = 1) -> Rotation:
    """The rotation of a sample of vectors; other seeds give others."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    mean = unit.mean(0)
    c = unit - mean
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    if dim >= BITS:
        _, basis = np.linalg.eigh(c.T @ c)
        basis = basis[:, ::-1][:, :BITS]
    else:
        basis = rng.standard_normal((dim, BITS))
    p = c @ basis
    turn = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
        turn = (u @ vt).T
    return Rotation(dim, mean, basis @ turn)


def fit(df: DataFrame, id_col: str, vec_col: str, sample: int = SAMPLE, seed: int = 1):
    """(rotation or None without a valid vector, the sample's vectors)."""
    x = sample_vectors(df, id_col, vec_col, sample, seed)
    return (learn(x, seed) if len(x) else None), x


def substrings(codes: np.ndarray) -> np.ndarray:
    """(SUBSTRINGS, rows) values of the codes' substrings."""
    mask = np.uint64((1 << SUB_BITS) - 1)
    return np.stack([((codes >> np.uint64(SUB_BITS * k)) & mask).astype(np.int64) for k in range(SUBSTRINGS)])
