"""Fixed-size arrays that tasks fill and Spark adds up, chunk by chunk."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

CHUNK = 1 << 15
BLOOM_BITS = 25
ODD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "chunk int, cells binary"


def emitted(cells: np.ndarray):
    """A task's array as (chunk, packed cells) rows; all-zero chunks are left out."""
    at = [k for k in range(0, len(cells), CHUNK) if cells[k:k + CHUNK].any()]
    for a in range(0, len(at), 64):
        part = at[a:a + 64]
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([k // CHUNK for k in part], pa.int32()),
            "cells": pa.array([zlib.compress(cells[k:k + CHUNK].tobytes(), 1) for k in part], pa.binary())})


def added(rows: DataFrame, size: int, dtype, add=np.add, finish=None) -> np.ndarray:
    """The arrays that tasks emitted, combined; a task holds its own chunks only.

    The result has ``size`` cells on the driver, whatever the input holds.
    """
    def run(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(c), dtype)
                own[k] = add(own[k], c) if k in own else c
        for k, c in own.items():
            c = finish(c) if finish else c
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()),
                                              "cells": pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())})

    got = map_arrow(rows.repartition("chunk"), run, SCHEMA).toArrow()
    kind = finish(np.zeros(1, dtype)).dtype if finish else np.dtype(dtype)
    out = np.zeros(size, kind)
    for k, c in zip(got.column("chunk").to_pylist(), got.column("cells").to_pylist(), strict=True):
        part = np.frombuffer(zlib.decompress(c), kind)
        out[k * CHUNK:k * CHUNK + len(part)] = part
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bloom_at(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys.view(np.uint64) + ODD)
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def bloom(keys: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Packed bit array of fixed size over a column of longs; it can only let through too much."""
    def run(batches):
        own = np.zeros(1 << bits, bool)
        for b in batches:
            for at in _bloom_at(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                own[at] = True
        yield from emitted(np.packbits(own, bitorder="little"))
    return added(map_arrow(keys, run, SCHEMA), 1 << (bits - 3), np.uint8, np.bitwise_or)


def in_bloom(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _bloom_at(keys, (len(packed) << 3).bit_length() - 1)
    one = np.uint8(1)
    return ((packed[a >> 3] >> (a & 7).astype(np.uint8)) & (packed[b >> 3] >> (b & 7).astype(np.uint8)) & one).astype(bool)
