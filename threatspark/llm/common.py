"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatspark.session import ensure_checkpoint_dir, scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of one column that a Python task works on at a time.
SUB_BATCH_BYTES = 8 << 20
_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, on which the memory of tasks depends; set where the session has Spark's default.
ARROW_ROWS = 2_500


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by path.

    On a cluster the package is installed or shipped; the extra path entry
    then names nothing and does no harm.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


#: Hint that keeps a side of a join from being broadcast, whatever Spark takes its size for.
MERGE = "merge"

#: Stores that operators keep in a Python worker from task to task: name -> function that empties it.
worker_stores: dict = {}


def trim() -> None:
    """Give a worker's free memory back to the system, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):    # another C library
        pass


def map_arrow(df: DataFrame, fn, schema: str, store: str | None = None) -> DataFrame:
    """``mapInArrow`` after making sure that workers can import ``fn``.

    A worker that now runs another operator first empties the stores of earlier
    ones; ``store`` names the one that ``fn`` uses.
    """
    workers_import(df.sparkSession)

    def run(batches):
        for name, clear in worker_stores.items():
            if name != store:
                clear()
        trim()
        yield from fn(batches)
        trim()
    return df.mapInArrow(run, schema)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: nothing left to do it with
            return


atexit.register(_drop_all)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; removed when the driver ends."""
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    _written.append((spark, path))
    return path


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored`` and the folder, for callers that drop it (``drop_path``) when it is used up."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, and a lost executor costs no recomputation.
    """
    return stored_at(df, name)[0]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are stored.

    It does so for shuffles that nothing refers to any more. One collection
    drops the references that Python holds, the next one finds the shuffles.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def crc_fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def sub_batches(batch: pa.RecordBatch, column: str, most: int = SUB_BATCH_BYTES):
    """Slices of a batch that hold about ``most`` bytes of ``column`` (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if not n:
        return
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
    part = (np.cumsum(sizes) // most).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        yield batch.slice(int(a), int(b - a))


def texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def with_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns and ``extra``; an extra column replaces one of the same name."""
    names = [n for n in batch.schema.names if n not in extra]
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*cols, *extra.values()], names=[*names, *extra])


def extended_schema(df: DataFrame, extra: dict[str, str]) -> str:
    """DDL of ``df`` with ``extra`` (name -> type) appended, same-named columns replaced."""
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in extra]
    return ", ".join([*own, *(f"`{k}` {v}" for k, v in extra.items())])
