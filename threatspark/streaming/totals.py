"""Running totals per class as keyed state (R2).

A stateful processor keeps the totals of each key in the state store: packets, bytes and the time of the
last one. A batch moves only its own rows, combined per key before they reach the
processor, and a restarted query goes on from its checkpoint. Every state row carries a version; totals of an older
version are brought to the present one when their key is next seen.

Where a class holds a third of all packets, its rows are added up per task first, so one task
gets a row for each task and key, not the packets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import workers_import

VERSION = 2
STATE = "version int, packets bigint, bytes double, last timestamp"
OUT = "class string, packets bigint, bytes double, last timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upgraded(row: tuple | None) -> tuple[int, float, object]:
    """(packets, bytes, last) of a stored row of any version; version 1 did not know bytes."""
    if row is None:
        return 0, 0.0, None
    version, packets, size, last = row
    return packets, (size if version >= 2 and size is not None else 0.0), last


class Totals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packets, size, last = upgraded(self.total.get() if self.total.exists() else None)
        for part in rows:
            packets += int(part["packets"].sum())
            size += float(part["bytes"].sum())
            seen = part["last"].max()
            if not pd.isna(seen):
                last = seen if last is None else max(pd.Timestamp(last), seen)
        self.total.update((VERSION, packets, size, last))
        yield pd.DataFrame({"class": [key[0]], "packets": [packets], "bytes": [size], "last": [last]})

    def close(self) -> None:
        pass


def _added(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's rows, one per class."""
    parts = [b.groupby("class", as_index=False).agg(packets=("class", "size"), bytes=("length", "sum"), last=("ts", "max"))
             for b in batch if len(b)]
    if parts:
        yield (pd.concat(parts).groupby("class", as_index=False).agg(packets=("packets", "sum"), bytes=("bytes", "sum"), last=("last", "max")))


def running_totals(classified: DataFrame) -> DataFrame:
    """R2: (class, packets, bytes, last), a row for each class that a batch has packets of; packets without a class are left out."""
    workers_import(classified.sparkSession)
    rows = classified.filter("class is not null").select("class", F.col("length").cast("double").alias("length"), "ts")
    added = rows.mapInPandas(_added, "class string, packets bigint, bytes double, last timestamp")
    return added.groupBy("class").transformWithStateInPandas(Totals(), OUT, "Update", "None")


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store, if the session has not chosen one."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key):
        spark.conf.set(key, PROVIDER)


def start_totals(classified: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch's totals below ``out``, a folder per batch, so that a repeated batch replaces its own."""
    use_state_store(classified.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
    w = running_totals(classified).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The totals as of the last batch: (class, packets, bytes, last)."""
    rows = spark.read.schema(f"{OUT}, batch bigint").option("recursiveFileLookup", True).parquet(out)
    return rows.groupBy("class").agg(F.max_by(F.struct("packets", "bytes", "last"), "batch").alias("t")).select("class", "t.*")
