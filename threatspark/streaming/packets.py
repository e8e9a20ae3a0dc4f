"""Packet streams.

The reference sniffs packets and appends each to a benign or an attack
capture file by source port. Here the feed is a Structured Streaming source
(files landing in a folder); the split is a filter + class column written
with ``partitionBy('class')`` in append mode, so each class lands in its own
folder. The checkpoint makes the job restartable without duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import labels as L

PACKET_SCHEMA = ("packet_id bigint, ts timestamp, src_ip string, dst_ip string, proto string, "
                 "sport int, dport int, flags string, length double")


def packet_stream(spark: SparkSession, path: str, schema: str = PACKET_SCHEMA,
                  fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Endless packet feed from files arriving under ``path``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def split_packets(packets: DataFrame, host: str = "127.0.0.1") -> DataFrame:
    """P20 + P19: TCP packets of ``host``, classed by source port; packets
    outside both port ranges are discarded."""
    return L.classify_port(L.filter_tcp_host(packets, host), "sport", "class")


def write_split_stream(df: DataFrame, out: str, checkpoint: str,
                       trigger: dict | None = None) -> StreamingQuery:
    """Append benign and attack packets to separate folders as they arrive."""
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("path", out).option("checkpointLocation", checkpoint)
         .partitionBy("class"))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def run_packet_split(spark: SparkSession, src: str, out: str, checkpoint: str,
                     schema: str = PACKET_SCHEMA, fmt: str = "json",
                     trigger: dict | None = None) -> StreamingQuery:
    """S10 -> P20 -> P19 -> S11."""
    return write_split_stream(split_packets(packet_stream(spark, src, schema, fmt)), out,
                              checkpoint, trigger)


def running_counts(classified: DataFrame) -> DataFrame:
    """R2: packets per class since the start. Two keys, so the state is
    bounded without a watermark; use output mode 'complete'."""
    return classified.groupBy("class").agg(F.count(F.lit(1)).alias("count"))


def start_running_counts(classified: DataFrame, checkpoint: str, sink: str = "memory",
                         name: str = "packet_counts", trigger: dict | None = None
                         ) -> StreamingQuery:
    w = (running_counts(classified).writeStream.outputMode("complete").format(sink)
         .option("checkpointLocation", checkpoint))
    if sink == "memory":
        w = w.queryName(name)
    return w.trigger(**(trigger or {"availableNow": True})).start()
