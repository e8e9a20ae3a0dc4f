"""Batch sources and sinks.

Reads are plain ``spark.read`` calls with explicit options; sinks are
``DataFrame.write`` calls. Nothing passes through the driver except the
small artefacts the reference keeps as lists (feature names).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; filters and column selection made later are pushed into
    it by Catalyst (``PushedFilters`` / ``ReadSchema`` in ``explain``)."""
    return spark.read.parquet(path)


def read_flows(spark: SparkSession, path: str, schema: T.StructType | str | None = None
               ) -> DataFrame:
    """CSV with a header. An explicit schema avoids the inference pass;
    without one, types are inferred (``Infinity``/``NaN`` read as doubles,
    empty cells as null)."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_headerless(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV without a header; columns are numbered _c0, _c1, ..."""
    r = spark.read.option("header", False)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_two_class(spark: SparkSession, attack: str, normal: str, fmt: str = "csv",
                   **options) -> tuple[DataFrame, DataFrame]:
    """S3: read both class files; a missing path fails before any work starts."""
    for p in (attack, normal):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(jpath):
            raise FileNotFoundError(f"data file not found: {p}")
    opts = {"header": True, "inferSchema": True, **options} if fmt == "csv" else options
    return (spark.read.format(fmt).options(**opts).load(attack),
            spark.read.format(fmt).options(**opts).load(normal))


def load_features(spark: SparkSession, path: str, column: str = "Feature") -> list[str]:
    """Feature-name list in file order (a one-column CSV with header, or a
    plain text file with one name per line). The list has one entry per
    feature, so collecting it is bounded."""
    if path.endswith(".txt"):
        df = spark.read.text(path).withColumn("_pos", F.monotonically_increasing_id())
        return [r[0] for r in df.orderBy("_pos").select("value").collect() if r[0].strip()]
    df = spark.read.option("header", True).csv(path)
    df = df.withColumn("_pos", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("_pos").select(column).collect()]


def save_features(spark: SparkSession, names: Sequence[str], path: str,
                  column: str = "Feature") -> None:
    """Write the feature-name list (position kept) as one CSV file."""
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"pos int, {column} string")
    df.coalesce(1).orderBy("pos").select(column).write.mode("overwrite") \
      .option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """CSV sink with a header and no index column."""
    df.write.mode(mode).option("header", header).csv(path)


def read_requests(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON rows (one object per line, or arrays with ``multiLine``);
    malformed rows land in ``_corrupt_record`` instead of failing the job."""
    s = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if "_corrupt_record" not in s.fieldNames():
        s = T.StructType(s.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(s).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def write_scores(df: DataFrame, path: str, cols: Sequence[str] = ("row_id", "p", "decision")
                 ) -> None:
    """Scored rows to ``path/scores``; rows that could not be read or
    scored (corrupt record, null or NaN probability) to ``path/errors`` instead of
    failing the batch."""
    bad = F.col("p").isNull() | F.isnan("p")
    if "_corrupt_record" in df.columns:
        bad = bad | F.col("_corrupt_record").isNotNull()
    df = df.withColumn("_bad", bad)
    df.where(~F.col("_bad")).select(*cols).write.mode("append").parquet(f"{path}/scores")
    err_cols = [c for c in ("row_id", "_corrupt_record") if c in df.columns]
    if err_cols == ["_corrupt_record"]:
        err_cols = df.columns
    df.where(F.col("_bad")).select(*err_cols).write.mode("append").parquet(f"{path}/errors")


def write_history(history: DataFrame, path: str) -> None:
    """Training history as tab-separated text, 4 decimals, with header."""
    cols = ["loss", "accuracy", "val_loss", "val_accuracy"]
    out = history.select(F.col("epoch").cast("string").alias("Epoch"),
                         *[F.format_string("%.4f", F.col(c)).alias(n) for c, n in
                           zip(cols, ["Loss", "Accuracy", "Val Loss", "Val Accuracy"])])
    out.coalesce(1).orderBy(F.col("Epoch").cast("int")).write.mode("overwrite") \
       .option("header", True).option("sep", "\t").csv(path)


def sink_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Size in bytes of every file under a sink folder."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .load(path)
            .select("path", "length"))


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def local_path(path: str) -> str:
    return path if "://" in path else os.path.abspath(path)
