"""Profiling aggregates.

Column statistics are authored as ONE aggregate with many expressions, so a
table is scanned once however many columns are profiled; partial aggregation
runs on every task before the (tiny) final merge.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, q


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """A1."""
    return df.select(q(c)).distinct()


def value_counts(df: DataFrame, c: str, out: str = "count") -> DataFrame:
    """A2: counts per value, nulls ignored, most frequent first."""
    return (df.where(q(c).isNotNull()).groupBy(q(c)).agg(F.count(F.lit(1)).alias(out))
              .orderBy(F.col(out).desc(), q(c)))


def shape(df: DataFrame) -> DataFrame:
    """A3: (n_rows, n_columns) as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def profile(df: DataFrame) -> DataFrame:
    """A4: one row per column: name, type, non-null count (one scan)."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, dtype string, non_null bigint")
    counts = df.agg(*[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', '{t}', c{i}"
                      for i, (c, t) in enumerate(df.dtypes))
    return counts.selectExpr(f"stack({len(df.columns)}, {stack}) as (column, dtype, non_null)")


def has_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """A5: per column, whether any value is null (one row)."""
    cols = list(cols or df.columns)
    return df.agg(*[F.coalesce(F.bool_or(q(c).isNull()), F.lit(False)).alias(c) for c in cols])


def column_means(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Mean of every numeric column, nulls skipped (one row)."""
    cols = list(cols or numeric_columns(df))
    return df.agg(*[F.avg(q(c)).alias(c) for c in cols])


def column_ranges(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Min and max of every column, long form (column, min, max)."""
    cols = list(cols or numeric_columns(df))
    wide = df.agg(*[x for i, c in enumerate(cols)
                    for x in (F.min(q(c)).cast("double").alias(f"lo{i}"),
                              F.max(q(c)).cast("double").alias(f"hi{i}"))])
    stack = ", ".join(f"'{c}', lo{i}, hi{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column, min, max)")


def class_counts(df: DataFrame, c: str = "class", out: str = "count") -> DataFrame:
    """Rows per class."""
    return df.groupBy(q(c)).agg(F.count(F.lit(1)).alias(out))


def count_below(imp: DataFrame, threshold: float, col: str = "Importance",
                out: str = "n_below") -> DataFrame:
    """How many features fall under an importance threshold."""
    return imp.agg(F.count_if(q(col) < F.lit(threshold)).alias(out))


def sort_desc(df: DataFrame, by: str, tie: Sequence[str] = ()) -> DataFrame:
    """L1: descending sort with a deterministic tie-break."""
    return df.orderBy(q(by).desc(), *[q(t) for t in tie])


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """L2: first ``n`` rows in key order (TakeOrdered: n rows per task)."""
    return df.orderBy(*[q(c) for c in order]).limit(n)
