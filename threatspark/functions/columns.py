"""Column-level operators: projections, drops, casts, clean-up.

All are lazy ``DataFrame -> DataFrame`` transforms except ``zero_columns``,
which needs one aggregate pass to decide which columns are all zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's lists.
# Identifier and metadata columns of the flow table, dropped before training.
FLOW_IDENTIFIERS = [
    "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port",
    "Protocol", "Timestamp",
]
# Scoring drops one more identifier.
FLOW_IDENTIFIERS_SCORING = FLOW_IDENTIFIERS + ["External IP"]
# Highly correlated flow features removed after ranking (scoring list; the
# training list adds "External IP").
REDUNDANT_FEATURES = [
    "Subflow Bwd Packets", "Idle Mean", "Flow Packets/s", "Flow Duration",
    "Total Backward Packets", "min_seg_size_forward", "Fwd Packet Length Std",
    "Fwd IAT Std", "Flow IAT Std", "Flow IAT Max", "Subflow Fwd Packets",
    "Fwd IAT Max", "Idle Min", "Total Fwd Packets", "Fwd Header Length",
    "Max Packet Length", "Total Length of Bwd Packets", "Bwd Packet Length Std",
    "Fwd Packet Length Mean", "Bwd Packet Length Max", "Total Length of Fwd Packets",
    "Bwd Packet Length Mean", "Packet Length Mean", "Avg Bwd Segment Size",
    "Average Packet Size",
]
REDUNDANT_FEATURES_TRAINING = REDUNDANT_FEATURES + ["External IP"]
# The 36 flow features the trained classifier expects, in order.
FLOW_FEATURES = [
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Bwd Packet Length Min",
    "Flow Bytes/s", "Flow IAT Mean", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean",
    "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max",
    "Bwd IAT Min", "Fwd PSH Flags", "Bwd Header Length", "Fwd Packets/s",
    "Bwd Packets/s", "Min Packet Length", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count",
    "Down/Up Ratio", "Avg Fwd Segment Size", "Subflow Fwd Bytes", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd",
    "Active Mean", "Active Max", "Active Min", "Idle Max",
]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def q(name: str) -> Column:
    """Column by name; names may hold spaces or '/' (never dots)."""
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop by name, silently ignoring names that are absent."""
    present = set(df.columns)
    return df.drop(*[n for n in names if n in present])


def zero_flags(df: DataFrame) -> DataFrame:
    """(column_name, all_zero) of every numeric column, in one aggregate pass (one row per column).

    A null (or NaN) is not 0, so one missing value keeps the column; text
    columns never match; on an empty frame every numeric column qualifies.
    """
    cols = numeric_columns(df)
    flags = [F.struct(F.lit(c).alias("column_name"),
                      F.coalesce(F.every(F.coalesce(q(c) == 0, F.lit(False))), F.lit(True)).alias("all_zero")) for c in cols]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, all_zero boolean")
    return df.agg(F.array(*flags).alias("f")).select(F.inline("f"))


def zero_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns whose every value is 0 (see ``zero_flags``), in their order."""
    zero = {r["column_name"] for r in zero_flags(df).collect() if r["all_zero"]}
    return [c for c in numeric_columns(df) if c in zero]


def drop_zero_columns(df: DataFrame) -> DataFrame:
    return df.drop(*zero_columns(df))


def select_features(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Projection by a dynamic feature list (order kept)."""
    return df.select(*[q(n) for n in names])


def drop_last(df: DataFrame, n: int) -> DataFrame:
    """P5: all but the last ``n`` columns."""
    return df.select(*[q(c) for c in df.columns[: len(df.columns) - n]])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename through a mapping (absent names ignored)."""
    return df.withColumnsRenamed(dict(mapping))


def normalize_columns(df: DataFrame, required: Iterable[str] = ()) -> DataFrame:
    """Trim column names; fail on duplicates or a missing required column."""
    trimmed = [c.strip() for c in df.columns]
    dups = sorted(n for n, k in Counter(trimmed).items() if k > 1)
    if dups:
        raise ValueError(f"duplicate columns after trimming: {dups}")
    out = df.toDF(*trimmed)
    for r in required:
        if r not in trimmed:
            raise KeyError(f"{r!r} is required. Available columns: {trimmed}")
    return out


def to_numeric(df: DataFrame, cols: Iterable[str] | None = None, strict: bool = True,
               to: str = "double") -> DataFrame:
    """Cast columns to numbers. ``strict`` raises on bad text (ANSI cast);
    otherwise bad text becomes null (``try_cast``)."""
    targets = set(df.columns if cols is None else cols)
    out = []
    for c in df.columns:
        if c in targets:
            e = q(c).cast(to) if strict else q(c).try_cast(to)
            out.append(e.alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def drop_null_rows(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with any null."""
    return df.na.drop(how="any", subset=list(subset) if subset is not None else None)


def inf_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """+inf, -inf and NaN count as missing (become null)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)}
    targets = floats if cols is None else floats & set(cols)
    out = []
    for c in df.columns:
        if c in targets:
            x = q(c)
            bad = F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))
            out.append(F.when(bad, F.lit(None)).otherwise(x)
                       .cast(df.schema[c].dataType).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column, e.g. the class label of a one-class file."""
    return df.withColumn(name, F.lit(value))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Numeric narrowing (float32 features, long labels)."""
    return df.withColumns({c: q(c).cast(t) for c, t in types.items()})


def decode_bytes(df: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """Decode every binary column to text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BinaryType):
            out.append(F.decode(q(f.name), charset).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def to_xy(df: DataFrame, label: str, features: Iterable[str] | None = None,
          out: str = "features") -> DataFrame:
    """P25: feature vector + label column (everything else but ``label``)."""
    feats = [c for c in (features or df.columns) if c != label]
    va = VectorAssembler(inputCols=feats, outputCol=out, handleInvalid="keep")
    return va.transform(df.select(*[q(c) for c in feats], q(label))).select(out, q(label))
