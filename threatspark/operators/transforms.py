"""Fitted transforms.

A fit step runs one aggregate and returns a small state object (means,
ranges, quantile knots, category lists: bounded by the number of columns and
quantiles, never by the rows). A transform step is a lazy column projection
over that state, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer, OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, q
from ..session import scratch_path
from .sampling import smallest_hash_sample

# Fixed values of the reference's quantile transform.
N_QUANTILES = 1000
QUANTILE_SEED = 10
# Blocks that a column's values are cut into while its quantiles are looked up.
QUANTILE_BLOCKS = 2048
# Features whose scaling rule is written out; code of more outgrows the 8,000 bytes of a method that the JVM compiles.
WRITTEN_OUT = 4


def _double_array(values: Sequence[float]) -> Column:
    """A foldable array<double> literal built from one string (keeps plans small
    when arrays hold hundreds of knots)."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


# --- T1 / T2: mean imputation and min-max --------------------------------------

def impute_mean(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Replace nulls by the column mean (mean over all rows)."""
    cols = list(cols or numeric_columns(df))
    means = df.agg(*[F.avg(q(c)).alias(c) for c in cols]).first().asDict()
    return df.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(means[c]).cast("double"))
                           for c in cols})


@dataclass
class MinMaxState:
    mean: dict
    lo: dict
    hi: dict


def fit_impute_minmax(df: DataFrame, cols: Iterable[str] | None = None) -> MinMaxState:
    """One pass for mean, min and max. After mean imputation min and max do
    not change (the mean lies between them), so no second pass is needed."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(q(c)).alias(f"m{i}"), F.min(q(c)).cast("double").alias(f"l{i}"),
                 F.max(q(c)).cast("double").alias(f"h{i}")]
    r = df.agg(*aggs).first()
    return MinMaxState({c: r[f"m{i}"] for i, c in enumerate(cols)},
                       {c: r[f"l{i}"] for i, c in enumerate(cols)},
                       {c: r[f"h{i}"] for i, c in enumerate(cols)})


def apply_impute_minmax(df: DataFrame, st: MinMaxState, impute: bool = True) -> DataFrame:
    """T1+T2: (x - min) / (max - min) after imputation; a constant column gives
    0/0, which is missing (null), as in the reference."""
    out = {}
    for c in st.lo:
        x = q(c).cast("double")
        if impute:
            x = F.coalesce(x, F.lit(st.mean[c]).cast("double"))
        out[c] = F.try_divide(x - F.lit(st.lo[c]).cast("double"),
                              F.lit(st.hi[c]).cast("double") - F.lit(st.lo[c]).cast("double"))
    return df.withColumns(out)


def min_max(df: DataFrame, cols: Iterable[str] | None = None, impute: bool = False) -> DataFrame:
    return apply_impute_minmax(df, fit_impute_minmax(df, cols), impute=impute)


# --- T3 / T4: quantile transform ------------------------------------------------

def quantile_refs(n: int) -> list[float]:
    """Evenly spaced references 0 .. 1 (n points)."""
    return [0.0] if n == 1 else [j / (n - 1) for j in range(n)]


@dataclass
class QuantileModel:
    """Knots per feature: distinct quantile values with the lowest and highest
    reference that maps to each (ties in the data give repeated quantiles)."""
    features: list
    knots: dict = field(default_factory=dict)
    ref_lo: dict = field(default_factory=dict)
    ref_hi: dict = field(default_factory=dict)

    # T3
    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], key_cols: Sequence[str] = (),
            n_quantiles: int = N_QUANTILES, subsample: int | None = None,
            seed=QUANTILE_SEED, n_rows: int | None = None, hash_col: str | None = None
            ) -> "QuantileModel":
        """Exact linear percentiles over all rows. ``subsample`` fits on that many rows
        instead, the smallest md5 keys of ``key_cols``."""
        if not subsample:
            return cls.from_state(quantile_state(df, cols, n_quantiles), cols)
        sample = smallest_hash_sample(df, key_cols, seed, subsample, hash_col, n_rows)
        try:
            return cls.from_state(quantile_state(sample, cols, n_quantiles), cols)
        finally:
            sample.unpersist()

    @classmethod
    def from_state(cls, state: DataFrame, cols: Sequence[str] | None = None) -> "QuantileModel":
        rows = state.orderBy("feature", "knot").collect()   # bounded: features x quantiles
        m = cls(list(cols) if cols else sorted({r["feature"] for r in rows}))
        for r in rows:
            m.knots.setdefault(r["feature"], []).append(r["knot"])
            m.ref_lo.setdefault(r["feature"], []).append(r["ref_lo"])
            m.ref_hi.setdefault(r["feature"], []).append(r["ref_hi"])
        return m

    def state(self, spark: SparkSession) -> DataFrame:
        rows = [(f, k, lo, hi) for f in self.features if f in self.knots
                for k, lo, hi in zip(self.knots[f], self.ref_lo[f], self.ref_hi[f])]
        return spark.createDataFrame(
            rows, "feature string, knot double, ref_lo double, ref_hi double")

    # S12
    def save(self, spark: SparkSession, path: str) -> None:
        self.state(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantileModel | None":
        """Absent path -> None, meaning 'no scaling'."""
        try:
            return cls.from_state(spark.read.parquet(path))
        except Exception as e:  # noqa: BLE001 - AnalysisException for a missing path
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return None
            raise

    # T4
    def segment(self, f: str, at: Column) -> dict[str, Column]:
        """A feature's segment number ``at`` (from 0): left knot, middle of its references, right end of them,
        width and rise up to the next knot. Each comes by place from a literal array of at most n_quantiles values;
        the arrays are folded once (one of structs would be built anew for every row)."""
        k, lo, hi = self.knots[f], self.ref_lo[f], self.ref_hi[f]
        n = len(k)
        cols = [k, [(a + b) / 2 for a, b in zip(lo, hi)], hi, [k[i + 1] - k[i] if i + 1 < n else 1.0 for i in range(n)],
                [lo[i + 1] - hi[i] if i + 1 < n else 0.0 for i in range(n)]]
        return {m: F.get(_double_array(c), at) for c, m in zip(cols, ("knot", "mid", "end", "width", "rise"))}

    def transform(self, df: DataFrame, compact: bool = False) -> DataFrame:
        """Uniform output in [0, 1]: <= min -> 0, >= max -> 1, a knot -> the
        middle of its reference range, between knots -> linear interpolation.
        Nulls stay null and NaN becomes null. A projection: the knot interval of each value comes from a
        Bucketizer (binary search in the JVM), its segment by place from the feature's literal array. Of more
        than WRITTEN_OUT features, or if ``compact`` (for columns that are computed themselves, whose code is repeated
        at each use), the rule goes through a one-element array and a lambda."""
        feats = [f for f in self.features if f in df.columns and self.knots.get(f)]
        if not feats:
            return df
        bcols = {f: f"_qb{i}" for i, f in enumerate(feats)}
        buck = Bucketizer(
            splitsArray=[[-math.inf, *self.knots[f], math.inf] for f in feats],
            inputCols=feats, outputCols=[bcols[f] for f in feats], handleInvalid="keep")

        def rule(f: str, x: Column, bucket: Column) -> Column:
            s = self.segment(f, bucket.cast("int") - 1)
            return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
                    .when(x <= F.lit(self.knots[f][0]), F.lit(0.0))
                    .when(x >= F.lit(self.knots[f][-1]), F.lit(1.0))
                    .when(x == s["knot"], s["mid"])
                    .otherwise(s["end"] + (x - s["knot"]) / s["width"] * s["rise"]))

        def scaled(f: str) -> Column:
            x, bucket = q(f).cast("double"), F.col(bcols[f])
            if not compact and len(feats) <= WRITTEN_OUT:
                return rule(f, x, bucket)
            one = F.array(F.struct(x.alias("x"), bucket.alias("b")))
            return F.get(F.transform(one, lambda t: rule(f, t["x"], t["b"])), F.lit(0))
        return buck.transform(df).withColumns({f: scaled(f) for f in feats}).drop(*bcols.values())


def _quantile_blocks(df: DataFrame, k: int) -> tuple[int, list[int], list[list[float]]]:
    """Rows, non-null values per column and cut points per column (at most QUANTILE_BLOCKS),
    of the columns ``_v0`` ... in one aggregate. The cuts only spread the work: any will do."""
    parts = _double_array([j / QUANTILE_BLOCKS for j in range(1, QUANTILE_BLOCKS)])
    r = df.agg(F.count(F.lit(1)).alias("n"), *[x for i in range(k) for x in (
        F.count(f"_v{i}").alias(f"n{i}"),
        F.percentile_approx(f"_v{i}", parts, 10 * QUANTILE_BLOCKS).alias(f"c{i}"))]).first()
    cuts = [sorted({x + 0.0 for x in r[f"c{i}"] or []}) or [0.0] for i in range(k)]
    return r["n"], [r[f"n{i}"] for i in range(k)], cuts


def _order_statistics(df: DataFrame, wanted: list[list[int]], cuts: list[list[float]]) -> dict:
    """(column number, position) -> value at that 0-based position of the sorted non-null values.

    Values are counted per block between cuts; the positions' blocks are looked up in
    those counts (columns x blocks, on the driver), and only the values of these
    blocks are ranked, each distinct value once.
    """
    k = len(cuts)
    blocks = Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts],
                        inputCols=[f"_v{i}" for i in range(k)], outputCols=[f"_b{i}" for i in range(k)],
                        handleInvalid="keep").transform(df)
    long = blocks.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").cast("int").alias("b"), F.col(f"_v{i}").alias("v"))
        for i in range(k)])).alias("x")).select("x.*").where("v IS NOT NULL")
    starts: list[list[int]] = [[] for _ in range(k)]
    names: list[list[int]] = [[] for _ in range(k)]
    total = [0] * k
    for r in sorted(long.groupBy("f", "b").count().collect()):       # at most columns x blocks rows
        starts[r["f"]].append(total[r["f"]])
        names[r["f"]].append(r["b"])
        total[r["f"]] += r["count"]
    need: dict[tuple[int, int], list[int]] = {}
    first: dict[tuple[int, int], int] = {}
    for f, positions in enumerate(wanted):
        for p in positions:
            at = bisect_right(starts[f], p) - 1
            need.setdefault((f, names[f][at]), []).append(p - starts[f][at])
            first[f, names[f][at]] = starts[f][at]
    if not need:
        return {}
    spark = df.sparkSession
    # at most two positions per column and quantile
    table = F.broadcast(spark.createDataFrame([(f, b, ps) for (f, b), ps in need.items()],
                                              "f int, b int, wanted array<bigint>"))
    counts = long.join(table, ["f", "b"], "left_semi").groupBy("f", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("f", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = (counts.withColumn("upto", F.sum("n").over(w)).join(table, ["f", "b"])
             .select("f", "b", "v", F.explode(F.filter(
                 "wanted", lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))).alias("p")))
    return {(r["f"], first[r["f"], r["b"]] + r["p"]): r["v"] for r in found.collect()}


def quantile_state(df: DataFrame, cols: Sequence[str], n_quantiles: int = N_QUANTILES) -> DataFrame:
    """Long-form knot table ``(feature, knot, ref_lo, ref_hi)``, exact over all rows.

    Quantiles are linear-interpolated percentiles at evenly spaced references
    (n = min(n_quantiles, rows)) of the finite values; null, NaN and infinities
    are missing. They are made non-decreasing with a running max, then grouped by value so
    each distinct knot keeps its lowest and highest reference. A column without
    values has no knots. ``df`` is read three times.
    """
    spark = df.sparkSession
    # NaN counts as greater than infinity, so this keeps the finite values
    d = df.select(*[F.when(F.abs(x) < F.lit(math.inf), x).alias(f"_v{i}")
                    for i, x in enumerate(q(c).cast("double") for c in cols)])
    schema = "feature string, knot double, ref_lo double, ref_hi double"
    if not cols:
        return spark.createDataFrame([], schema)
    n_rows, sizes, cuts = _quantile_blocks(d, len(cols))
    refs = quantile_refs(max(1, min(n_quantiles, n_rows)))
    at = [[ref * (n - 1) for ref in refs] if n else [] for n in sizes]
    wanted = [sorted({p for x in xs for p in (math.floor(x), math.ceil(x))}) for xs in at]
    value = _order_statistics(d, wanted, cuts)
    rows = []
    for f, c in enumerate(cols):
        knots: dict[float, list[float]] = {}
        top = -math.inf
        for ref, x in zip(refs, at[f]):
            lo, hi = value[f, math.floor(x)], value[f, math.ceil(x)]
            part = x - math.floor(x)
            top = max(top, lo + (hi - lo) * part)     # equal neighbours give their own value
            knots.setdefault(top, [ref, ref])[1] = ref
        rows += [(c, knot, lo, hi) for knot, (lo, hi) in knots.items()]
    return spark.createDataFrame(rows, schema)


# --- T5: standardisation (population std) ---------------------------------------

@dataclass
class StandardState:
    mean: dict
    scale: dict


def fit_standardize(train: DataFrame, cols: Sequence[str]) -> StandardState:
    """Mean and population std; a zero std scales by 1 (column only centred)."""
    r = train.agg(*[x for i, c in enumerate(cols)
                    for x in (F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c)).alias(f"s{i}"))]
                  ).first()
    mean = {c: r[f"m{i}"] for i, c in enumerate(cols)}
    scale = {c: (r[f"s{i}"] if r[f"s{i}"] not in (None, 0.0) else 1.0)
             for i, c in enumerate(cols)}
    return StandardState(mean, scale)


def apply_standardize(df: DataFrame, st: StandardState) -> DataFrame:
    return df.withColumns({c: (q(c).cast("double") - F.lit(st.mean[c])) / F.lit(st.scale[c])
                           for c in st.mean})


def standardize(train: DataFrame, test: DataFrame, cols: Sequence[str]
                ) -> tuple[DataFrame, DataFrame]:
    """T5: fit on train, apply to both."""
    st = fit_standardize(train, cols)
    return apply_standardize(train, st), apply_standardize(test, st)


# --- T6: one-hot with the first category dropped --------------------------------

def category_values(df: DataFrame, cols: Sequence[str], max_categories: int | None = None
                    ) -> dict:
    """Sorted distinct non-null values per text column; each becomes a column of the
    result. ``max_categories`` fails on columns that have more, by the exact count.
    For columns of very many values see ``sparse_dummies``."""
    cols = list(cols)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), q(c).alias("v")) for i, c in enumerate(cols)])).alias("t"))
    values = long.select("t.i", "t.v").filter("v is not null").distinct()
    if max_categories is not None:
        big = [cols[r.i] for r in values.groupBy("i").count().filter(F.col("count") > max_categories).collect()]
        if big:
            raise ValueError(f"more than {max_categories} categories to one-hot encode: {big}")
    out: dict = {c: [] for c in cols}
    for r in values.collect():          # one row per column of the result
        out[cols[r.i]].append(r.v)
    return {c: sorted(v) for c, v in out.items()}


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, idx): the distinct non-null values of a column, numbered from 0 in their order.

    Values are dealt out by ranges; a range's numbers follow those of the ranges before it, so
    no task holds the dictionary.
    """
    path = scratch_path(df.sparkSession, "dictionary")
    values = df.select(q(col).alias("value")).filter("value is not null").distinct()
    parts = values.repartitionByRange("value").sortWithinPartitions("value").withColumn("id", F.monotonically_increasing_id())
    parts.write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    part = F.shiftrightunsigned("id", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row per range
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_part = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return (rows.withColumn("part", part).join(starts, "part")
            .select("value", (F.col("start") + in_part).alias("idx")))


#: Pieces that the rows of one value are dealt into when their numbers are joined to them.
VALUE_SALTS = 8


def sparse_dummies(df: DataFrame, cols: Sequence[str], out: str = "onehot", drop_first: bool = True
                   ) -> tuple[DataFrame, dict[str, int]]:
    """T6 for columns of any number of values: one sparse vector per column, ``<out>_<col>``.

    Place k stands for the value numbered k (k + 1 with ``drop_first``) in the column's ``dictionary``; null, and
    with ``drop_first`` the first value, give a vector of zeros. Returns (rows, vector size
    per column). No value list reaches the driver; numbers are joined by value, a frequent one in pieces.
    """
    cols, sizes = list(cols), {}
    for c in cols:
        names = dictionary(df, c)
        n = names.count()
        width = max(n - 1 if drop_first else n, 0)
        sizes[c] = width
        salts = F.explode(F.sequence(F.lit(0), F.lit(VALUE_SALTS - 1)))
        own = names.select(F.col("value").alias("_value"), F.col("idx").alias("_idx"), salts.alias("_salt"))
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*[q(x) for x in df.columns]), F.lit(VALUE_SALTS)).cast("int"))
        df = df.join(own, (q(c) == F.col("_value")) & (df["_salt"] == own["_salt"]), "left").drop("_value", "_salt")
        # the encoder leaves out its last place: null and a dropped first value go there
        code = F.col("_idx") - (1 if drop_first else 0)
        df = df.withColumn("_code", F.when(code >= 0, code).otherwise(F.lit(width)).cast("double")).drop("_idx")
        if width:
            encoder = OneHotEncoder(inputCols=["_code"], outputCols=[f"{out}_{c}"], dropLast=True, handleInvalid="error")
            last = df.sparkSession.range(width + 1).select(F.col("id").cast("double").alias("_code"))
            df = encoder.fit(last).transform(df)
        else:
            df = df.withColumn(f"{out}_{c}", array_to_vector(F.array().cast("array<double>")))
        df = df.drop("_code")
    return df, sizes


def dummies(df: DataFrame, cols: Sequence[str] | None = None, drop_first: bool = True,
            values: dict | None = None) -> DataFrame:
    """0/1 indicator per category value named ``<col>_<value>``; the first
    value in sort order is dropped; a null row gets 0 everywhere; other columns
    come first, untouched."""
    cols = list(cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    values = values or category_values(df, cols)
    keep = [q(c) for c in df.columns if c not in cols]
    ind = []
    for c in cols:
        vs = values[c][1:] if drop_first else values[c]
        ind += [F.coalesce((q(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
                for v in vs]
    return df.select(*keep, *ind)
