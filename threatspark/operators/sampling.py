"""Exact, repeatable sampling and splits (K1-K6, L3).

Every operator needs "the k rows with the smallest random key", with exact
sizes and the same members on every run. The random key is
``md5(seed ':' key...)`` over integer key columns, which any SQL engine can
recompute. A plain ``row_number()`` over the whole table (or over one class)
would put all rows in one task, so the rank is built in two levels:

1. the first ``hex_digits`` hex characters of the hash pick one of
   16**hex_digits buckets, so every class (however large its share) is
   spread evenly over many buckets;
2. rows are counted per (class, bucket); a running sum over that small table
   gives each bucket's offset;
3. rank = bucket offset + ``row_number()`` inside (class, bucket).

Where only the first k rows matter (K1-K3, K6), no rank is needed: ``first_rows`` finds the
cut-off row from counts per hash prefix, and rows are kept or marked in place.

For ranks, the big table is shuffled once, on (class, bucket), for the window inside
the bucket; the counts are a partial aggregate that moves one row per bucket
and task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q

HASH, BUCKET, OFFSET = "_ts_hash", "_ts_bucket", "_ts_offset"


def hash_key(seed, key_cols: Sequence[str]) -> Column:
    """md5 of 'seed:k1:k2...' over the (integer) key columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[q(c).cast("string") for c in key_cols]))


# Largest offsets table broadcast on a proven bound (rows).
BROADCAST_MAX_ROWS = 1 << 20


def ordered_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                 blocks: Sequence[Column | str], out: str = "rank",
                 max_blocks: int | None = None) -> DataFrame:
    """Dense 1-based position of each row inside its ``by`` group in the given
    ``order``, computed in two levels so a hot group never sits in one task.

    ``blocks`` are columns that are non-decreasing along ``order`` (a prefix
    of it, a coarser version of it, a hash bucket when the order starts with
    that hash, ...). Rows are counted per (group, block); a running sum over
    that small table gives each block's offset; the position is the offset
    plus ``row_number()`` inside (group, block). The rows are shuffled once,
    on (group, block); only the counts (one row per block and task after
    partial aggregation) move again. ``max_blocks`` is a proven upper bound
    on the number of (group, block) pairs, when the caller has one.
    """
    by = list(by)
    bnames = [f"_ts_b{i}" for i in range(len(blocks))]
    d = df.withColumns({n: (q(b) if isinstance(b, str) else b) for n, b in zip(bnames, blocks)})
    keys = [*by, *bnames]
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(*bnames).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(OFFSET))
    inner = Window.partitionBy(*keys).orderBy(*[q(o) if isinstance(o, str) else o for o in order])
    ranked = d.withColumn("_ts_rn", F.row_number().over(inner))
    # offsets: at most one row per (group, block). Its window leaves it
    # partitioned by the group alone, which would also satisfy the join and
    # pull a hot group into one task; repartitioning the small side on all
    # join keys keeps the ranked side's (group, block) spread. AQE may still
    # broadcast it when it is small at run time.
    if max_blocks is not None and max_blocks <= BROADCAST_MAX_ROWS:
        offsets = F.broadcast(offsets)          # bounded: at most max_blocks rows
    else:
        offsets = offsets.repartition(*[q(k) for k in keys])
    # null groups and blocks are groups like any other: the join is null-safe
    offsets = offsets.withColumnsRenamed({k: f"_ts_o_{k}" for k in keys})
    same = [q(k).eqNullSafe(q(f"_ts_o_{k}")) for k in keys]
    return (ranked.join(offsets, on=same, how="inner").drop(*[f"_ts_o_{k}" for k in keys])
                  .withColumn(out, (F.col(OFFSET) + F.col("_ts_rn")).cast("bigint"))
                  .drop(*bnames, OFFSET, "_ts_rn"))


ROWS_PER_BUCKET = 1_000_000


def rank_hex_digits(n_rows: int | None) -> int:
    """Hash-prefix length for the rank buckets: 4 hex digits (65,536 buckets)
    up to ~6.5e10 rows, then one more digit per 16x, so a bucket keeps about
    a million rows or fewer (at most 8 digits)."""
    if not n_rows:
        return 4
    return max(4, min(8, math.ceil(math.log(max(n_rows / ROWS_PER_BUCKET, 1.0), 16))))


def hash_rank(df: DataFrame, key_cols: Sequence[str], seed, by: Sequence[str] = (),
              out: str = "rank", hex_digits: int | None = None, hash_col: str | None = None,
              n_rows: int | None = None) -> DataFrame:
    """Dense 1-based rank of each row inside its ``by`` group, ordered by
    (md5(seed, key), key): ``ordered_rank`` with the first ``hex_digits`` hex
    characters of the hash as the block, so every group, however large its
    share, is spread evenly over 16**hex_digits blocks. ``hash_col`` names a
    column that already holds ``hash_key(seed, key_cols)`` (computed once,
    reused by several steps). ``hex_digits`` defaults to a size that keeps
    buckets near a million rows when ``n_rows`` is known."""
    hex_digits = hex_digits or rank_hex_digits(n_rows)
    # md5 hex never makes conv() null; coalesce tells the optimizer so, which
    # keeps it from inferring an is-not-null filter that would hash twice
    bucket = F.coalesce(F.conv(F.substring(F.col(HASH), 1, hex_digits), 16, 10).cast("long"),
                        F.lit(0).cast("long"))
    d = df.withColumn(HASH, F.col(hash_col) if hash_col else hash_key(seed, key_cols))
    bound = 16 ** hex_digits if not by else None     # one row per bucket
    return ordered_rank(d, by, [HASH, *key_cols], [bucket], out=out,
                        max_blocks=bound).drop(HASH)


def class_counts(df: DataFrame, label: str) -> dict:
    """Row count per class (one small aggregate, at most a few rows)."""
    return {r[0]: r[1] for r in df.groupBy(q(label)).count().collect()}


def smallest_hash_sample(df: DataFrame, key_cols: Sequence[str], seed, n: int,
                         hash_col: str | None = None, n_rows: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest md5 key, exactly, with bounded work
    after the scan.

    A plain ``orderBy(hash).limit(n)`` keeps n rows per task and then sends
    n x (number of tasks) rows to ONE task, which grows with the table. Here
    rows are first filtered on the first 60 bits of the hash against a
    threshold that admits about 1.2 n + 50 rows of the ``n_rows`` in
    expectation (hashes are uniform); the exact n smallest are then taken
    from those few candidates. If fewer than n candidates pass (a many-sigma
    event) the threshold doubles and the step repeats, so the result is
    always exact. The returned sample (n rows) is cached; unpersist it when
    done.
    """
    h = F.col(hash_col) if hash_col else hash_key(seed, key_cols)
    d = df.withColumn(HASH, h)
    total = df.count() if n_rows is None else n_rows
    want = min(n, total)
    frac = min(1.0, (1.2 * n + 50) / max(total, 1))
    prefix = F.conv(F.substring(F.col(HASH), 1, 15), 16, 10).cast("long")   # 60 bits
    while True:
        cand = d if frac >= 1.0 else d.where(prefix < F.lit(int(frac * 16 ** 15)))
        sample = (cand.orderBy(HASH, *[q(c) for c in key_cols]).limit(n).drop(HASH)
                  .cache())
        if sample.count() >= want or frac >= 1.0:
            return sample
        sample.unpersist()
        frac = min(1.0, frac * 2)


def undersample_sizes(counts: dict, ratio: float) -> tuple:
    """(minority class, its size, majority class, rows kept from it)."""
    if len(counts) != 2:
        raise ValueError(f"undersample needs exactly two classes, got {sorted(counts)}")
    (minor, n_min), (major, n_maj) = sorted(counts.items(), key=lambda kv: (kv[1], str(kv[0])))
    keep = math.floor(n_min / ratio)
    if keep > n_maj:
        raise ValueError(f"ratio {ratio} needs {keep} majority rows, only {n_maj} exist")
    return minor, n_min, major, keep


#: Hex digits of the hash by which rows are first counted, and the rows among which a cut is then looked up.
CUT_DIGITS, CUT_ROWS = 4, 10_000


def _prefix(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def prefix_counts(df: DataFrame, key_cols: Sequence[str], seed, by: Sequence[str] = (),
                  hash_col: str | None = None) -> dict:
    """{group: {hash prefix: rows}} in one aggregate (at most 16**CUT_DIGITS rows per group)."""
    h = F.col(hash_col) if hash_col else hash_key(seed, key_cols)
    out: dict = {}
    for r in df.groupBy(*[q(b) for b in by], _prefix(h, CUT_DIGITS).alias("_ts_p")).count().collect():
        out.setdefault(tuple(r[: len(by)]), {})[r["_ts_p"]] = r["count"]
    return out


def first_rows(df: DataFrame, key_cols: Sequence[str], seed, k: int, counts: dict,
               hash_col: str | None = None) -> Column | None:
    """The condition that holds for the ``k`` rows of ``df`` with the smallest (md5, key).

    ``counts``: rows per hash prefix, which tell the prefix that holds the cut; rows of that
    prefix alone are counted by longer ones until few are left, and these give the
    cut-off row. Rows are then kept in place: none is shuffled. None if rows of equal keys lie on
    both sides of the cut, which no condition on the key can part.
    """
    n = sum(counts.values())
    if k >= n:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    h = F.col(hash_col) if hash_col else hash_key(seed, key_cols)
    digits, rest, inside = CUT_DIGITS, k, F.lit(True)
    while True:
        for p in sorted(counts):
            if rest <= counts[p]:
                break
            rest -= counts[p]
        inside = inside & (_prefix(h, digits) == F.lit(p))
        if counts[p] <= CUT_ROWS or digits >= 12:
            break
        digits += CUT_DIGITS
        counts = {r[0]: r[1] for r in df.where(inside).groupBy(_prefix(h, digits).alias("_ts_p")).count().collect()}
    keys = [q(c) for c in key_cols]
    names = [f"_ts_k{i}" for i in range(len(keys))]
    near = df.where(inside).select(h.alias("_ts_h"), *[c.alias(m) for c, m in zip(keys, names)])
    rows = near.orderBy("_ts_h", *names).limit(rest + 1).collect()      # at most CUT_ROWS + 1 of them
    cut = rows[rest - 1]
    if len(rows) > rest and rows[rest] == cut:
        return None
    own = F.struct(*[c.alias(m) for c, m in zip(keys, names)])
    at = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(m) for v, c, m in zip(cut[1:], key_cols, names)])
    return (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & (own <= at))


def undersample(df: DataFrame, label: str, key_cols: Sequence[str], ratio: float = 0.85,
                seed=10, hash_col: str | None = None) -> DataFrame:
    """K1: two-class random undersampling to minority/majority = ``ratio``.

    Keeps every minority row and ``floor(n_min / ratio)`` majority rows (the
    smallest md5 keys), by a cut-off filter in place. Raises when that exceeds the majority size.
    """
    prefixes = prefix_counts(df, key_cols, seed, [label], hash_col)
    counts = {k[0]: sum(v.values()) for k, v in prefixes.items()}
    minor, _, major, keep = undersample_sizes(counts, ratio)
    major_rows = df.where(q(label) == F.lit(major))
    first = first_rows(major_rows, key_cols, seed, keep, prefixes[major,], hash_col)
    if first is not None:
        return df.where((q(label) == F.lit(minor)) | ((q(label) == F.lit(major)) & first))
    ranked = hash_rank(major_rows, key_cols, seed, out="_ts_rank", hash_col=hash_col,
                       n_rows=counts[major])
    kept = ranked.where(F.col("_ts_rank") <= keep).drop("_ts_rank")
    return df.where(q(label) == F.lit(minor)).unionByName(kept)


def split_sizes(n: int, train: float | None = None, test: float | None = None) -> tuple[int, int]:
    """(n_train, n_test) with the usual rule: a float train size is floored,
    a float test size is ceiled, the other side takes the rest."""
    if train is not None:
        n_train = math.floor(train * n)
        return n_train, n - n_train
    n_test = math.ceil(test * n)
    return n - n_test, n_test


def train_test(df: DataFrame, key_cols: Sequence[str], seed, train: float | None = None,
               test: float | None = None, out: str = "is_train", hash_col: str | None = None) -> DataFrame:
    """K2/K3: shuffled, not stratified, exact-size split. Adds boolean ``out``, by a cut-off in
    place (rows of equal keys on both sides of the cut are ranked instead)."""
    counts = prefix_counts(df, key_cols, seed, hash_col=hash_col).get((), {})
    n = sum(counts.values())
    n_train, _ = split_sizes(n, train, test)
    first = first_rows(df, key_cols, seed, n_train, counts, hash_col)
    if first is not None:
        return df.withColumn(out, first)
    ranked = hash_rank(df, key_cols, seed, out="_ts_rank", hash_col=hash_col, n_rows=n)
    return ranked.withColumn(out, F.col("_ts_rank") <= n_train).drop("_ts_rank")


def stratified_folds(df: DataFrame, label: str, key_cols: Sequence[str], k: int = 5,
                     seed=42, out: str = "fold") -> DataFrame:
    """K4: stratified k folds; fold sizes differ by at most one per class."""
    ranked = hash_rank(df, key_cols, seed, by=[label], out="_ts_rank")
    return ranked.withColumn(out, ((F.col("_ts_rank") - 1) % k).cast("int")).drop("_ts_rank")


def chunk_masks(nodes: DataFrame, chunk: str, key_cols: Sequence[str], frac: float = 0.8,
                seed=0, out: str = "is_train") -> DataFrame:
    """K5: per chunk, ``int(frac * n)`` random rows train, the rest validation.
    Chunks hold a bounded number of rows (the chunk size), so a window per chunk
    is safe."""
    w = Window.partitionBy(chunk)
    wo = w.orderBy(hash_key(seed, key_cols), *[q(c) for c in key_cols])
    return (nodes.withColumn("_ts_n", F.count(F.lit(1)).over(w))
                 .withColumn("_ts_rn", F.row_number().over(wo))
                 .withColumn(out, F.col("_ts_rn") <= F.floor(F.col("_ts_n") * F.lit(frac)))
                 .drop("_ts_n", "_ts_rn"))


def shuffle(df: DataFrame, key_cols: Sequence[str], seed=42, out: str = "pos") -> DataFrame:
    """L3: random permutation; ``out`` is the 1-based position in the new order."""
    return hash_rank(df, key_cols, seed, out=out)


def shuffled_tail(df: DataFrame, key_cols: Sequence[str], seed=42, frac: float = 0.2,
                  out: str = "is_validation") -> DataFrame:
    """L3 + K6: the last ``frac`` of the shuffled rows are validation, without ranking the rows."""
    split = train_test(df, key_cols, seed, test=frac, out="_ts_first")
    return split.withColumn(out, ~F.col("_ts_first")).drop("_ts_first")


def tail_split(df: DataFrame, pos: str = "pos", frac: float = 0.2,
               out: str = "is_validation") -> DataFrame:
    """K6: the last ``frac`` of rows (by dense position ``pos``) are validation."""
    n = df.count()
    cut = int(n * (1 - frac))
    return df.withColumn(out, q(pos) > F.lit(cut))


def with_chunk(df: DataFrame, row_id: str, size: int = 10000, out: str = "chunk_id") -> DataFrame:
    """Fixed-size chunks of consecutive row ids."""
    return df.withColumn(out, F.floor(q(row_id) / F.lit(size)).cast("bigint"))
