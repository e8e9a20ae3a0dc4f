"""Histogram trees: boosting (M5, M6), random search (M7) and forests (M1, M2) from exact integer sums.

Columns are binned once. A bin b of a column with cut values e1 < e2 < ... holds e_b <= x < e_(b+1);
a missing value (null or NaN) is bin -1. A split "bin < cut" sends lower bins left, and
learns the side of the missing ones.

All trees in work grow level by level in the same scan: a task sums its rows per (model, node,
feature, bin) in an array, Spark adds the tasks' sums up, and the driver, which holds nothing but
these sums (their number depends on columns, bins and depth, not on rows), takes the best split
of every node. Gradients and weights enter as integers (``SCALE`` to one), so the sums, and with them the
trees, depend neither on the partitions nor on the order of rows.

Boosting needs no more of the rows than their bins, label and number, so equal rows are added up first.
Where the table of distinct rows is small (``MOST_CELLS``, counted), whole models are fitted side by side, a task each; else
all models take each scan of that table together. Both give the same trees.

Sampling is by hash. Boosting keeps floor(n * share + u) of n equal rows, u in [0, 1) from a hash of
(seed, tree, row); for n = 1 that is a draw per row. A forest's tree counts a row as often as a Poisson(1) draw from the
hash of (seed, tree, row key) says, the bootstrap of large tables.

Defined results: rows without a label take no part; a column without two known values is never split on;
equal gains go to the smaller (feature, cut), then to missing values on the right; an empty table gives one leaf.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import scratch_path, workers_import

SCALE = 1 << 24
MAX_BINS = 256
LEAST_GAIN = 1e-6
LEAST_HESSIAN = 1e-16
#: Distinct rows up to which a task holds the whole table of distinct rows.
MOST_CELLS = 1 << 18
#: Sums (model, node, feature, bin) that one scan may bring to the driver.
MOST_SUMS = 1 << 22
#: Rounds after which the scans' margins are written.
STORE_ROUNDS = 10
MASK = 0xFFFFFFFF


# ---------------------------------------------------------------- bins


@dataclass
class Binning:
    """Ascending cut values per column."""
    cols: list[str]
    edges: list[list[float]]

    @property
    def width(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 1

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], max_bins: int = MAX_BINS) -> Binning:
        """Every distinct value its own bin, or quantiles where there are more than ``max_bins``."""
        cols = list(cols)
        known = [F.when(~F.isnan(q(c).cast("double")), _finite(c)) for c in cols]
        shares = [i / max_bins for i in range(max_bins + 1)]
        head = df.agg(*[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(known)],
                      *[F.percentile_approx(v, shares, 100 * max_bins).alias(f"p{i}") for i, v in enumerate(known)]).first()
        few = [i for i in range(len(cols)) if head[f"n{i}"] <= 1.2 * max_bins]
        found: dict[int, set[float]] = {i: set() for i in few}
        if few:
            long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), known[i].alias("v")) for i in few])).alias("t"))
            # at most about 1.2 x max_bins values of each column, by their approximate number
            for r in long.select("t.i", "t.v").filter("v is not null").distinct().collect():
                found[r.i].add(r.v)
        edges = []
        for i in range(len(cols)):
            own = found.get(i)
            if own is None or len(own) > max_bins:
                own = set(head[f"p{i}"] or [])
            edges.append(sorted(own)[1:])
        return cls(cols, edges)

    @classmethod
    def even(cls, df: DataFrame, cols: Sequence[str], bins: int) -> Binning:
        """Bins of equal width between the least and the greatest finite value."""
        cols = list(cols)
        ends = df.agg(*[f(F.when(F.abs(q(c).cast("double")) < math.inf, q(c).cast("double"))).alias(f"{n}{i}")
                        for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))]).first()
        edges = []
        for i in range(len(cols)):
            a, b = ends[f"a{i}"], ends[f"b{i}"]
            edges.append([] if a is None or a == b else sorted({a + (b - a) * k / bins for k in range(1, bins)}))
        return cls(cols, edges)

    def bins(self, df: DataFrame, out: str = "bins") -> DataFrame:
        """``df`` with the bins of all columns as an array of shorts."""
        at = [f"_bin_in{i}" for i in range(len(self.cols))]
        d = df.withColumns({a: _finite(c) for a, c in zip(at, self.cols, strict=True)})
        cut = [i for i, e in enumerate(self.edges) if e]
        if cut:
            d = Bucketizer(inputCols=[at[i] for i in cut], outputCols=[f"_bin{i}" for i in cut], handleInvalid="keep",
                           splitsArray=[[-math.inf, *self.edges[i], math.inf] for i in cut]).transform(d)
        made = []
        for i, a in enumerate(at):
            missing = F.col(a).isNull() | F.isnan(a)
            made.append(F.when(missing, -1).otherwise(F.col(f"_bin{i}") if i in cut else F.lit(0)).cast("short"))
        return d.withColumn(out, F.array(*made)).drop(*at, *[f"_bin{i}" for i in cut])


def _finite(c: str) -> Column:
    """The column as double, infinities as the greatest finite values; NaN stays."""
    most = float(np.finfo(float).max)
    v = q(c).cast("double")
    return F.when(v == math.inf, most).when(v == -math.inf, -most).otherwise(v)


def row_key(key: Sequence[str] | Column) -> Column:
    """A 32-bit number from md5 of a key, which any SQL engine can repeat."""
    text = key if isinstance(key, Column) else F.concat_ws(":", *[q(c).cast("string") for c in key])
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(0))


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 32-bit numbers whose products stay below 2^63."""
    x = x.astype(np.int64) & MASK
    for _ in range(2):
        x = (((x >> 16) ^ x) * 73244475) & MASK
    return (x >> 16) ^ x


def mixed32(x: np.ndarray) -> np.ndarray:
    """``mixed`` in 32-bit numbers, whose products wrap: a new array, less memory moved."""
    x = x.astype(np.uint32)
    half = x >> np.uint32(16)
    for _ in range(2):
        x ^= half
        x *= np.uint32(73244475)
        np.right_shift(x, np.uint32(16), out=half)
    x ^= half
    return x


def uniform(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from (key, tree, seed)."""
    return mixed(mixed(np.asarray(key) + seed) + tree * 40503) / 2.0**32


#: Poisson(1): P(count <= k), as far as 32-bit draws can tell.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """A binary tree as a heap: children of node i are 2 i + 1 and 2 i + 2."""
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    #: What the sums said of each node: (gradient, hessian) or a count per class.
    sums: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(depth, np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b < 0, self.missing_left[at], b < self.cut[at])
            at = np.where(f >= 0, 2 * at + 2 - left, at)
        return at

    def open_nodes(self, level: int) -> list[int]:
        """The nodes of a level that rows reach."""
        return [i for i in range(2**level - 1, 2 ** (level + 1) - 1)
                if i == 0 or self.feature[(i - 1) // 2] >= 0]


@dataclass(frozen=True)
class Boost:
    """One setting; the defaults are the reference's phishing ranking."""
    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    subsample: float = 1.0
    colsample: float = 1.0
    reg: float = 1.0
    gamma: float = 0.0
    min_child: float = 1.0
    seed: int = 42

    def features(self, p: int, tree: int) -> np.ndarray:
        """The columns a tree may split on, by a hash of (seed, tree, column)."""
        k = max(1, int(self.colsample * p))
        order = mixed(mixed(np.arange(p) * 2654435 + self.seed) + tree * 40503)
        mask = np.zeros(p, bool)
        mask[np.lexsort((np.arange(p), order))[:k]] = True
        return mask


def _ranked_splits(hist: np.ndarray):
    """(left sums, total) for every (node, feature, cut, missing side); the total is the same for all features.

    hist: (nodes, features, 1 + bins, channels), missing values first.
    """
    total = hist[:, :1].sum(2, keepdims=True)[:, :, :, None]          # (nodes, 1, 1, 1, channels)
    below = np.cumsum(hist[:, :, 1:], 2)[:, :, :-1]                   # cut = 1, 2, ...
    return np.stack([below, below + hist[:, :, :1]], 3), total


def best_boosted(hist: np.ndarray, s: Boost, allowed: np.ndarray):
    """Per node (feature or -1, cut, missing left, gain)."""
    left, total = _ranked_splits(hist)
    right = total - left

    def score(x):
        g, h = x[..., 0] / SCALE, x[..., 1] / SCALE
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h + s.reg > 0, g * g / (h + s.reg), 0.0)
    gain = score(left) + score(right) - score(total)
    least = s.min_child * SCALE
    ok = (left[..., 1] >= least) & (right[..., 1] >= least) & (gain > max(s.gamma, LEAST_GAIN)) & allowed[None, :, None, None]
    return _first_best(np.where(ok, gain, -np.inf))


def best_gini(hist: np.ndarray, allowed: np.ndarray, least_rows: int):
    """As ``best_boosted`` for class counts; the gain is the loss of weighted impurity, times the rows."""
    left, total = _ranked_splits(hist)
    right = total - left

    def purity(x):
        n = x.sum(-1)
        return (x.astype(float) ** 2).sum(-1) / np.maximum(n, 1)
    gain = purity(left) + purity(right) - purity(total)
    ok = (left.sum(-1) >= least_rows) & (right.sum(-1) >= least_rows) & (gain > LEAST_GAIN) & allowed[:, :, None, None]
    return _first_best(np.where(ok, gain, -np.inf))


def _first_best(gain: np.ndarray):
    flat = gain.reshape(len(gain), -1)
    if not flat.shape[1]:
        return [(-1, 0, False, 0.0)] * len(gain)
    at = flat.argmax(1)                                               # the first of equal ones
    out = []
    for node, k in enumerate(at):
        f, cut, side = np.unravel_index(k, gain.shape[1:])
        g = flat[node, k]
        out.append((int(f), int(cut) + 1, bool(side), float(g)) if np.isfinite(g) else (-1, 0, False, 0.0))
    return out


def add_sums(hist: np.ndarray, bins: np.ndarray, node: np.ndarray, weights: np.ndarray) -> None:
    """Adds rows to (nodes, features, 1 + bins, channels); rows of node -1 are left out."""
    at = np.flatnonzero((node >= 0) & weights.any(1))
    width = hist.shape[2]
    for f in range(hist.shape[1]):
        for c in range(hist.shape[3]):
            part = hist[:, f, :, c].reshape(-1)                       # a copy: the view is strided
            np.add.at(part, node[at] * width + bins[at, f] + 1, weights[at, c])
            hist[:, f, :, c] = part.reshape(hist.shape[0], width)


# ---------------------------------------------------------------- models in work


@dataclass
class Model:
    """A boosted model in work: setting, the fold it leaves out, and its trees."""
    setting: Boost
    held: int | None = None
    trees: list[Tree] = field(default_factory=list)
    done: bool = False

    channels = 2

    def weights(self, key: np.ndarray, y: np.ndarray, n: np.ndarray, folds: np.ndarray | None, margin: np.ndarray) -> np.ndarray:
        """Integer gradients and hessians of the present tree's rows."""
        if self.held is not None:
            n = n - folds[:, self.held]
        if self.setting.subsample < 1:
            n = np.floor(n * self.setting.subsample + uniform(key, len(self.trees), self.setting.seed)).astype(np.int64)
        p = 1 / (1 + np.exp(-margin))
        g = np.rint((p - y) * SCALE).astype(np.int64) * n
        h = np.rint(np.maximum(p * (1 - p), LEAST_HESSIAN) * SCALE).astype(np.int64) * n
        return np.stack([g, h], 1)

    def split(self, tree: Tree, level: int, hist: np.ndarray) -> bool:
        """Splits a level's nodes by their sums, or makes them leaves; false if all are leaves."""
        s = self.setting
        nodes = tree.open_nodes(level)
        found = (best_boosted(hist, s, s.features(hist.shape[1], len(self.trees))) if level < s.depth
                 else [(-1, 0, False, 0.0)] * len(nodes))
        for k, (i, (f, cut, side, gain)) in enumerate(zip(nodes, found, strict=True)):
            g, h = (int(v) for v in hist[k, 0].sum(0))
            tree.sums[i] = [g, h]
            tree.feature[i], tree.cut[i], tree.missing_left[i], tree.gain[i] = f, cut, side, gain
            if f < 0 and h / SCALE + s.reg > 0:
                tree.value[i] = -(g / SCALE) / (h / SCALE + s.reg) * s.step
        return any(f >= 0 for f, *_ in found)


@dataclass
class Cells:
    """Distinct rows as arrays: (key, bins, y, n, rows per fold)."""
    key: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    n: np.ndarray
    folds: np.ndarray | None

    @classmethod
    def of(cls, t: pa.Table | pa.RecordBatch, p: int) -> Cells:
        def flat(name, kind):
            col = t.column(name)
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(col), -1)

        def plain(name):
            return t.column(name).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(name).to_numpy()
        bins = flat("bins", np.int16) if t.num_rows else np.zeros((0, p), np.int16)
        folds = flat("folds", np.int64) if "folds" in t.schema.names and t.num_rows else None
        return cls(plain("key"), bins, plain("y").astype(float), plain("n"), folds)


def cells(df: DataFrame, binning: Binning, label: str, fold: str | None = None, folds: int = 0) -> DataFrame:
    """Distinct (bins, y) with their number of rows, and with it per fold."""
    d = binning.bins(df.filter(q(label).isNotNull()).withColumn("_y", q(label).cast("double")), "_bins")
    counts = [F.count(F.lit(1)).alias("n")]
    if fold is not None:
        counts += [F.array(*[F.count(F.when(q(fold) == i, 1)) for i in range(folds)]).alias("folds")]
    out = d.groupBy(F.col("_bins").alias("bins"), F.col("_y").alias("y")).agg(*counts)
    return out.withColumn("key", row_key(F.concat_ws(":", F.concat_ws(",", F.col("bins").cast("array<string>")), F.col("y").cast("int"))))


def fit_cells(c: Cells, model: Model, width: int) -> Model:
    """The model's trees from a whole table of distinct rows."""
    margin = np.zeros(len(c.key))
    for _ in range(model.setting.rounds):
        tree = Tree.empty(model.setting.depth)
        w = model.weights(c.key, c.y, c.n, c.folds, margin)
        for level in range(model.setting.depth + 1):
            hist = level_sums([(tree, level, c.bins, w)], width)[0]
            if not model.split(tree, level, hist):
                break
        model.trees.append(tree)
        margin = margin + tree.value[tree.nodes(c.bins)]
    return model


def level_sums(work, width: int, into: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Histograms of the open nodes for each (tree, level, bins, weights)."""
    out = into if into is not None else []
    for k, (tree, level, bins, w) in enumerate(work):
        nodes = tree.open_nodes(level)
        if into is None:
            out.append(np.zeros((len(nodes), bins.shape[1], width + 1, w.shape[1]), np.int64))
        place = np.full(len(tree.feature), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        add_sums(out[k], bins, place[tree.nodes(bins)], w)
    return out


SUMS = "model int, node int, feature int, bin int, sums array<bigint>"


def _emitted(hists: list[np.ndarray]):
    for m, h in enumerate(hists):
        at = np.argwhere(h.any(-1))
        for a in range(0, len(at), 1 << 16):
            part = at[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(part), m, np.int32)), *(pa.array(part[:, k].astype(np.int32)) for k in range(3)),
                pa.array(h[tuple(part.T)].tolist(), pa.list_(pa.int64()))], names=["model", "node", "feature", "bin", "sums"])


def summed(rows: DataFrame, channels: int, shapes: list[tuple]) -> list[np.ndarray]:
    """The tasks' sums added up by Spark; their number is bounded by ``shapes``."""
    got = (rows.groupBy("model", "node", "feature", "bin")
           .agg(*[F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(channels)]).toArrow())
    out = [np.zeros(s, np.int64) for s in shapes]
    if got.num_rows:
        m, n, f, b = (got.column(c).to_numpy() for c in ("model", "node", "feature", "bin"))
        sums = np.stack([got.column(f"s{c}").to_numpy() for c in range(channels)], 1)
        for k in np.unique(m):
            at = m == k
            out[k][n[at], f[at], b[at]] = sums[at]
    return out


def fit_scans(table: DataFrame, models: list[Model], p: int, width: int) -> list[Model]:
    """All models' trees, every level of every model from one scan of the table (in groups, so that sums stay bounded)."""
    spark = table.sparkSession
    workers_import(spark)
    now = table.withColumn("margins", F.array_repeat(F.lit(0.0), len(models)))
    now, since = _stored(now), [0] * len(models)

    def scan(group: list[int], level: int, growing: dict[int, Tree]) -> list[np.ndarray]:
        held = [(m, models[m], models[m].trees[since[m]:], growing[m]) for m in group]
        shapes = [(len(t.open_nodes(level)), p, width + 1, 2) for _, _, _, t in held]

        def run(batches):
            hists = [np.zeros(s, np.int64) for s in shapes]
            for b in batches:
                c = Cells.of(b, p)
                if not len(c.key):
                    continue
                stored = b.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(len(c.key), -1)
                work = []
                for m, model, recent, tree in held:
                    margin = stored[:, m] + sum(t.value[t.nodes(c.bins)] for t in recent)
                    work.append((tree, level, c.bins, model.weights(c.key, c.y, c.n, c.folds, margin)))
                level_sums(work, width, hists)
            yield from _emitted(hists)
        return summed(now.mapInArrow(run, SUMS), 2, shapes)

    for r in range(max(m.setting.rounds for m in models)):
        growing = {k: Tree.empty(m.setting.depth) for k, m in enumerate(models) if r < m.setting.rounds}
        live = list(growing)
        for level in range(1 + max(models[k].setting.depth for k in live)):
            cost = {k: len(growing[k].open_nodes(level)) * p * (width + 1) for k in live}
            for group in grouped(live, cost):
                for k, hist in zip(group, scan(group, level, growing), strict=True):
                    if not models[k].split(growing[k], level, hist):
                        live = [x for x in live if x != k]
            if not live:
                break
        for k, tree in growing.items():
            models[k].trees.append(tree)
        if (r + 1) % STORE_ROUNDS == 0:
            now, since = _with_margins(now, models, since, p), [len(m.trees) for m in models]
    return models


def grouped(items: list[int], cost: dict[int, int]) -> list[list[int]]:
    """Items in order, cut so that a group's cost stays below ``MOST_SUMS`` (or is one item)."""
    out, most = [], 0
    for k in items:
        if not out or most + cost[k] > MOST_SUMS:
            out, most = [*out, []], 0
        out[-1].append(k)
        most += cost[k]
    return out


def _with_margins(now: DataFrame, models: list[Model], since: list[int], p: int) -> DataFrame:
    trees = [m.trees[a:] for m, a in zip(models, since, strict=True)]

    def run(batches):
        for b in batches:
            c = Cells.of(b, p)
            old = b.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(len(c.key), len(trees))
            new = old + np.stack([sum((t.value[t.nodes(c.bins)] for t in ts), np.zeros(len(c.key))) for ts in trees], 1)
            at = b.schema.get_field_index("margins")
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(c.key) + 1, dtype=np.int32) * len(trees)), pa.array(new.ravel()))
            yield b.set_column(at, pa.field("margins", made.type), made)
    return _stored(now.mapInArrow(run, now.schema))


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: the lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, "cells")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- boosting


@dataclass
class Boosted:
    """A fitted model."""
    binning: Binning
    setting: Boost
    trees: list[Tree]

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, missing_left, gain, grad, hess, value): a row per node that rows reach.

        Rows with value < threshold go left; inner nodes have a feature, leaves a value.
        """
        rows = []
        for t, tree in enumerate(self.trees):
            for i, (g, h) in sorted(tree.sums.items()):
                f = int(tree.feature[i])
                rows.append((t, i, self.binning.cols[f] if f >= 0 else None,
                             float(self.binning.edges[f][tree.cut[i] - 1]) if f >= 0 else None,
                             bool(tree.missing_left[i]) if f >= 0 else None, float(tree.gain[i]) if f >= 0 else None,
                             g / SCALE, h / SCALE, float(tree.value[i]) if f < 0 else None))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, "
                                           "gain double, grad double, hess double, value double")

    def split_counts(self, spark: SparkSession) -> DataFrame:
        """M6: how often each feature splits, over all trees; unused features are absent."""
        return (self.nodes(spark).filter("feature is not null").groupBy(F.col("feature").alias("Feature"))
                .agg(F.count(F.lit(1)).cast("double").alias("Importance")))

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """``df`` with the probability of label 1."""
        workers_import(df.sparkSession)
        trees = self.trees
        d = self.binning.bins(df, "_bins")

        def run(batches):
            for b in batches:
                at = b.schema.get_field_index("_bins")
                p = len(self.binning.cols)
                bins = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
                margin = sum((t.value[t.nodes(bins)] for t in trees), np.zeros(b.num_rows))
                kept = [k for k, n in enumerate(b.schema.names) if n not in ("_bins", out)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(1 / (1 + np.exp(-margin)))],
                                                 names=[*(b.schema.names[k] for k in kept), out])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
        return d.mapInArrow(run, f"{schema}, `{out}` double")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON: the setting, the cut values and the trees."""
        text = json.dumps({"cols": self.binning.cols, "edges": self.binning.edges, "setting": asdict(self.setting),
                           "trees": [_packed(t) for t in self.trees]})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        got = json.loads(spark.read.text(path).first()[0])
        return cls(Binning(got["cols"], got["edges"]), Boost(**got["setting"]), [_unpacked(t) for t in got["trees"]])


def _packed(t: Tree) -> dict:
    return {"depth": t.depth, "feature": t.feature.tolist(), "cut": t.cut.tolist(), "missing_left": t.missing_left.tolist(),
            "value": t.value.tolist(), "gain": t.gain.tolist(), "sums": {str(k): v for k, v in t.sums.items()}}


def _unpacked(t: dict) -> Tree:
    return Tree(t["depth"], np.array(t["feature"], np.int32), np.array(t["cut"], np.int32), np.array(t["missing_left"], bool),
                np.array(t["value"]), np.array(t["gain"]), {int(k): v for k, v in t["sums"].items()})


def fit_models(table: DataFrame, binning: Binning, models: list[Model], most_cells: int = MOST_CELLS) -> list[Model]:
    """Fits all models on a ``cells`` table: a task each where it is small, else in common scans."""
    spark = table.sparkSession
    workers_import(spark)
    p, width = len(binning.cols), binning.width
    table = _stored(table)
    if table.filter("y <> 0 and y <> 1").limit(1).count():
        raise ValueError("the label must be 0 or 1")
    if table.count() > most_cells:
        return fit_scans(table, models, p, width)
    whole = table.orderBy("key", "y").toArrow()                   # at most most_cells rows
    data = Cells.of(whole, p)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                m = fit_cells(data, Model(models[k].setting, models[k].held), width)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([json.dumps([_packed(t) for t in m.trees])])],
                                                 names=["model", "trees"])
    order = spark.range(0, len(models), 1, len(models))
    for r in order.mapInArrow(run, "model long, trees string").toLocalIterator():
        models[r.model].trees = [_unpacked(t) for t in json.loads(r.trees)]
    return models


def boost(df: DataFrame, cols: Sequence[str], label: str, setting: Boost = Boost(), binning: Binning | None = None,
          most_cells: int = MOST_CELLS) -> Boosted:
    """M5: boosted trees with logistic loss and second-order splits. ``label`` is 0 or 1."""
    binning = binning or Binning.fit(df, cols)
    models = fit_models(cells(df, binning, label), binning, [Model(setting)], most_cells)
    return Boosted(binning, setting, models[0].trees)


# ---------------------------------------------------------------- random search


def held_out_accuracy(table: DataFrame, binning: Binning, models: list[Model], threshold: float = 0.5) -> DataFrame:
    """(model, right, rows): each model over the fold it left out."""
    p = len(binning.cols)
    parts = [(k, m.held, m.trees) for k, m in enumerate(models)]

    def run(batches):
        right, rows = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for b in batches:
            c = Cells.of(b, p)
            if not len(c.key):
                continue
            for k, held, trees in parts:
                n = c.folds[:, held]
                margin = sum((t.value[t.nodes(c.bins)] for t in trees), np.zeros(len(c.key)))
                rows[k] += n.sum()
                right[k] += n[(1 / (1 + np.exp(-margin)) > threshold) == (c.y > 0.5)].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(right), pa.array(rows)], names=["model", "right", "rows"])
    return (table.mapInArrow(run, "model long, right long, rows long").groupBy("model")
            .agg(F.sum("right").alias("right"), F.sum("rows").alias("rows")))


@dataclass
class Search:
    """M7's outcome: the table of settings with their fold accuracies, and the best one fitted on all rows."""
    results: DataFrame
    best: Boosted


def search(df: DataFrame, cols: Sequence[str], label: str, fold: str, settings: Sequence[Boost], folds: int = 5,
           binning: Binning | None = None, most_cells: int = MOST_CELLS) -> Search:
    """M7: every setting on every fold's complement, the mean accuracy on what was held out, the best refitted on all rows.

    All settings and folds share one table of distinct rows that carries its number of rows per fold.
    ``results``: (setting, rounds, depth, step, subsample, colsample, fold_accuracy array, mean_accuracy, std_accuracy, place);
    equal means go to the earlier setting.
    """
    spark = df.sparkSession
    binning = binning or Binning.fit(df, cols)
    table = _stored(cells(df, binning, label, fold, folds))
    models = fit_models(table, binning, [Model(s, f) for s in settings for f in range(folds)], most_cells)
    got = {r.model: (r.right, r.rows) for r in held_out_accuracy(table, binning, models).collect()}    # a row per model
    rows = []
    for k, s in enumerate(settings):
        acc = [a / n if n else None for a, n in (got.get(k * folds + f, (0, 0)) for f in range(folds))]
        known = [a for a in acc if a is not None]
        mean = sum(known) / len(known) if known else None
        std = math.sqrt(sum((a - mean) ** 2 for a in known) / len(known)) if known else None
        rows.append([k, s.rounds, s.depth, s.step, s.subsample, s.colsample, acc, mean, std])
    order = sorted(range(len(rows)), key=lambda k: (rows[k][7] is None, -(rows[k][7] or 0.0), k))
    for place, k in enumerate(order):
        rows[k].append(place + 1)
    best = fit_models(table.drop("folds"), binning, [Model(settings[order[0]])], most_cells)[0]
    results = spark.createDataFrame([tuple(r) for r in rows], "setting int, rounds int, depth int, step double, subsample double, "
                                    "colsample double, fold_accuracy array<double>, mean_accuracy double, std_accuracy double, place int")
    return Search(results, Boosted(binning, settings[order[0]], best.trees))


# ---------------------------------------------------------------- forests


@dataclass(frozen=True)
class Forest:
    trees: int = 100
    depth: int = 8
    seed: int = 10
    #: Columns tried at each node; None: the root of their number.
    tries: int | None = None
    least_rows: int = 1

    def allowed(self, p: int, tree: int, nodes: Sequence[int]) -> np.ndarray:
        k = min(p, self.tries or max(1, math.isqrt(p)))
        mask = np.zeros((len(nodes), p), bool)
        for r, node in enumerate(nodes):
            order = mixed(mixed(mixed(np.arange(p) * 2654435 + self.seed) + tree * 40503) + node * 30011)
            mask[r, np.lexsort((np.arange(p), order))[:k]] = True
        return mask


def forest_importance(df: DataFrame, key_cols: Sequence[str], cols: Sequence[str], label: str, setting: Forest = Forest(),
                      binning: Binning | None = None, decimals: int | None = None) -> DataFrame:
    """M1/M2: (Feature, Importance), the mean over trees of each column's share of the impurity removed.

    All trees grow in the same scans, one for each level and group of trees. Classes are the label's
    distinct values as text, in their order. A tree that removes no impurity does not count.
    """
    spark = df.sparkSession
    workers_import(spark)
    binning = binning or Binning.fit(df, cols)
    text = q(label).cast("string")
    classes = [r[0] for r in df.select(text.alias("c")).filter("c is not null").distinct().limit(MAX_BINS + 1).collect()]
    if len(classes) > MAX_BINS:
        raise ValueError(f"a forest takes at most {MAX_BINS} classes")
    classes = sorted(classes)
    p, width, k = len(binning.cols), binning.width, max(1, len(classes))
    d = df.filter(text.isNotNull()).withColumn("key", row_key(key_cols))
    d = d.withColumn("y", F.array_position(F.array(*[F.lit(c) for c in classes]), text) - 1 if classes else F.lit(0))
    rows = _stored(binning.bins(d, "bins").select("key", "bins", F.col("y").cast("double").alias("y"), F.lit(1).cast("long").alias("n")))
    trees = [Tree.empty(setting.depth) for _ in range(setting.trees)]

    def scan(group: list[int], level: int) -> list[np.ndarray]:
        held = [(t, trees[t]) for t in group]
        shapes = [(len(tree.open_nodes(level)), p, width + 1, k) for _, tree in held]

        def run(batches):
            hists = [np.zeros(s, np.int64) for s in shapes]
            for b in batches:
                c = Cells.of(b, p)
                if not len(c.key):
                    continue
                one = np.eye(k, dtype=np.int64)[c.y.astype(np.int64)]
                work = [(tree, level, c.bins, one * np.searchsorted(POISSON, uniform(c.key, t, setting.seed), side="right")[:, None])
                        for t, tree in held]
                level_sums(work, width, hists)
            yield from _emitted(hists)
        return summed(rows.mapInArrow(run, SUMS), k, shapes)

    live = list(range(setting.trees))
    for level in range(setting.depth):
        cost = {t: len(trees[t].open_nodes(level)) * p * (width + 1) * k for t in live}
        for group in grouped(live, cost):
            for t, hist in zip(group, scan(group, level), strict=True):
                nodes = trees[t].open_nodes(level)
                found = best_gini(hist, setting.allowed(p, t, nodes), setting.least_rows)
                for i, (f, cut, side, gain) in zip(nodes, found, strict=True):
                    trees[t].feature[i], trees[t].cut[i], trees[t].missing_left[i], trees[t].gain[i] = f, cut, side, gain
                if all(f < 0 for f, *_ in found):
                    live = [x for x in live if x != t]
        if not live:
            break
    total = np.zeros(p)
    for tree in trees:
        own = np.zeros(p)
        for i in np.flatnonzero(tree.feature >= 0):
            own[tree.feature[i]] += tree.gain[i]
        total += own / own.sum() if own.sum() > 0 else 0
    share = total / total.sum() if total.sum() > 0 else total
    out = spark.createDataFrame([(c, float(v)) for c, v in zip(binning.cols, share, strict=True)], "Feature string, Importance double")
    return out if decimals is None else out.withColumn("Importance", F.round("Importance", decimals))
