"""Histogram trees: sums and splits against plain loops, both ways of fitting, sampling, search, forests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.operators import trees as T

NAN = float("nan")


def table(spark, n=400, seed=1, parts=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = int(rng.integers(-1, 2)), float(rng.integers(0, 5)), float(np.round(rng.normal(), 1))
        y = int(rng.random() < 1 / (1 + math.exp(-(a + (b > 2) * 1.5 - 1 + c))))
        rows.append((i, a, None if rng.random() < 0.2 else b, NAN if rng.random() < 0.1 else c, y, int(rng.integers(0, 3))))
    return spark.createDataFrame(rows, "id long, a int, b double, c double, y int, fold int").repartition(parts), rows


COLS = ["a", "b", "c"]


def test_bins(spark):
    df, rows = table(spark)
    b = T.Binning.fit(df, COLS, 16)
    assert b.edges[0] == [0, 1] and b.edges[1] == [1, 2, 3, 4] and len(b.edges[2]) <= 16
    got = {r.id: r.bins for r in b.bins(df).collect()}
    for i, *x, _, _ in rows:
        for v, e, at in zip(x, b.edges, got[i], strict=True):
            assert at == (-1 if v is None or v != v else sum(v >= t for t in e))
    odd = spark.createDataFrame([(1.0, None, NAN), (1.0, None, math.inf), (1.0, None, -math.inf)], "a double, b double, c double")
    b = T.Binning.fit(odd, COLS)
    assert b.edges == [[], [], [np.finfo(float).max]]
    assert [list(r.bins) for r in b.bins(odd).collect()] == [[0, -1, -1], [0, -1, 1], [0, -1, 0]]
    assert T.Binning.even(df, ["b"], 4).edges == [[1, 2, 3]] and T.Binning.even(odd, COLS, 4).edges == [[], [], []]


def slow_boost(x, y, edges, s):
    """Rounds of exhaustive search over all splits in exact integers."""
    n, p = len(x), len(edges)
    bins = [[-1 if v is None or v != v else sum(v >= t for t in e) for v, e in zip(r, edges, strict=True)] for r in x]
    margin = [0.0] * n
    for _ in range(s.rounds):
        g, h = [], []
        for k in range(n):
            pr = 1 / (1 + math.exp(-margin[k]))
            g.append(round((pr - y[k]) * T.SCALE))
            h.append(round(pr * (1 - pr) * T.SCALE))
        nodes, value = {0: list(range(n))}, [0.0] * n
        for level in range(s.depth + 1):
            for i in [i for i in nodes if 2**level - 1 <= i < 2 ** (level + 1) - 1]:
                at = nodes[i]
                gs, hs = sum(g[k] for k in at), sum(h[k] for k in at)

                def score(a, b):
                    return (a / T.SCALE) ** 2 / (b / T.SCALE + s.reg)
                best = None
                for f in range(p if level < s.depth else 0):
                    for cut in range(1, len(edges[f]) + 1):
                        for side in (False, True):
                            left = [k for k in at if (side if bins[k][f] < 0 else bins[k][f] < cut)]
                            lg, lh = sum(g[k] for k in left), sum(h[k] for k in left)
                            if min(lh, hs - lh) < s.min_child * T.SCALE:
                                continue
                            gain = score(lg, lh) + score(gs - lg, hs - lh) - score(gs, hs)
                            if gain > max(s.gamma, T.LEAST_GAIN) and (best is None or gain > best[0] + 1e-12):
                                best = gain, f, cut, side, left
                if best:
                    left = set(best[4])
                    nodes[2 * i + 1], nodes[2 * i + 2] = best[4], [k for k in at if k not in left]
                else:
                    for k in at:
                        value[k] = -(gs / T.SCALE) / (hs / T.SCALE + s.reg) * s.step
        margin = [a + b for a, b in zip(margin, value, strict=True)]
    return [1 / (1 + math.exp(-m)) for m in margin]


@pytest.mark.parametrize("most_cells", [1 << 18, 0])
def test_boost_against_exhaustive_search(spark, monkeypatch, most_cells):
    monkeypatch.setattr(T, "STORE_ROUNDS", 2)
    monkeypatch.setattr(T, "MOST_SUMS", 100)
    df, rows = table(spark, 120)
    s = T.Boost(rounds=3, depth=2, step=0.3)
    b = T.Binning.fit(df, COLS, 8)
    model = T.boost(df, COLS, "y", s, b, most_cells)
    want = slow_boost([r[1:4] for r in rows], [r[4] for r in rows], b.edges, s)
    got = {r.id: r.p for r in model.score(df).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-6)
    nodes = model.nodes(spark)
    assert nodes.filter("feature is null and value is null").count() == 0
    assert {r.Feature for r in model.split_counts(spark).collect()} <= set(COLS)
    assert sum(r.Importance for r in model.split_counts(spark).collect()) == nodes.filter("feature is not null").count()


def test_both_ways_and_any_partitions_give_the_same_trees(spark, scratch):
    df, _ = table(spark)
    s = T.Boost(rounds=12, depth=3, subsample=0.7, colsample=0.67, seed=5)
    b = T.Binning.fit(df, COLS)
    models = [T.boost(d, COLS, "y", s, b, m) for d, m in ((df, 1 << 18), (df.repartition(7), 0), (df.coalesce(1), 0))]
    tables = [m.nodes(spark).orderBy("tree", "node").collect() for m in models]
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) > 12
    assert len({r.feature for r in tables[0] if r.tree == 0 and r.feature}) <= 2        # two of three columns a tree
    models[0].save(spark, scratch + "/model")
    again = T.Boosted.load(spark, scratch + "/model")
    assert again.nodes(spark).orderBy("tree", "node").collect() == tables[0] and again.setting == s


def test_missing_values_learn_their_side(spark):
    rows = [(None, 1)] * 50 + [(1.0, 0)] * 50 + [(2.0, 1)] * 50
    df = spark.createDataFrame(rows, "x double, y int")
    model = T.boost(df, ["x"], "y", T.Boost(rounds=5, depth=1, step=1.0))
    got = {r.x: r.p for r in model.score(df).collect()}
    assert got[None] == got[2.0] > 0.9 > 0.1 > got[1.0]
    assert model.nodes(spark).filter("tree = 0 and node = 0").first().missing_left is False


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (None, None)], "x double, y int")
    model = T.boost(df, ["x"], "y", T.Boost(rounds=2))
    assert {r.p for r in model.score(df).collect()} == {0.5}
    assert T.boost(df.limit(0), ["x"], "y", T.Boost(rounds=2)).score(df).count() == 3
    with pytest.raises(ValueError):
        T.boost(df.withColumn("y", F.lit(2)), ["x"], "y")


def test_search(spark):
    df, rows = table(spark, 300)
    settings = [T.Boost(rounds=8, depth=2, step=0.3), T.Boost(rounds=2, depth=1, step=0.01),
                T.Boost(rounds=6, depth=3, step=0.2, subsample=0.8, colsample=0.67)]
    b = T.Binning.fit(df, COLS)
    found = T.search(df, COLS, "y", "fold", settings, 3, b)
    scans = T.search(df, COLS, "y", "fold", settings, 3, b, most_cells=0)
    got = {r.setting: r for r in found.results.collect()}
    assert got == {r.setting: r for r in scans.results.collect()}
    for k, s in enumerate(settings):
        for f in range(3):          # a fold's model is the one fitted on the others alone
            if s.subsample == 1:
                model = T.boost(df.filter(F.col("fold") != f), COLS, "y", s, b)
                held = model.score(df.filter(F.col("fold") == f)).agg(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
                assert got[k].fold_accuracy[f] == pytest.approx(held)
    assert sorted(r.place for r in got.values()) == [1, 2, 3]
    best = max(got.values(), key=lambda r: (r.mean_accuracy, -r.setting))
    assert best.place == 1 and found.best.setting == settings[best.setting]


def slow_forest(rows, keys, edges, classes, s):
    p = len(edges)
    bins = np.array([[-1 if v is None or v != v else sum(v >= t for t in e) for v, e in zip(r[1:4], edges, strict=True)] for r in rows])
    total = np.zeros(p)
    for t in range(s.trees):
        w = np.array([sum(u >= c for c in T.POISSON) for u in T.uniform(np.array(keys), t, s.seed)])
        own, nodes = np.zeros(p), {0: np.arange(len(rows))}

        def purity(at):
            n = w[at].sum()
            return sum(int(w[[k for k in at if rows[k][5] == c]].sum()) ** 2 for c in classes) / n if n else 0.0
        for level in range(s.depth):
            for i in [i for i in nodes if 2**level - 1 <= i < 2 ** (level + 1) - 1]:
                at, best = nodes[i], None
                for f in np.flatnonzero(s.allowed(p, t, [i])[0]):
                    for cut in range(1, len(edges[f]) + 1):
                        for side in (False, True):
                            goes = np.where(bins[at, f] < 0, side, bins[at, f] < cut)
                            left, right = at[goes], at[~goes]
                            if min(w[left].sum(), w[right].sum()) < s.least_rows:
                                continue
                            gain = purity(left) + purity(right) - purity(at)
                            if gain > T.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                                best = gain, f, left, right
                if best:
                    own[best[1]] += best[0]
                    nodes[2 * i + 1], nodes[2 * i + 2] = best[2], best[3]
        total += own / own.sum()
    return total / total.sum()


def test_forest_against_exhaustive_search(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_SUMS", 500)
    df, rows = table(spark, 150, seed=3)
    s = T.Forest(trees=4, depth=2, seed=7)
    b = T.Binning.fit(df, COLS, 8)
    keys = {r.id: r.k for r in df.select("id", T.row_key(["id"]).alias("k")).collect()}
    want = slow_forest(rows, [keys[r[0]] for r in rows], b.edges, [0, 1, 2], s)
    got = {r.Feature: r.Importance for r in T.forest_importance(df, ["id"], COLS, "fold", s, b).collect()}
    assert [got[c] for c in COLS] == pytest.approx(list(want), abs=1e-6)
    again = {r.Feature: r.Importance for r in T.forest_importance(df.repartition(9), ["id"], COLS, "fold", s, b).collect()}
    assert got == again


def test_forest_finds_the_column_that_matters(spark):
    df, _ = table(spark, 600)
    d = df.withColumn("label", F.when(F.col("a") > 0, "x").when(F.col("a") < 0, "y").otherwise("z"))
    got = {r.Feature: r.Importance for r in T.forest_importance(d, ["id"], COLS, "label", T.Forest(20, 4)).collect()}
    assert got["a"] > 0.6 and sum(got.values()) == pytest.approx(1)
    one = d.withColumn("label", F.lit("same"))
    assert {r.Importance for r in T.forest_importance(one, ["id"], COLS, "label", T.Forest(2, 2)).collect()} == {0.0}
    assert T.forest_importance(d.limit(0), ["id"], COLS, "label", T.Forest(2, 2)).count() == 3
