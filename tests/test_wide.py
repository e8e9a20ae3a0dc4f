"""Many columns and many categories: pairwise-complete correlations, sparse one-hot vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.operators import importance as I
from threatspark.operators import transforms as X


def pairwise(x, threshold):
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) > 1 and a.std() > 0 and b.std() > 0:
                r = float(np.corrcoef(a, b)[0, 1])
                if abs(r) > threshold:
                    out[f"c{i}", f"c{j}"] = r
    return out


def test_correlations_over_the_rows_that_both_have(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(1e6, 1, (300, 5))
    x = np.hstack([base, base[:, :3] * 2 + rng.normal(0, 0.2, (300, 3)), -base[:, :2], np.full((300, 1), 3.0)])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5, 2], x[6, 3] = math.inf, -math.inf
    cols = [f"c{i}" for i in range(x.shape[1])]
    rows = [[None if v != v else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {(r.a, r.b): r.r for r in I.correlated_features(df, cols, 0.5).collect()}
    want = pairwise(x, 0.5)
    assert got.keys() == want.keys() and len(want) >= 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert I.correlated_features(df, cols[:1]).count() == 0 and I.correlated_features(df.limit(0), cols).count() == 0


def test_five_hundred_columns(spark):
    p = 500
    d = spark.range(400).select(*[(F.when((F.col("id") + k) % 11 != 0, F.sin(F.col("id") * (1 + k // 2)) * (1 + k % 2))).alias(f"c{k}")
                                  for k in range(p)])
    got = {(r.a, r.b): r.r for r in I.correlated_features(d, d.columns, 0.99).collect()}
    assert all((f"c{k}", f"c{k + 1}") in got for k in range(0, p, 2))
    assert got["c0", "c1"] == pytest.approx(1.0)


def test_sparse_dummies_equal_the_wide_ones(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "c", "x"), (5, "b", "x"), (5, "b", "x")]
    df = spark.createDataFrame(rows, "id int, k string, onehot string")       # a name like the output's
    for first in (True, False):
        wide = X.dummies(df, ["k", "onehot"], drop_first=first)
        got, sizes = X.sparse_dummies(df, ["k", "onehot"], drop_first=first)
        assert sizes == {"k": 3 - first, "onehot": 2 - first}
        want = sorted((r[0], list(r[1:])) for r in wide.collect())
        assert sorted((r.id, [int(v) for v in [*r.onehot_k.toArray(), *r.onehot_onehot.toArray()]]) for r in got.collect()) == want
    empty, sizes = X.sparse_dummies(df.withColumn("k", F.lit(None).cast("string")), ["k"])
    assert sizes == {"k": 0} and empty.count() == 6 and empty.first().onehot_k.size == 0
    assert X.sparse_dummies(df.limit(0), ["k"])[0].count() == 0


def test_a_quarter_million_values(spark):
    n = 250_000
    df = spark.range(2 * n).select("id", F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias("k"))
    d = X.dictionary(df, "k")
    assert d.count() == n and d.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first() == (0, n - 1, n)
    first = d.orderBy("idx").limit(3).collect()
    assert [r.value for r in first] == sorted(r.value for r in first) == ["v0", "v1", "v10"]
    got, sizes = X.sparse_dummies(df, ["k"])
    assert sizes == {"k": n - 1}
    assert got.filter("id = 0 or id = 1").count() == 2
    hot = {r.id: list(r.onehot_k.indices) for r in got.filter("id in (0, 1, 250001)").collect()}
    assert hot[0] == [] and hot[1] == hot[250_001] == [0]


def test_category_values_by_rows(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "k string, e string")
    assert X.category_values(df, ["k", "e"]) == {"k": ["a", "b"], "e": []}
    with pytest.raises(ValueError, match="k"):
        X.category_values(df, ["k", "e"], max_categories=1)
