"""Null, NaN and out-of-range inputs that the stand-in tables do not hold."""
import math

import pytest
from pyspark.sql import functions as F

from threatspark.functions import labels as L
from threatspark.operators import metrics as M
from threatspark.operators import sampling as S
from threatspark.operators.transforms import QuantileModel, category_values
from threatspark.session import ensure_checkpoint_dir
from threatspark.sources.arff import header, read_arff
from threatspark.sources.readers import sink_sizes


def test_nan_and_null_scores_have_no_decision(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (float("nan"),), (None,)], "p double")
    got = [tuple(r) for r in df.select(L.decide_expr(F.col("p")), L.verdict_expr(F.col("p"))).collect()]
    assert got == [(0, "Benign"), (1, "Malicious"), (None, None), (None, None)]


def test_rank_keeps_null_groups_and_blocks(spark):
    rows = [(None, 1, 5), (None, 2, None), ("a", 3, None), ("a", 4, 1), ("b", 5, 2)]
    df = spark.createDataFrame(rows, "g string, k int, o int")
    got = {r.k: r.r for r in S.ordered_rank(df, ["g"], ["o", "k"], ["o"], out="r").collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 2, 5: 1}


def test_auc_ignores_unscored_rows_on_both_paths(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (1, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "label int, p double")
    assert M.roc_auc(df) == pytest.approx(0.75)
    groups = M._score_groups(df, "label", "p")
    one, many = ({r.s: r.tp_above for r in M.positives_above(groups, rows_per_bucket=n).collect()} for n in (100, 1))
    assert one == many and len(one) == 4


def test_focal_loss_from_the_definition(spark):
    rows = [(1, 0.9), (0, 0.2), (1, 0.3), (0, 0.99)]
    df = spark.createDataFrame(rows, "label int, p double")
    want = 0.0
    for y, p in rows:
        t, w = (p, M.FOCAL_ALPHA) if y else (1 - p, 1 - M.FOCAL_ALPHA)
        want -= w * (1 - t) ** M.FOCAL_GAMMA * math.log(t + M.EPSILON) / len(rows)
    assert M.focal_loss(df).first()[0] == pytest.approx(want, rel=1e-9)


def test_quantile_transform_keeps_nan_missing(spark):
    m = QuantileModel(["x"], {"x": [0.0, 1.0]}, {"x": [0.0, 1.0]}, {"x": [0.0, 1.0]})
    df = spark.createDataFrame([(float("nan"),), (None,), (0.5,), (2.0,)], "x double")
    assert [r.x for r in m.transform(df).collect()] == [None, None, 0.5, 1.0]


def test_categories_have_no_cap_unless_asked(spark):
    df = spark.range(12_000).select(F.col("id").cast("string").alias("c"))
    assert len(category_values(df, ["c"])["c"]) == 12_000
    with pytest.raises(ValueError):
        category_values(df, ["c"], max_categories=11_999)


def test_arff_rows_that_start_with_a_directive_sign(spark, scratch):
    path = f"{scratch}/a.arff"
    with open(path, "w") as f:
        f.write("@relation r\n% note\n@attribute name string\n@attribute n numeric\n@DATA\n@host,1\n% skipped\n"
                "@attribute,2\n@data,3\nplain,?\n")
    assert [(a.name, a.numeric) for a in header(path)[0]] == [("name", False), ("n", True)]
    got = [tuple(r) for r in read_arff(spark, path).collect()]
    assert got == [("@host", 1.0), ("@attribute", 2.0), ("@data", 3.0), ("plain", None)]


def test_sink_sizes_sees_every_format(spark, scratch):
    spark.range(3).write.csv(f"{scratch}/out/csv")
    spark.range(3).write.parquet(f"{scratch}/out/parquet")
    found = [r.path for r in sink_sizes(spark, f"{scratch}/out").collect()]
    assert any(p.endswith(".csv") for p in found) and any(p.endswith(".parquet") for p in found)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_correlated_features_with_constant_and_null_columns(spark):
    from threatspark.operators.importance import correlated_features, correlated_to_drop
    rows = [(float(i), 2.0 * i + 1, 5.0, float(i % 3), None if i % 4 == 0 else -3.0 * i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, `b.1` double, const double, c double, holes double, none double")
    cols = ["a", "b.1", "const", "c", "holes", "none"]
    got = {(r["a"], r["b"]): r["r"] for r in correlated_features(df, cols, 0.9).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {
        ("a", "b.1"): 1.0, ("a", "holes"): -1.0, ("b.1", "holes"): -1.0}
    assert correlated_to_drop(df, cols, 0.9) == ["b.1", "holes"]
    assert correlated_features(df.limit(0), cols).count() == 0
    assert correlated_features(df, ["const", "none"]).count() == 0
