"""Pipeline stages: what they learn is saved with them."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from threatspark.operators import stages as G
from threatspark.operators.models import assembler, score
from threatspark.operators.transforms import impute_mean, min_max


@pytest.fixture()
def raw(spark):
    rows = [(i, "x", float(i % 7) if i % 5 else None, float("inf") if i % 11 == 0 else float(i), 0.0, 1.0, "BENIGN" if i % 3 else "DDoS")
            for i in range(120)]
    return spark.createDataFrame(rows, "row_id long, `Flow ID` string, a double, b double, zero double, `Idle Mean` double, Label string")


def test_flow_pipeline_is_one_object(spark, raw, scratch):
    tail = [G.ImputeMean(cols=["a", "b"]), assembler(["a", "b"]), LogisticRegression(featuresCol="features", labelCol="traffic type", maxIter=5)]
    fitted = G.flow_pipeline(tail, keep=["row_id"], quantiles=20).fit(raw)
    fitted.write().overwrite().save(f"{scratch}/m")
    back = PipelineModel.load(f"{scratch}/m")
    assert [type(s).__name__ for s in back.stages[:6]] == ["InfinitiesToNull", "DropColumns", "DropColumns", "LabelToInt", "DropColumns",
                                                         "QuantileScaleModel"]
    new = raw.drop("Label")                     # rows to score have no label
    a, b = ({r.row_id: r.p for r in score(m, new).collect()} for m in (fitted, back))
    assert a == b and len(a) == 120
    out = back.stages[5].transform(raw)
    assert 0.0 <= out.agg(F.min("a")).first()[0] and out.agg(F.max("b")).first()[0] == 1.0
    for column in ("zero", "Idle Mean", "Flow ID", "Label"):
        assert column not in fitted.transform(raw).columns


def test_impute_stages_equal_the_functions(spark, raw, scratch):
    d = G.InfinitiesToNull().transform(raw)
    for scale in (False, True):
        model = Pipeline(stages=[G.ImputeMean(cols=["a", "b"], scale=scale)]).fit(d)
        model.write().overwrite().save(f"{scratch}/i{scale}")
        got = PipelineModel.load(f"{scratch}/i{scale}").transform(d).select("row_id", "a", "b").collect()
        want = min_max(d, ["a", "b"], impute=True) if scale else impute_mean(d, ["a", "b"])
        assert sorted(got) == sorted(want.select("row_id", "a", "b").collect())
    assert model.transform(d.drop("b")).columns == [c for c in d.columns if c != "b"]


def test_empty_and_null_columns(spark):
    d = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    model = Pipeline(stages=[G.DropZeroColumns(), G.ImputeMean(scale=True), G.QuantileScale(quantiles=5)]).fit(d)
    assert [tuple(r) for r in model.transform(d).collect()] == [(None, None), (None, None)]
    assert model.transform(d.limit(0)).count() == 0
