"""Property tests (hypothesis) on random inputs; few examples, each is a Spark job."""
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from threatspark.operators import sampling as S
from threatspark.operators.transforms import QuantileModel

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(keys=st.lists(st.integers(0, 10**6), min_size=1, max_size=200, unique=True),
       groups=st.integers(1, 4), seed=st.integers(0, 99), hex_digits=st.integers(1, 3))
def test_rank_equals_row_number(spark, keys, groups, seed, hex_digits):
    df = spark.createDataFrame([(k, k % groups) for k in keys], "k long, g long")
    got = S.hash_rank(df, ["k"], seed, by=["g"], out="r", hex_digits=hex_digits)
    w = Window.partitionBy("g").orderBy(S.hash_key(seed, ["k"]), "k")
    exp = df.withColumn("r", F.row_number().over(w).cast("bigint"))
    assert sorted(map(tuple, got.select("k", "r").collect())) == \
        sorted(map(tuple, exp.select("k", "r").collect()))


@SETTINGS
@given(vals=st.lists(st.one_of(st.integers(-5, 5).map(float),
                               st.floats(-1e3, 1e3, allow_nan=False)), min_size=2, max_size=150),
       nq=st.integers(2, 60))
def test_quantile_output_bounded_and_monotone(spark, vals, nq):
    df = spark.createDataFrame(list(enumerate(vals)), "id long, x double")
    qm = QuantileModel.fit(df, ["x"], ["id"], n_quantiles=nq, subsample=None)
    out = np.array([r[1] for r in qm.transform(df).orderBy("id").collect()])
    x = np.array(vals)
    assert out.min() >= 0.0 and out.max() <= 1.0
    order = np.argsort(x, kind="stable")
    assert np.all(np.diff(out[order]) >= -1e-12)
    assert out[np.argmin(x)] == 0.0


@SETTINGS
@given(n=st.integers(3, 300), frac=st.sampled_from([0.7, 0.8]), seed=st.integers(0, 50))
def test_split_partitions_input(spark, n, frac, seed):
    df = spark.range(0, n)
    t = S.train_test(df, ["id"], seed, train=frac)
    rows = t.collect()
    assert len(rows) == n and len({r[0] for r in rows}) == n
    assert sum(r[1] for r in rows) == int(np.floor(frac * n))
