import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.operators import transforms as T


def _two_sided(x, quantiles, refs):
    """The two-sided interpolation rule of the reference's quantile transform."""
    q = np.maximum.accumulate(np.asarray(quantiles, float))
    y = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -np.asarray(refs)[::-1]))
    y = np.where(x == q[-1], 1.0, y)
    y = np.where(x == q[0], 0.0, y)
    return y


def test_quantile_transform_matches_two_sided_rule(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.integers(0, 6, 300).astype(float),     # many ties
                           rng.normal(10, 3, 200)])
    rows = [(i, float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "id long, x double")
    qm = T.QuantileModel.fit(df, ["x"], ["id"], n_quantiles=101, subsample=None)
    refs = np.linspace(0, 1, 101)
    qs = np.percentile(vals, refs * 100)
    probe = np.concatenate([vals, [-5.0, 100.0, 0.0, 5.0, 2.5]])
    pdf = spark.createDataFrame([(i, float(v)) for i, v in enumerate(probe)], "id long, x double")
    got = np.array([r[1] for r in qm.transform(pdf).orderBy("id").collect()])
    exp = _two_sided(probe, qs, refs)
    assert np.max(np.abs(got - exp)) < 1e-9
    assert got.min() >= 0 and got.max() <= 1
    order = np.argsort(probe, kind="stable")
    assert np.all(np.diff(got[order]) >= -1e-12)          # monotone


def test_quantile_transform_stays_small_code(spark):
    """Edge values of several features; of many features no generated method outgrows what the JVM compiles."""
    knots = {"a": [-1.0, 0.0, 2.0, 4.0], "b c": [0.0, 3.0], "d": [5.0]}
    lo = {"a": [0.0, 0.2, 0.6, 1.0], "b c": [0.0, 0.75], "d": [0.0]}
    hi = {"a": [0.0, 0.4, 0.6, 1.0], "b c": [0.25, 1.0], "d": [1.0]}
    m = T.QuantileModel(["a", "b c", "d", "gone"], knots, lo, hi)
    inf, nan = float("inf"), float("nan")
    xs = [None, nan, -inf, inf, -1.0, -0.5, 0.0, -0.0, 1.0, 2.0, 3.0, 4.0, 9.0]
    df = spark.createDataFrame([(i, x, x, x, "k") for i, x in enumerate(xs)], "id int, a double, `b c` double, d double, k string")
    out = m.transform(df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.orderBy("id").select("a", "`b c`", "d").collect()]
    third = 0.25 + 0.5 / 3
    assert [g[0] for g in got] == [None, None, 0.0, 1.0, 0.0, pytest.approx(0.1), pytest.approx(0.3), 0.2,
                                   pytest.approx(0.5), pytest.approx(0.6), pytest.approx(0.8), 1.0, 1.0]
    assert [g[1] for g in got] == [None, None, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, pytest.approx(third), pytest.approx(0.25 + 1 / 3), 1.0, 1.0, 1.0]
    assert [g[2] for g in got] == [None, None, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    names = [f"c{i}" for i in range(12)]
    knots = [float(i) for i in range(1000)]
    wide = T.QuantileModel(names, {n: knots for n in names}, {n: T.quantile_refs(1000) for n in names}, {n: T.quantile_refs(1000) for n in names})
    rows = wide.transform(spark.range(10).select(*[F.col("id").cast("double").alias(n) for n in names]))
    for d in (rows, rows.where("c0 + c1 > 0.5")):
        assert all(c._3().maxMethodCodeSize() < 8000 for c in parts(d))


def parts(df):
    """The pieces of generated code of a plan."""
    found = df._jdf.queryExecution().debug().codegenToSeq()
    return [found.apply(i) for i in range(found.size())]


def test_quantile_nulls_and_save_load(spark, scratch):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "id long, x double")
    qm = T.QuantileModel.fit(df, ["x"], ["id"], n_quantiles=1000)
    assert len(qm.knots["x"]) == 4          # n_quantiles capped by the rows (nulls count)
    out = {r[0]: r[1] for r in qm.transform(df).collect()}
    assert out[3] is None and out[1] == 0.0 and out[4] == 1.0
    qm.save(spark, f"{scratch}/q")
    back = T.QuantileModel.load(spark, f"{scratch}/q")
    assert back.knots == qm.knots and back.ref_lo == qm.ref_lo
    assert T.QuantileModel.load(spark, f"{scratch}/absent") is None


def test_quantile_fit_reads_all_rows(spark, monkeypatch):
    """Exact over many blocks, a hot value, nulls, NaN and infinities; no single-task percentile."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(9000, 3.0), rng.normal(0, 5, 20000), [np.inf, -np.inf]])
    y = rng.integers(0, 4, len(x)).astype(float)
    rows = [(float(a), float(b) if i % 3 else (None if i % 2 else float("nan")), None)
            for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(7)
    seen = np.array([b for _, b, _ in rows if b is not None and b == b])
    refs = np.linspace(0, 1, 200)
    exp = {"x": np.quantile(x[np.isfinite(x)], refs), "y": np.quantile(seen, refs)}
    for blocks in (16, 2048):
        monkeypatch.setattr(T, "QUANTILE_BLOCKS", blocks)
        m = T.QuantileModel.fit(df, ["x", "y", "z"], n_quantiles=200)
        for c in "xy":
            knots = np.repeat(m.knots[c], [round((hi - lo) * 199) + 1 for lo, hi in zip(m.ref_lo[c], m.ref_hi[c])])
            assert len(knots) == 200 and np.allclose(knots, exp[c], atol=1e-9)
        assert "z" not in m.knots
        ends = m.transform(df.where("abs(x) = double('inf')")).orderBy("x").select("x").collect()
        assert [r[0] for r in ends] == [0.0, 1.0]


def test_quantile_fit_of_an_empty_table(spark):
    m = T.QuantileModel.fit(spark.createDataFrame([], "x double"), ["x"])
    assert m.knots == {}


def test_min_max_constant_is_null_and_impute(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (3.0, 5.0, 1), (None, 5.0, 1)],
                               "a double, c double, Label int")
    st = T.fit_impute_minmax(df)
    out = T.apply_impute_minmax(df, st).collect()
    assert [r["a"] for r in out] == [0.0, 1.0, 0.5]       # null -> mean 2.0 -> 0.5
    assert all(r["c"] is None for r in out)               # 0/0 is missing
    assert [r["Label"] for r in out] == [0.0, 1.0, 1.0]
    imp = T.impute_mean(df, ["a"]).collect()
    assert imp[2]["a"] == 2.0


def test_standardize_population_std(spark):
    train = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, z double")
    test = spark.createDataFrame([(5.0, 4.0)], "a double, z double")
    tr, te = T.standardize(train, test, ["a", "z"])
    assert [r["a"] for r in tr.collect()] == [-1.0, 1.0]     # population std = 1
    assert te.first()["a"] == 3.0 and te.first()["z"] == 1.0  # zero std scales by 1


def test_dummies_drop_first(spark):
    df = spark.createDataFrame([(1, "-1", 0.5), (2, "1", 0.1), (3, "0", 0.2), (4, None, 0.3)],
                               "id int, s string, n double")
    out = T.dummies(df, ["s"])
    assert out.columns == ["id", "n", "s_0", "s_1"]
    got = {r["id"]: (r["s_0"], r["s_1"]) for r in out.collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (0, 0)}
    full = T.dummies(df, ["s"], drop_first=False)
    assert "s_-1" in full.columns


def test_dummies_cardinality_guard(spark):
    df = spark.range(0, 50).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError):
        T.category_values(df, ["s"], max_categories=10)
