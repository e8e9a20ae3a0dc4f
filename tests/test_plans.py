"""Plan shape: filters and projections reach the parquet scan; per-row rules
stay in whole-stage codegen (no Python)."""
import io
from contextlib import redirect_stdout


from pyspark.sql import functions as F

from threatspark.functions import labels as L
from threatspark.plans.flow import prepare_flows, score_prepare
from threatspark import fixtures as fx
from conftest import SF001


PY_EVAL = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas",
           "FlatMapGroupsInPandas", "PythonMapInArrow")


def _no_python_eval(plan):
    return not any(n in plan for n in PY_EVAL)


def _plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_packet_filter_pushed_to_scan(spark, scratch):
    pk = spark.createDataFrame(
        [(1, "tcp", "127.0.0.1", "1.1.1.1", 1200), (2, "udp", "127.0.0.1", "1.1.1.1", 6000)],
        "packet_id long, proto string, src_ip string, dst_ip string, sport int")
    pk.write.parquet(f"{scratch}/pk")
    df = L.classify_port(L.filter_tcp_host(spark.read.parquet(f"{scratch}/pk")))
    plan = _plan(df.select("packet_id", "class"))
    assert "PushedFilters: [IsNotNull(proto), EqualTo(proto,tcp)" in plan
    assert _no_python_eval(plan)


def test_projection_pruned(spark):
    fl = fx.flows(spark, SF001).select("flow_id", "flow_bytes_s")
    plan = _plan(fl)
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_no_python_in_flow_preparation(spark):
    prepared, state = prepare_flows(fx.flows(spark, SF001), fx.FLOW_KEY, label="label",
                                    identifiers=["flow_ts"], redundant=[],
                                    drop_low_importance=["rare_zero"])
    plan = _plan(prepared)
    assert _no_python_eval(plan)
    scored = score_prepare(fx.flows(spark, SF001), state, label="label", keep=fx.FLOW_KEY,
                           identifiers=["flow_ts"], redundant=["rare_zero"])
    assert _no_python_eval(_plan(scored))


def test_quantile_fit_on_train_only(spark):
    fl = fx.flows(spark, SF001)
    kw = dict(label="label", identifiers=["flow_ts"], redundant=[],
              drop_low_importance=["rare_zero"], checkpoint=False)
    _, all_state = prepare_flows(fl, fx.FLOW_KEY, **kw)
    prepared, tr_state = prepare_flows(fl, fx.FLOW_KEY, fit_on="train", **kw)
    f = "flow_bytes_s"
    assert tr_state.quantiles.knots[f] != all_state.quantiles.knots[f]
    # fitted on train rows only: the train part of the feature is uniform-ish
    lo, hi = prepared.where("is_train").agg(F.min(f), F.max(f)).first()
    assert lo == 0.0 and hi == 1.0


def test_split_independent_of_undersampling(spark):
    """Train and test get similar class shares: the split does not reuse the
    undersample's random order (which would send the kept majority rows to
    train)."""
    prepared, _ = prepare_flows(fx.flows(spark, SF001), fx.FLOW_KEY, label="label",
                                identifiers=["flow_ts"], redundant=[],
                                drop_low_importance=["rare_zero"], checkpoint=False)
    shares = {r[0]: r[1] for r in prepared.groupBy("is_train").agg(
        F.avg(F.col("`traffic type`").cast("double"))).collect()}
    assert abs(shares[True] - shares[False]) < 0.05
