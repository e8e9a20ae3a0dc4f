"""Query registry: one Spark query per operator plus the equivalent DuckDB SQL.

Every query reads the driver tables through the stand-in views of
``fixtures`` (so its work grows with the tables) and runs whole tables. Float
results are rounded to 6 decimals on both sides before comparison. Queries
without SQL (model fits) are checked on rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as C
from ..functions import labels as L
from ..operators import graph as G
from ..operators import importance as I
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import sampling as S
from ..operators.transforms import (QuantileModel, apply_standardize, dummies,
                                    fit_standardize, impute_mean, quantile_state)
from . import flow as FL
from . import malware as MW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DEC = 6


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(c if isinstance(c, F.Column) else F.col(c), DEC)


def oracle(views: list[str], body: str, ctes: str = "") -> str:
    parts = [f"{n} AS ({fx.VIEW_SQL[n]})" for n in views]
    if ctes:
        parts.append(ctes)
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


KEY = fx.FLOW_KEY
KEY_SQL = ", ".join(KEY)
MD5 = "md5(concat_ws(':', '{seed}', {cols}))"


def md5_sql(seed, cols=KEY_SQL) -> str:
    return MD5.format(seed=seed, cols=cols)


def flows_clean(spark, sf):
    """P17 -> P1 (identifiers but the key) -> P2 on the flows stand-in."""
    d = C.inf_to_null(fx.flows(spark, sf))
    d = C.drop_columns(d, ["flow_ts"])
    zeros = C.zero_columns(d.drop(*KEY))
    return d.drop(*zeros)


FLOW_FEATS = ["fwd_packet_length_max", "flow_bytes_s", "flow_iat_mean", "flow_iat_min",
              "rare_zero"]
FLOW_CLEAN_SQL = ("flows_clean AS (SELECT flow_id, source_port, part_id, supp_id, "
                  "fwd_packet_length_max, flow_bytes_s, flow_iat_mean, flow_iat_min, rare_zero, "
                  "label FROM flows)")
TT_SQL = "CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 'Normal' ELSE 'Attack' END"

# ---------------------------------------------------------------- flows: columns


@query("flow_binary_label", oracle(["flows"], f"""
SELECT label, {TT_SQL} AS traffic_type, count(*) AS n FROM flows GROUP BY ALL"""))
def q_flow_binary_label(spark, sf):
    d = L.binary_label(flows_clean(spark, sf), "label", "traffic_type")
    return d.groupBy("label", "traffic_type").agg(F.count(F.lit(1)).alias("n"))


@query("flow_drop_columns", oracle(["flows"], """
SELECT flow_id, source_port, part_id, supp_id, fwd_packet_length_max, flow_bytes_s,
       flow_iat_mean, flow_iat_min, rare_zero, label FROM flows"""))
def q_flow_drop_columns(spark, sf):
    """P1 + P2 + P3: identifiers, all-zero and redundant columns removed."""
    d = flows_clean(spark, sf)
    return C.drop_columns(d, C.REDUNDANT_FEATURES_TRAINING)


_ZERO_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, coalesce(bool_and(coalesce({c} = 0, false)), true) AS all_zero "
    f"FROM flows" for c in ["source_port", "fwd_packet_length_max", "flow_bytes_s",
                            "flow_iat_mean", "flow_iat_min", "bwd_urg_flags", "rare_zero"])


@query("flow_zero_columns", oracle(["flows"], _ZERO_UNION))
def q_flow_zero_columns(spark, sf):
    d = fx.flows(spark, sf).drop("flow_id", "part_id", "supp_id", "flow_ts")
    return C.zero_flags(d)


@query("flow_profile", oracle(["flows"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM flows"
    for c in ["flow_id", "source_port", "part_id", "supp_id", "flow_ts",
              "fwd_packet_length_max", "flow_bytes_s", "flow_iat_mean", "flow_iat_min",
              "bwd_urg_flags", "rare_zero", "label"])))
def q_flow_profile(spark, sf):
    return P.profile(fx.flows(spark, sf)).select(F.col("column").alias("column_name"), "non_null")


@query("flow_shape", oracle(["flows"], """
SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns FROM flows_clean""", FLOW_CLEAN_SQL))
def q_flow_shape(spark, sf):
    return P.shape(flows_clean(spark, sf))


@query("flow_value_counts", oracle(["flows"], """
SELECT label, count(*) AS count FROM flows WHERE label IS NOT NULL GROUP BY label"""))
def q_flow_value_counts(spark, sf):
    return P.value_counts(fx.flows(spark, sf), "label")


@query("flow_distinct_labels", oracle(["flows"], "SELECT DISTINCT label FROM flows"))
def q_flow_distinct_labels(spark, sf):
    return P.distinct_values(fx.flows(spark, sf), "label")


@query("flow_has_nulls", oracle(["flows"], """
SELECT bool_or(fwd_packet_length_max IS NULL) AS fwd_packet_length_max,
       bool_or(flow_bytes_s IS NULL) AS flow_bytes_s, bool_or(rare_zero IS NULL) AS rare_zero,
       bool_or(label IS NULL) AS label FROM flows"""))
def q_flow_has_nulls(spark, sf):
    return P.has_nulls(fx.flows(spark, sf), ["fwd_packet_length_max", "flow_bytes_s",
                                            "rare_zero", "label"])


@query("flow_head", oracle(["flows"], f"""
SELECT {KEY_SQL}, label FROM flows ORDER BY {KEY_SQL} LIMIT 5"""))
def q_flow_head(spark, sf):
    return P.head(fx.flows(spark, sf).select(*KEY, "label"), KEY, 5)


@query("flow_label_encode", oracle(["flows"], f"""
SELECT CASE WHEN {TT_SQL} = 'Normal' THEN 0 WHEN {TT_SQL} = 'Attack' THEN 1 END AS code,
       count(*) AS n FROM flows GROUP BY ALL"""))
def q_flow_label_encode(spark, sf):
    d = L.binary_label(fx.flows(spark, sf), "label", "tt")
    d = L.map_values(d, "tt", L.TRAFFIC_CODES, out="code")
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("flow_label_int", oracle(["flows"], """
SELECT CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 0 ELSE 1 END AS traffic_type,
       count(*) AS n FROM flows GROUP BY ALL"""))
def q_flow_label_int(spark, sf):
    d = L.binary_label_int(fx.flows(spark, sf), "label", "traffic_type")
    assert "label" not in d.columns
    return d.groupBy("traffic_type").agg(F.count(F.lit(1)).alias("n"))


@query("flow_cast", oracle(["flows"], f"""
SELECT {KEY_SQL}, round(CAST(CAST(flow_iat_mean AS FLOAT) AS DOUBLE), 6) AS flow_iat_mean,
       CAST(source_port AS BIGINT) AS port FROM flows"""))
def q_flow_cast(spark, sf):
    """float32 features, long labels."""
    d = fx.flows(spark, sf).withColumn("port", F.col("source_port"))
    d = C.cast_columns(d, {"flow_iat_mean": "float", "port": "bigint"})
    return d.select(*KEY, r6(F.col("flow_iat_mean").cast("double")).alias("flow_iat_mean"), "port")


@query("flow_drop_last", oracle(["flows"], f"""
SELECT {KEY_SQL}, fwd_packet_length_max, flow_bytes_s, flow_iat_mean, flow_iat_min,
       bwd_urg_flags FROM flows"""))
def q_flow_drop_last(spark, sf):
    """P5: all but the last two columns (rare_zero, label); the timestamp is
    left out of the compared output."""
    return C.drop_last(fx.flows(spark, sf), 2).drop("flow_ts")


@query("flow_inf_to_null", oracle(["flows"], f"""
SELECT {KEY_SQL}, CASE WHEN flow_iat_mean = 0 THEN NULL
                       ELSE round(flow_bytes_s / flow_iat_mean, 6) END AS bytes_per_iat,
       count(*) OVER (PARTITION BY (flow_iat_mean = 0)) AS n_same
FROM flows"""))
def q_flow_inf_to_null(spark, sf):
    """A ratio that is +inf where the denominator is 0 counts as missing."""
    d = fx.flows(spark, sf).select(
        *KEY, "flow_iat_mean",
        F.when(F.col("flow_iat_mean") == 0, F.lit(float("inf")))
         .otherwise(F.col("flow_bytes_s") / F.col("flow_iat_mean")).alias("bytes_per_iat"))
    d = C.inf_to_null(d)
    n = d.groupBy((F.col("flow_iat_mean") == 0).alias("_z")).agg(F.count(F.lit(1)).alias("n_same"))
    # n has two rows (zero / non-zero): broadcast, so the 2-valued key never
    # funnels the table into two tasks
    return d.join(F.broadcast(n), (F.col("flow_iat_mean") == 0) == F.col("_z")).select(
        *KEY, r6("bytes_per_iat").alias("bytes_per_iat"), "n_same")


# ---------------------------------------------------------------- flows: sampling

UNDER_SQL = f"""
lab AS (SELECT *, {TT_SQL} AS traffic_type FROM flows_clean),
cnt AS (SELECT traffic_type, count(*) AS n FROM lab GROUP BY ALL),
mn AS (SELECT min(n) AS n_min FROM cnt),
rk AS (SELECT *, row_number() OVER (PARTITION BY traffic_type ORDER BY {md5_sql(10)},
              {KEY_SQL}) AS rk FROM lab),
sampled AS (SELECT rk.* EXCLUDE (rk) FROM rk, mn
            WHERE traffic_type = (SELECT traffic_type FROM cnt ORDER BY n, traffic_type LIMIT 1)
               OR rk <= floor(n_min / 0.85))"""


def flows_sampled(spark, sf):
    d = L.binary_label(flows_clean(spark, sf), "label", "traffic_type")
    return S.undersample(d, "traffic_type", KEY, ratio=0.85, seed=10)


@query("flow_undersample", oracle(["flows"], f"""
SELECT {KEY_SQL}, label, traffic_type FROM sampled""", FLOW_CLEAN_SQL + "," + UNDER_SQL))
def q_flow_undersample(spark, sf):
    return flows_sampled(spark, sf).select(*KEY, "label", "traffic_type")


@query("flow_index_join", oracle(["flows"], f"""
SELECT {KEY_SQL}, round(f.flow_bytes_s, 6) AS flow_bytes_s, l.traffic_type
FROM sampled f JOIN sampled l USING ({KEY_SQL})""",
                                 FLOW_CLEAN_SQL + "," + UNDER_SQL))
def q_flow_index_join(spark, sf):
    """The sampled features joined back to the sampled labels on the row key."""
    s = flows_sampled(spark, sf)
    feats = s.select(*KEY, r6("flow_bytes_s").alias("flow_bytes_s"))
    labels = s.select(*KEY, "traffic_type")
    return feats.join(labels, KEY, "inner")


@query("flow_train_test", oracle(["flows"], f"""
SELECT {KEY_SQL}, row_number() OVER (ORDER BY {md5_sql(10)}, {KEY_SQL})
       <= floor(0.7 * count(*) OVER ()) AS is_train FROM flows"""))
def q_flow_train_test(spark, sf):
    return S.train_test(fx.flows(spark, sf).select(*KEY), KEY, 10, train=0.7)


@query("flow_train_test_80", oracle(["flows"], f"""
SELECT {KEY_SQL}, row_number() OVER (ORDER BY {md5_sql(42)}, {KEY_SQL})
       <= count(*) OVER () - ceil(0.2 * count(*) OVER ()) AS is_train FROM flows"""))
def q_flow_train_test_80(spark, sf):
    """K3: 80/20 split, test size ceil(0.2 n)."""
    return S.train_test(fx.flows(spark, sf).select(*KEY), KEY, 42, test=0.2)


@query("flow_folds", oracle(["flows"], f"""
SELECT {KEY_SQL}, CAST((row_number() OVER (PARTITION BY {TT_SQL} ORDER BY {md5_sql(42)},
       {KEY_SQL}) - 1) % 5 AS INTEGER) AS fold FROM flows"""))
def q_flow_folds(spark, sf):
    d = L.binary_label(fx.flows(spark, sf), "label", "tt").select(*KEY, "tt")
    return S.stratified_folds(d, "tt", KEY, 5, seed=42).drop("tt")


@query("flow_shuffle", oracle(["flows"], f"""
SELECT {KEY_SQL}, row_number() OVER (ORDER BY {md5_sql(42)}, {KEY_SQL}) AS pos FROM flows"""))
def q_flow_shuffle(spark, sf):
    return S.shuffle(fx.flows(spark, sf).select(*KEY), KEY, 42)


@query("flow_tail_split", oracle(["flows"], f"""
SELECT {KEY_SQL}, row_number() OVER (ORDER BY {md5_sql(42)}, {KEY_SQL})
       > floor(count(*) OVER () * 0.8) AS is_validation FROM flows"""))
def q_flow_tail_split(spark, sf):
    return S.shuffled_tail(fx.flows(spark, sf).select(*KEY), KEY, 42)


@query("flow_sample_10k", oracle(["flows"], f"""
SELECT {KEY_SQL} FROM flows ORDER BY {md5_sql(10)}, {KEY_SQL} LIMIT 10000"""))
def q_flow_sample_10k(spark, sf):
    """A repeatable sample of exactly 10,000 rows."""
    return S.smallest_hash_sample(fx.flows(spark, sf).select(*KEY), KEY, 10, 10000)


# ---------------------------------------------------------------- flows: quantiles

QF = ["fwd_packet_length_max", "flow_bytes_s", "flow_iat_mean", "flow_iat_min"]


def _quantile_sql(src: str, nq: int = 1000) -> str:
    """Knot table in SQL: percentiles over all rows, running max, grouped by
    value. ``nq`` = min(1000, rows), 1000 for these inputs."""
    refs = "[" + ", ".join(f"{j}::DOUBLE / {nq - 1}::DOUBLE" for j in range(nq)) + "]"
    unions = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, unnest(range({nq})) AS j, "
        f"unnest(quantile_cont({c}, {refs})) AS qv FROM {src}" for c in QF)
    return f"""
qs AS ({unions}),
mono AS (SELECT feature, j, j::DOUBLE / {nq - 1}::DOUBLE AS ref,
                max(qv) OVER (PARTITION BY feature ORDER BY j ROWS UNBOUNDED PRECEDING) AS knot
         FROM qs),
knots AS (SELECT feature, knot, min(ref) AS ref_lo, max(ref) AS ref_hi FROM mono GROUP BY ALL)"""


@query("flow_quantile_fit", oracle(["flows"], """
SELECT feature, round(knot, 6) AS knot, round(ref_lo, 6) AS ref_lo, round(ref_hi, 6) AS ref_hi
FROM knots""", _quantile_sql("flows")))
def q_flow_quantile_fit(spark, sf):
    st = quantile_state(fx.flows(spark, sf), QF, 1000)
    return st.select("feature", r6("knot").alias("knot"), r6("ref_lo").alias("ref_lo"),
                     r6("ref_hi").alias("ref_hi"))


def _transform_sql(src: str, cols=QF, keep: str | None = None) -> str:
    """Two-sided interpolation in SQL: find the knot interval per value."""
    sel = []
    for c in cols:
        sel.append(f"""(SELECT CASE WHEN t.{c} IS NULL THEN NULL
              WHEN t.{c} <= min(k.knot) THEN 0.0 WHEN t.{c} >= max(k.knot) THEN 1.0
              ELSE max_by(CASE WHEN t.{c} = k.knot THEN (k.ref_lo + k.ref_hi) / 2
                               ELSE k.ref_hi + (t.{c} - k.knot) / (k.nxt - k.knot)
                                    * (k.nxt_lo - k.ref_hi) END,
                          CASE WHEN k.knot <= t.{c} THEN k.knot END) END
           FROM kn k WHERE k.feature = '{c}') AS {c}""")
    keep = keep or f"t.* EXCLUDE ({', '.join(cols)})"
    return f"""
kn AS (SELECT *, lead(knot) OVER (PARTITION BY feature ORDER BY knot) AS nxt,
              lead(ref_lo) OVER (PARTITION BY feature ORDER BY knot) AS nxt_lo FROM knots),
scaled AS (SELECT {keep}, {', '.join(s for s in sel)} FROM {src} t)"""


@query("flow_quantile_transform", oracle(["flows"], f"""
SELECT {KEY_SQL}, {', '.join(f'round(s_{c}, 6) AS {c}' for c in QF)} FROM (
  SELECT {KEY_SQL}, {', '.join(f'{c} AS s_{c}' for c in QF)} FROM scaled)""",
    _quantile_sql("flows") + "," + _transform_sql(
        "flows", keep="t.flow_id, t.source_port, t.part_id, t.supp_id")))
def q_flow_quantile_transform(spark, sf):
    fl = fx.flows(spark, sf)
    qm = QuantileModel.fit(fl, QF, KEY, n_quantiles=1000)
    out = qm.transform(fl.select(*KEY, *QF))
    return out.select(*KEY, *[r6(c).alias(c) for c in QF])


@query("flow_correlated", oracle(["flows"], " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM flows"
    for i, a in enumerate(QF) for b in QF[i + 1:])))
def q_flow_correlated(spark, sf):
    """M4 with threshold -1: every pair with its Pearson r."""
    out = I.correlated_features(fx.flows(spark, sf), QF, threshold=-1.0)
    return out.select("a", "b", r6("r").alias("r"))


CORR_COLS = [*QF, "bwd_urg_flags", "rare_zero", "bytes_total", "bytes_left"]
CORR_SQL = """corr_flows AS (SELECT *, 2 * flow_bytes_s + flow_iat_mean AS bytes_total,
    CASE WHEN source_port <> 7 THEN fwd_packet_length_max - flow_bytes_s END AS bytes_left FROM flows)"""


@query("flow_correlated_pairs", oracle(["flows"], "SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM corr_flows"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]) + ") WHERE NOT isnan(r) AND abs(r) > 0.5", CORR_SQL))
def q_flow_correlated_pairs(spark, sf):
    """M4 with constant columns, with and without nulls, and correlated ones among the features."""
    d = fx.flows(spark, sf).withColumn("bytes_total", 2 * F.col("flow_bytes_s") + F.col("flow_iat_mean")).withColumn(
        "bytes_left", F.when(F.col("source_port") != 7, F.col("fwd_packet_length_max") - F.col("flow_bytes_s")))
    out = I.correlated_features(d, CORR_COLS, threshold=0.5)
    return out.select("a", "b", r6("r").alias("r"))


PREP_FEATS = ["fwd_packet_length_max", "flow_bytes_s", "flow_iat_mean", "flow_iat_min"]


@query("flow_prepare", oracle(["flows"], f"""
SELECT {KEY_SQL}, {', '.join(f'round({c}, 6) AS {c}' for c in PREP_FEATS)}, label,
       CASE traffic_type WHEN 'Normal' THEN 0 WHEN 'Attack' THEN 1 END AS traffic_type,
       row_number() OVER (ORDER BY {md5_sql("10-split")}, {KEY_SQL})
       <= floor(0.7 * count(*) OVER ()) AS is_train
FROM (SELECT * EXCLUDE (rare_zero) FROM scaled)""",
    FLOW_CLEAN_SQL + "," + UNDER_SQL + "," + _quantile_sql("sampled") + ","
    + _transform_sql("sampled")))
def q_flow_prepare(spark, sf):
    """T9 end to end on the flows stand-in (drop list given instead of the
    forest ranking: rare_zero is treated as low-importance)."""
    fl = fx.flows(spark, sf)
    prepared, state = FL.prepare_flows(
        fl, KEY, label="label", identifiers=["flow_ts"], redundant=[],
        drop_low_importance=["rare_zero"], ratio=0.85, seed=10, train_fraction=0.7)
    cols = [*KEY, *[r6(c).alias(c) for c in state.features], "label",
            F.col(f"`{L.TRAFFIC_TYPE}`").alias("traffic_type"), "is_train"]
    return prepared.select(*cols)


@query("flow_score_prepare", oracle(["flows"], f"""
SELECT {KEY_SQL}, {', '.join(f'round({c}, 6) AS {c}' for c in QF)},
       CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 0 ELSE 1 END AS traffic_type
FROM scaled""", _quantile_sql("flows") + "," + _transform_sql("flows")))
def q_flow_score_prepare(spark, sf):
    """Scoring preparation with a fitted, saved and reloaded knot state."""
    from ..session import scratch_path
    fl = fx.flows(spark, sf)
    qm = QuantileModel.fit(fl, QF, KEY, n_quantiles=1000)
    path = scratch_path(spark, "quantiles")
    qm.save(spark, path)
    state = FL.FlowState(features=QF, zero_columns=["bwd_urg_flags"],
                         quantiles=QuantileModel.load(spark, path))
    out = FL.score_prepare(fl, state, label="label", keep=KEY,
                           identifiers=["flow_ts"], redundant=["rare_zero"])
    return out.select(*KEY, *[r6(c).alias(c) for c in QF],
                      F.col(f"`{L.TRAFFIC_TYPE}`").alias("traffic_type"))


# ---------------------------------------------------------------- malware

MAL_COLS = ["tot_bytes", "pkt_rate", "const_col", "host_degree"]
MAL_UNION_SQL = ("mal AS (SELECT *, 1 AS Label, CAST(NULL AS DOUBLE) AS host_degree "
                 "FROM malware_attack UNION ALL BY NAME SELECT *, 0 AS Label FROM malware_normal)")


def malware_union(spark, sf):
    return MW.union_labelled(fx.malware_attack(spark, sf), fx.malware_normal(spark, sf))


@query("malware_union", oracle(["malware_attack", "malware_normal"], """
SELECT event_id, round(tot_bytes, 6) AS tot_bytes, pkt_rate, const_col, host_degree, Label
FROM mal""", MAL_UNION_SQL))
def q_malware_union(spark, sf):
    d = malware_union(spark, sf)
    return d.select("event_id", r6("tot_bytes").alias("tot_bytes"), "pkt_rate", "const_col",
                    "host_degree", "Label")


@query("malware_means", oracle(["malware_attack", "malware_normal"], f"""
SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in MAL_COLS)},
       round(avg(Label), 6) AS Label FROM mal""", MAL_UNION_SQL))
def q_malware_means(spark, sf):
    m = P.column_means(malware_union(spark, sf), MAL_COLS + ["Label"])
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("malware_ranges", oracle(["malware_attack", "malware_normal"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
    f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM mal" for c in MAL_COLS + ["Label"]),
    MAL_UNION_SQL))
def q_malware_ranges(spark, sf):
    r = P.column_ranges(malware_union(spark, sf), MAL_COLS + ["Label"])
    return r.select(F.col("column").alias("column_name"), r6("min").alias("min"),
                    r6("max").alias("max"))


@query("malware_impute", oracle(["malware_attack", "malware_normal"], f"""
SELECT event_id, {', '.join(f'round(coalesce({c}, avg({c}) OVER ()), 6) AS {c}' for c in MAL_COLS)}
FROM mal""", MAL_UNION_SQL))
def q_malware_impute(spark, sf):
    d = impute_mean(malware_union(spark, sf), MAL_COLS)
    return d.select("event_id", *[r6(c).alias(c) for c in MAL_COLS])


@query("malware_minmax", oracle(["malware_attack", "malware_normal"], f"""
SELECT event_id, {', '.join(
    f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN NULL ELSE "
    f"(coalesce({c}, avg({c}) OVER ()) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) "
    f"END, 6) AS {c}" for c in MAL_COLS + ['Label'])}
FROM mal""", MAL_UNION_SQL))
def q_malware_minmax(spark, sf):
    d = MW.normalise(malware_union(spark, sf), exclude=["event_id"])
    return d.select("event_id", *[r6(c).alias(c) for c in MAL_COLS + ["Label"]])


MAL_NODE_SQL = f"""
mm AS (SELECT event_id, {', '.join(
    f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN NULL ELSE "
    f"(coalesce({c}, avg({c}) OVER ()) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) "
    f"END AS {c}" for c in MAL_COLS + ['Label'])} FROM mal),
gn AS (SELECT event_id AS node_id, CAST(floor(event_id / 50) AS BIGINT) AS chunk_id,
              CAST(Label AS BIGINT) AS label, tot_bytes, pkt_rate FROM mm),
gm AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY
              md5(concat_ws(':', '0', node_id)), node_id)
              <= floor(count(*) OVER (PARTITION BY chunk_id) * 0.8) AS is_train FROM gn)"""


@query("malware_graph_nodes", oracle(["malware_attack", "malware_normal"], """
SELECT node_id, chunk_id, label, is_train,
       round(CAST(CAST(tot_bytes AS FLOAT) AS DOUBLE), 5) AS f0,
       round(CAST(CAST(pkt_rate AS FLOAT) AS DOUBLE), 5) AS f1 FROM gm""",
    MAL_UNION_SQL + "," + MAL_NODE_SQL))
def q_malware_graph_nodes(spark, sf):
    """M14 on the normalised malware table: selected features as float32
    arrays, chunks of 50 consecutive ids, per-chunk train masks."""
    norm = MW.normalise(malware_union(spark, sf), exclude=["event_id"])
    g = MW.graph_nodes(norm, ["tot_bytes", "pkt_rate"], "event_id", chunk=50)
    return g.select("node_id", "chunk_id", "label", "is_train",
                    F.round(F.col("features")[0].cast("double"), 5).alias("f0"),
                    F.round(F.col("features")[1].cast("double"), 5).alias("f1"))


# ---------------------------------------------------------------- graph

def nodes_df(spark, sf):
    return fx.nodes(spark, sf)


@query("graph_chunks", oracle(["nodes"], """
SELECT node_id, CAST(floor(node_id / 50) AS BIGINT) AS chunk_id FROM nodes"""))
def q_graph_chunks(spark, sf):
    return S.with_chunk(nodes_df(spark, sf).select("node_id"), "node_id", 50)


@query("graph_edges", oracle(["nodes"], """
SELECT chunk_id, count(*) AS n_nodes, count(*) * (count(*) - 1) AS n_edges
FROM nodes GROUP BY chunk_id"""))
def q_graph_edges(spark, sf):
    return G.complete_graph(nodes_df(spark, sf))


MASK_SQL = ("masked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY "
            "md5(concat_ws(':', '0', node_id)), node_id) <= floor(count(*) OVER "
            "(PARTITION BY chunk_id) * 0.8) AS is_train FROM nodes)")


@query("graph_masks", oracle(["nodes"], "SELECT node_id, is_train FROM masked", MASK_SQL))
def q_graph_masks(spark, sf):
    return S.chunk_masks(nodes_df(spark, sf), "chunk_id", ["node_id"], 0.8, seed=0) \
            .select("node_id", "is_train")


@query("graph_build", oracle(["nodes"], """
SELECT node_id, chunk_id, CAST(label AS BIGINT) AS label, is_train,
       round(list_sum(list_transform(features, lambda x: CAST(x AS DOUBLE))), 4) AS feature_sum
FROM masked""", MASK_SQL))
def q_graph_build(spark, sf):
    """M14 from a wide table: the embeddings unpacked into a column per value first."""
    em = fx.nodes(spark, sf)
    width = G.vector_width(em)
    wide = em.select("node_id", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(width)])
    g = G.build_graph(wide, [f"f{i}" for i in range(width)], "node_id", "label", chunk=50)
    fsum = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return g.select("node_id", "chunk_id", "label", "is_train", F.round(fsum, 4).alias("feature_sum"))


PATH_EDGES_SQL = """
edges AS (SELECT a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b
          ON a.chunk_id = b.chunk_id AND (b.node_id = a.node_id + 1 OR b.node_id = a.node_id - 1)),
hl AS (SELECT node_id, i - 1 AS j, CAST(features[i] AS DOUBLE) AS x
       FROM nodes, range(1, len(features) + 1) t(i)),
e2 AS (SELECT src, dst FROM edges UNION ALL SELECT node_id, node_id FROM nodes),
deg AS (SELECT dst AS n, count(*) AS d FROM e2 GROUP BY dst),
prop AS (SELECT e2.dst AS node_id, hl.j, sum(hl.x / sqrt(ds.d * dd.d)) AS x
         FROM e2 JOIN deg ds ON ds.n = e2.src JOIN deg dd ON dd.n = e2.dst
         JOIN hl ON hl.node_id = e2.src GROUP BY ALL)"""


def path_edges(nodes: DataFrame) -> DataFrame:
    """A sparse graph derived from the node table: each node linked to its
    neighbours by id inside the same chunk (both directions). Built as an
    equi-join on the neighbour id (at most two candidates per node), never
    by pairing all nodes of a chunk."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("chunk_id").alias("c"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("chunk_id").alias("c"))
    cand = a.select("src", "c", F.explode(F.array(F.col("src") - 1, F.col("src") + 1))
                    .alias("dst"))
    return cand.join(b, ["dst", "c"]).select("src", "dst")


@query("graph_propagate", oracle(["nodes"], """
SELECT node_id, CAST(j AS INTEGER) AS j, round(x, 6) AS x FROM prop""", PATH_EDGES_SQL))
def q_graph_propagate(spark, sf):
    """M11 on a sparse graph derived from the nodes (id neighbours in a chunk)."""
    n = nodes_df(spark, sf)
    out = G.gcn_propagate(G.to_long(n), path_edges(n))
    return out.select("node_id", F.col("j").cast("int").alias("j"), r6("x").alias("x"))


@query("graph_chunk_mean", oracle(["nodes"], """
SELECT chunk_id, CAST(i - 1 AS INTEGER) AS j, round(avg(CAST(features[i] AS DOUBLE)), 6) AS h
FROM (SELECT chunk_id, features, unnest(range(1, len(features) + 1)) AS i FROM nodes) GROUP BY ALL"""))
def q_graph_chunk_mean(spark, sf):
    out = G.chunk_mean(nodes_df(spark, sf))
    return out.select("chunk_id", F.col("j").cast("int").alias("j"), r6("h").alias("h"))


WEIGHT_SQL = """
wt AS (SELECT 1 AS layer, i, j, ((i * 31 + j * 17) % 19 - 9) / 10.0 AS w
       FROM (SELECT unnest(range(-1, (SELECT max(len(features)) FROM nodes))) AS i) a, range(16) b(j)
       UNION ALL
       SELECT 2, i, j, ((i * 31 + j * 17) % 19 - 9) / 10.0 FROM range(-1, 16) a(i), range(2) b(j)),
cm AS (SELECT chunk_id, i - 1 AS j, avg(CAST(features[i] AS DOUBLE)) AS x
       FROM (SELECT chunk_id, features, unnest(range(1, len(features) + 1)) AS i FROM nodes) GROUP BY ALL),
h1 AS (SELECT cm.chunk_id, w.j, greatest(sum(cm.x * w.w) + max(b.w), 0) AS x
       FROM cm JOIN wt w ON w.layer = 1 AND w.i = cm.j
       JOIN wt b ON b.layer = 1 AND b.i = -1 AND b.j = w.j GROUP BY cm.chunk_id, w.j),
z AS (SELECT h1.chunk_id, w.j, sum(h1.x * w.w) + max(b.w) AS x
      FROM h1 JOIN wt w ON w.layer = 2 AND w.i = h1.j
      JOIN wt b ON b.layer = 2 AND b.i = -1 AND b.j = w.j GROUP BY h1.chunk_id, w.j),
zm AS (SELECT *, max(x) OVER (PARTITION BY chunk_id) AS mx FROM z),
lp AS (SELECT chunk_id, j, x - mx - ln(sum(exp(x - mx)) OVER (PARTITION BY chunk_id)) AS lp
       FROM zm),
fwd AS (SELECT chunk_id, max(CASE WHEN j = 0 THEN lp END) AS logp0,
               max(CASE WHEN j = 1 THEN lp END) AS logp1,
               CAST(arg_max(j, lp) AS INTEGER) AS prediction FROM lp GROUP BY chunk_id)"""


def gcn_weights(spark: SparkSession, n_in: int, hidden: int = 16, out: int = 2) -> DataFrame:
    """The fixed weight table, generated by Spark from a rule."""
    def layer(lay, n_i, n_o):
        g = spark.range(0, (n_i + 1) * n_o).select(
            (F.floor(F.col("id") / n_o) - 1).alias("i"), (F.col("id") % n_o).alias("j"))
        return g.select(F.lit(lay).alias("layer"), "i", "j",
                        (((F.col("i") * 31 + F.col("j") * 17) % 19 - 9) / 10.0).alias("w"))
    return layer(1, n_in, hidden).unionByName(layer(2, hidden, out))


@query("graph_forward", oracle(["nodes"], """
SELECT chunk_id, round(logp0, 6) AS logp0, round(logp1, 6) AS logp1, prediction FROM fwd""",
    WEIGHT_SQL))
def q_graph_forward(spark, sf):
    n = nodes_df(spark, sf)
    out = G.gcn_forward_complete(n, gcn_weights(spark, G.vector_width(n)))
    return out.select("chunk_id", r6(F.col("logp")[0]).alias("logp0"),
                      r6(F.col("logp")[1]).alias("logp1"), "prediction")


def scored_nodes(spark, sf):
    n = S.chunk_masks(nodes_df(spark, sf), "chunk_id", ["node_id"], 0.8, seed=0)
    fwd = G.gcn_forward_complete(n, gcn_weights(spark, G.vector_width(n)))
    return n.select("node_id", "chunk_id", "label", "is_train").join(fwd, "chunk_id")


@query("graph_masked_metrics", oracle(["nodes"], """
SELECT m.is_train, round(-avg(CASE WHEN m.label = 1 THEN f.logp1 ELSE f.logp0 END), 6) AS loss,
       round(avg(CASE WHEN m.label = f.prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n
FROM masked m JOIN fwd f USING (chunk_id) GROUP BY m.is_train""", MASK_SQL + "," + WEIGHT_SQL))
def q_graph_masked_metrics(spark, sf):
    m = M.masked_metrics(scored_nodes(spark, sf))
    return m.select("is_train", r6("loss").alias("loss"), r6("accuracy").alias("accuracy"), "n")


@query("graph_nll", oracle(["nodes"], """
SELECT round(-avg(CASE WHEN m.label = 1 THEN f.logp1 ELSE f.logp0 END), 6) AS nll
FROM masked m JOIN fwd f USING (chunk_id) WHERE m.is_train""", MASK_SQL + "," + WEIGHT_SQL))
def q_graph_nll(spark, sf):
    return M.nll(scored_nodes(spark, sf), mask="is_train").select(r6("nll").alias("nll"))


# ---------------------------------------------------------------- phishing

PH_CAT = ["lang", "url_length", "request_url"]
PH_VALUES = {"lang": ["de", "en", "es", "fr"], "url_length": ["-1", "0", "1"],
             "request_url": ["-1", "1"]}


@query("phish_dummies", oracle(["phishing"], """
SELECT doc_id, source, result,
       coalesce(CAST(lang = 'en' AS INTEGER), 0) AS lang_en,
       coalesce(CAST(lang = 'es' AS INTEGER), 0) AS lang_es,
       coalesce(CAST(lang = 'fr' AS INTEGER), 0) AS lang_fr,
       coalesce(CAST(url_length = '0' AS INTEGER), 0) AS url_length_0,
       coalesce(CAST(url_length = '1' AS INTEGER), 0) AS url_length_1,
       coalesce(CAST(request_url = '1' AS INTEGER), 0) AS request_url_1
FROM phishing"""))
def q_phish_dummies(spark, sf):
    return dummies(fx.phishing(spark, sf), PH_CAT, drop_first=True)


@query("phish_numeric", oracle(["phishing"], """
SELECT doc_id, CAST(url_length AS DOUBLE) AS url_length, CAST(request_url AS DOUBLE) AS request_url
FROM phishing"""))
def q_phish_numeric(spark, sf):
    d = fx.phishing(spark, sf).select("doc_id", "url_length", "request_url")
    return C.to_numeric(d, ["url_length", "request_url"])


@query("phish_rename", oracle(["phishing"], """
SELECT doc_id, url_length AS URL_Length, request_url AS Request_URL, result AS Result
FROM phishing"""))
def q_phish_rename(spark, sf):
    d = fx.phishing(spark, sf).select("doc_id", "url_length", "request_url", "result")
    return C.rename(d, {"url_length": "URL_Length", "request_url": "Request_URL",
                        "result": "Result"})


@query("phish_remap", oracle(["phishing"], """
SELECT CASE result WHEN -1 THEN 0 WHEN 1 THEN 1 END AS target, count(*) AS n
FROM phishing GROUP BY ALL"""))
def q_phish_remap(spark, sf):
    d = L.map_values(fx.phishing(spark, sf), "result", L.PHISHING_TARGET_CODES, out="target")
    return d.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("phish_dropna", oracle(["phishing"], """
SELECT doc_id, url_length, request_url, result FROM phishing
WHERE doc_id IS NOT NULL AND url_length IS NOT NULL AND request_url IS NOT NULL
  AND result IS NOT NULL"""))
def q_phish_dropna(spark, sf):
    d = fx.phishing(spark, sf).select("doc_id", "url_length", "request_url", "result")
    return C.drop_null_rows(d)


PH_STD_SQL = """
ph AS (SELECT doc_id, CAST(url_length AS DOUBLE) AS url_length,
              CAST(request_url AS DOUBLE) AS request_url, CAST(result AS DOUBLE) AS result
       FROM phishing WHERE request_url IS NOT NULL AND result IS NOT NULL),
sp AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id)
              <= count(*) OVER () - ceil(0.2 * count(*) OVER ()) AS is_train FROM ph),
st AS (SELECT avg(url_length) AS m1, stddev_pop(url_length) AS s1,
              avg(request_url) AS m2, stddev_pop(request_url) AS s2 FROM sp WHERE is_train)"""


@query("phish_standardize", oracle(["phishing"], """
SELECT doc_id, is_train,
       round((url_length - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS url_length,
       round((request_url - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS request_url
FROM sp, st""", PH_STD_SQL))
def q_phish_standardize(spark, sf):
    """P16 -> P15 -> K3 (80/20, seed 42) -> T5 fitted on the train part."""
    d = C.drop_null_rows(fx.phishing(spark, sf).select(
        "doc_id", "url_length", "request_url", "result"))
    d = C.to_numeric(d, ["url_length", "request_url", "result"])
    sp = S.train_test(d, ["doc_id"], 42, test=0.2)
    st = fit_standardize(sp.where("is_train"), ["url_length", "request_url"])
    out = apply_standardize(sp, st)
    return out.select("doc_id", "is_train", r6("url_length").alias("url_length"),
                      r6("request_url").alias("request_url"))


# ---------------------------------------------------------------- importance tables

IMP_SQL = "imp AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS Feature, round(abs(corr({c}, CASE WHEN label = 'BENIGN' THEN 0.0 "
    f"ELSE 1.0 END)), 6) AS Importance FROM flows" for c in QF) + ")"


def importance_from_data(spark, sf) -> DataFrame:
    """A (Feature, Importance) table computed from the flows: |r| between each
    feature and the binary traffic code, in one aggregate."""
    d = L.binary_label_int(fx.flows(spark, sf), "label", "y")
    row = d.agg(*[F.round(F.abs(F.corr(c, F.col("y").cast("double"))), DEC).alias(c) for c in QF])
    stack = ", ".join(f"'{c}', `{c}`" for c in QF)
    return row.selectExpr(f"stack({len(QF)}, {stack}) as (Feature, Importance)")


@query("importance_prune", oracle(["flows"], """
SELECT Feature, Importance FROM imp WHERE Importance >= 0.001""", IMP_SQL))
def q_importance_prune(spark, sf):
    return I.prune_by_importance(importance_from_data(spark, sf), below=0.001)


@query("importance_keep_above", oracle(["flows"], """
SELECT Feature, Importance FROM imp WHERE Importance > 0.002""", IMP_SQL))
def q_importance_keep_above(spark, sf):
    return I.prune_by_importance(importance_from_data(spark, sf), above=0.002)


@query("importance_sort", oracle(["flows"], """
SELECT Feature, Importance FROM imp ORDER BY Importance DESC, Feature""", IMP_SQL))
def q_importance_sort(spark, sf):
    return P.sort_desc(importance_from_data(spark, sf), "Importance", ["Feature"])


@query("importance_count_below", oracle(["flows"], """
SELECT count_if(Importance < 0.003) AS n_below FROM imp""", IMP_SQL))
def q_importance_count_below(spark, sf):
    return P.count_below(importance_from_data(spark, sf), 0.003)


@query("importance_prune_long", oracle(["flows"], f"""
SELECT {KEY_SQL}, feature, round(value, 6) AS value FROM (
  {' UNION ALL '.join(f"SELECT {KEY_SQL}, '{c}' AS feature, {c} AS value FROM flows" for c in QF)}
) lf WHERE feature IN (SELECT Feature FROM imp WHERE Importance >= 0.003)""", IMP_SQL))
def q_importance_prune_long(spark, sf):
    """J4 on long-form rows: semi join against the pruned importance table."""
    fl = fx.flows(spark, sf)
    stack = ", ".join(f"'{c}', `{c}`" for c in QF)
    long = fl.selectExpr(*KEY, f"stack({len(QF)}, {stack}) as (feature, value)")
    kept = I.prune_long(long, I.prune_by_importance(importance_from_data(spark, sf), below=0.003))
    return kept.select(*KEY, "feature", r6("value").alias("value"))


@query("importance_top_base", oracle(["phishing"], """
SELECT regexp_replace(Feature, '_-?[0-9]+$', '') AS base, max(Importance) AS Importance
FROM (SELECT 'lang_' || lang AS Feature, CAST(count(*) AS DOUBLE) AS Importance
      FROM phishing GROUP BY lang
      UNION ALL SELECT 'url_length_' || url_length, CAST(count(*) AS DOUBLE) FROM phishing
      GROUP BY url_length)
GROUP BY 1 ORDER BY Importance DESC, base LIMIT 9"""))
def q_importance_top_base(spark, sf):
    """L4 on a (Feature, Importance) table of one-hot names with their row counts."""
    ph = fx.phishing(spark, sf)
    imp = ph.groupBy(F.concat(F.lit("lang_"), "lang").alias("Feature")).agg(
        F.count(F.lit(1)).cast("double").alias("Importance")).unionByName(
        ph.groupBy(F.concat(F.lit("url_length_"), "url_length").alias("Feature")).agg(
            F.count(F.lit(1)).cast("double").alias("Importance")))
    return I.top_base_features(imp, 9)


# ---------------------------------------------------------------- packets and rules

@query("packet_filter", oracle(["packets"], """
SELECT packet_id, sport, dst_ip FROM packets WHERE proto = 'tcp' AND dst_ip = '127.0.0.1'"""))
def q_packet_filter(spark, sf):
    return L.filter_tcp_host(fx.packets(spark, sf)).select("packet_id", "sport", "dst_ip")


PORT_SQL = ("CASE WHEN sport BETWEEN 1000 AND 5000 THEN 'benign' "
            "WHEN sport BETWEEN 5001 AND 10000 THEN 'attack' END")


@query("packet_class", oracle(["packets"], f"""
SELECT packet_id, sport, {PORT_SQL} AS class FROM packets WHERE {PORT_SQL} IS NOT NULL"""))
def q_packet_class(spark, sf):
    return L.classify_port(fx.packets(spark, sf)).select("packet_id", "sport", "class")


@query("packet_counts", oracle(["packets"], f"""
SELECT {PORT_SQL} AS class, count(*) AS count FROM packets
WHERE proto = 'tcp' AND dst_ip = '127.0.0.1' AND {PORT_SQL} IS NOT NULL GROUP BY 1"""))
def q_packet_counts(spark, sf):
    d = L.classify_port(L.filter_tcp_host(fx.packets(spark, sf)))
    return P.class_counts(d, "class")


def rule_view(spark, sf) -> DataFrame:
    """Flow rows carrying the four rule columns (derived from lineitem)."""
    li = fx.table(spark, sf, "lineitem")
    return li.select(*[F.col(a).alias(b) for a, b in zip(
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], KEY)],
        (F.col("l_quantity") * 3).alias("SYN Flag Count"),
        (F.col("l_linenumber") * 20).cast("bigint").alias("RST Flag Count"),
        F.col("l_extendedprice").alias("Flow Bytes/s"),
        (F.col("l_discount") / 100.0).alias("Flow IAT Min"))


RULE_SQL = f"""
rv AS (SELECT l_orderkey AS flow_id, l_linenumber AS source_port, l_partkey AS part_id,
              l_suppkey AS supp_id, l_quantity * 3 AS syn, CAST(l_linenumber * 20 AS BIGINT) AS rst,
              l_extendedprice AS bps, l_discount / 100.0 AS iat FROM lineitem)"""


@query("flow_indicators", oracle([], f"""
SELECT {KEY_SQL}, array_to_string(list_filter([
    CASE WHEN syn > 100 THEN 'High SYN Count: ' || CAST(syn AS VARCHAR) || ' (Possible SYN Flood)' END,
    CASE WHEN rst > 100 THEN 'High RST Count: ' || CAST(rst AS VARCHAR) || ' (Possible RST Flood)' END,
    CASE WHEN bps > 10000 THEN 'High Flow Rate: ' || printf('%.2f', bps) || ' bytes/s' END,
    CASE WHEN iat < 0.0001 THEN 'Very small Inter-Arrival Time: ' || CAST(iat AS VARCHAR) END],
    lambda x: x IS NOT NULL), '; ') AS indicators,
    CAST((syn > 100)::INT + (rst > 100)::INT + (bps > 10000)::INT + (iat < 0.0001)::INT AS INTEGER)
    AS n_indicators
FROM rv""", RULE_SQL))
def q_flow_indicators(spark, sf):
    d = L.indicators(rule_view(spark, sf))
    return d.select(*KEY, F.array_join("indicators", "; ").alias("indicators"),
                    F.size("indicators").alias("n_indicators"))


@query("score_decide", oracle(["scores"], """
SELECT row_id, CAST(p > 0.5 AS INTEGER) AS decision,
       CASE WHEN p > 0.5 THEN 'Malicious' ELSE 'Benign' END AS verdict FROM scores"""))
def q_score_decide(spark, sf):
    s = fx.scores(spark, sf)
    return s.select("row_id", L.decide_expr(F.col("p")).alias("decision"),
                    L.verdict_expr(F.col("p")).alias("verdict"))


@query("score_percent", oracle(["scores"], """
SELECT row_id, printf('%.2f%%', p * 100) AS pct FROM scores"""))
def q_score_percent(spark, sf):
    return fx.scores(spark, sf).select("row_id", L.pct_expr(F.col("p")).alias("pct"))


# ---------------------------------------------------------------- metrics

def scored(spark, sf):
    s = fx.scores(spark, sf)
    return s.withColumn("prediction", L.decide_expr(F.col("p")))


@query("score_confusion", oracle(["scores"], """
SELECT label, count_if(p <= 0.5) AS pred_0, count_if(p > 0.5) AS pred_1
FROM scores GROUP BY label"""))
def q_score_confusion(spark, sf):
    return M.confusion(scored(spark, sf))


@query("score_report", oracle(["scores"], """
SELECT CAST(cls AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""", """t AS (SELECT label AS cls, count(*) AS support, count_if(label = CAST(p > 0.5 AS INT)) AS tp
           FROM scores GROUP BY 1),
     pr AS (SELECT CAST(p > 0.5 AS INT) AS cls, count(*) AS predicted FROM scores GROUP BY 1),
     s AS (SELECT coalesce(t.cls, pr.cls) AS cls, coalesce(support, 0) AS support,
                  coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
           FROM t FULL JOIN pr ON t.cls = pr.cls),
     m AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
                  coalesce(tp / nullif(support, 0), 0.0) AS recall FROM s),
     f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1
           FROM m)"""))
def q_score_report(spark, sf):
    r = M.classification_report(scored(spark, sf))
    return r.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("score_accuracy", oracle(["scores"], """
SELECT round(avg(CASE WHEN label = CAST(p > 0.5 AS INT) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM scores"""))
def q_score_accuracy(spark, sf):
    return M.accuracy(scored(spark, sf)).select(r6("accuracy").alias("accuracy"))


@query("score_auc", oracle(["scores"], """
SELECT round(sum(tp) FILTER (WHERE s > 0.5) / sum(tp + fp) FILTER (WHERE s > 0.5), 6) AS precision,
       round(sum(tp) FILTER (WHERE s > 0.5) / sum(tp), 6) AS recall,
       round(sum(fp * (above + tp / 2.0)) / (sum(tp) * sum(fp)), 6) AS roc_auc FROM c""", """g AS (SELECT p AS s, count_if(label = 1) AS tp, count_if(label <> 1) AS fp
           FROM scores GROUP BY p),
     c AS (SELECT *, coalesce(sum(tp) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING
                                            AND 1 PRECEDING), 0) AS above FROM g)"""))
def q_score_auc(spark, sf):
    b = M.binary_metrics(fx.scores(spark, sf))
    return b.select(*[r6(c).alias(c) for c in ("precision", "recall", "roc_auc")])


@query("score_focal", oracle(["scores"], """
SELECT round(-avg(0.3 * pow(1 - (CASE WHEN label = 1 THEN p ELSE 1.0 END), 3)
                      * ln((CASE WHEN label = 1 THEN p ELSE 1.0 END) + 1e-7)
                  + 0.7 * pow(CASE WHEN label = 0 THEN p ELSE 0.0 END, 3)
                      * ln(1 - (CASE WHEN label = 0 THEN p ELSE 0.0 END) + 1e-7)), 6) AS focal_loss
FROM scores"""))
def q_score_focal(spark, sf):
    return M.focal_loss(fx.scores(spark, sf)).select(r6("focal_loss").alias("focal_loss"))


@query("score_logloss", oracle(["scores"], """
SELECT round(-avg(CASE WHEN label = 1 THEN ln(least(greatest(p, 1e-7), 1 - 1e-7))
                       ELSE ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)) END), 6) AS log_loss
FROM scores"""))
def q_score_logloss(spark, sf):
    return M.log_loss(fx.scores(spark, sf)).select(r6("log_loss").alias("log_loss"))


@query("cv_summary", oracle(["scores"], """
SELECT round(avg(accuracy), 6) AS mean, round(2 * stddev_pop(accuracy), 6) AS spread FROM a""", """f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY
                     md5(concat_ws(':', '42', row_id)), row_id) - 1) % 5 AS fold FROM scores),
     a AS (SELECT fold, avg(CASE WHEN label = CAST(p > 0.5 AS INT) THEN 1.0 ELSE 0.0 END) AS accuracy
           FROM f GROUP BY fold)"""))
def q_cv_summary(spark, sf):
    """A14 over per-fold accuracies of the stratified 5-fold split of the scores."""
    f = S.stratified_folds(scored(spark, sf), "label", ["row_id"], 5, seed=42)
    per_fold = f.groupBy("fold").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    s = M.cv_summary(per_fold)
    return s.select(r6("mean").alias("mean"), r6("spread").alias("spread"))


@query("early_stop", oracle([], """
WITH h AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,
                  o_orderkey) AS epoch, o_totalprice AS val_loss FROM orders),
     i AS (SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY o_custkey ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS imp FROM h),
     l AS (SELECT *, max(CASE WHEN imp THEN epoch END) OVER (PARTITION BY o_custkey ORDER BY epoch
                  ROWS UNBOUNDED PRECEDING) AS last FROM i),
     s AS (SELECT *, epoch - last >= 3 AS stop FROM l),
     e AS (SELECT *, coalesce(min(CASE WHEN stop THEN epoch END) OVER (PARTITION BY o_custkey),
                  max(epoch) OVER (PARTITION BY o_custkey)) AS se,
                  bool_or(stop) OVER (PARTITION BY o_custkey) AS early FROM s)
SELECT o_custkey, CAST(last AS BIGINT) AS best_epoch, CAST(epoch AS BIGINT) AS stop_epoch,
       early AS stopped_early FROM e WHERE epoch = se"""))
def q_early_stop(spark, sf):
    """W1 per customer: each customer's order totals in date order are the
    'validation loss' series; patience 3. Epochs are dense positions from the
    two-level ``ordered_rank`` (blocks: order year, then month), so
    a customer with a huge share of the orders is still spread over tasks."""
    o = fx.table(spark, sf, "orders")
    h = S.ordered_rank(o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                       [F.year("o_orderdate"), F.month("o_orderdate")],
                       out="epoch")
    h = h.select("o_custkey", "epoch", F.col("o_totalprice").alias("val_loss"))
    return M.early_stop(h, patience=3, by=["o_custkey"])


# ---------------------------------------------------------------- model fits (rows only)

@query("flow_classifier")
def q_flow_classifier(spark, sf):
    """M8 + M10 on the prepared flows: fit on train, score test."""
    from ..operators import models as MD
    prepared, state = FL.prepare_flows(
        fx.flows(spark, sf), KEY, label="label", identifiers=["flow_ts"], redundant=[],
        drop_low_importance=["rare_zero"])
    d = prepared.withColumnRenamed(L.TRAFFIC_TYPE, "y")
    model = MD.flow_classifier(state.features, "y", max_iter=50).fit(MD.spread(d.where("is_train").select(*state.features, "y")))
    return MD.score(model, d.where("NOT is_train")).select(*KEY, "y", "p", "decision")


@query("cv_classifier")
def q_cv_classifier(spark, sf):
    """M9: 5-fold cross-validated classifier on the sampled flows; per-fold accuracy."""
    from ..operators import models as MD
    d = flows_sampled(spark, sf).withColumn(
        "y", F.when(F.col("traffic_type") == "Attack", 1.0).otherwise(0.0))
    f = S.stratified_folds(d.select(*KEY, *QF, "y"), "y", KEY, 5, seed=42)
    return MD.cv_fit(f.select(*QF, "y", "fold"), QF, "y", "fold", 5, kind="logistic", max_iter=20)


@query("node_classifier")
def q_node_classifier(spark, sf):
    """Propagate-then-classify on the node table, evaluated under masks."""
    from ..operators import models as MD
    n = S.chunk_masks(nodes_df(spark, sf), "chunk_id", ["node_id"], 0.8, seed=0)
    _, out = MD.node_classifier_fit(n, max_iter=50)
    return out.groupBy("is_train").agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


from . import io_queries, model_queries  # noqa: E402, F401  register further queries
