"""Queries of trees (M1-M3, M5-M7), networks (M8, M9, M13, S15) and graphs (M11, M12), and SQL that repeats their fits.

The SQL grows the same trees: a chain of common table expressions, a few for
each level. Sums are integers on both sides, so splits agree exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import labels as L
from ..operators import graph as G
from ..operators import importance as I
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import networks as N
from ..operators import sampling as S
from ..operators import trees as T
from ..operators.transforms import dummies
from . import flow as FL
from . import malware as MW
from .registry import (FLOW_CLEAN_SQL, FLOW_FEATS, KEY, KEY_SQL, MAL_COLS, MAL_UNION_SQL, PATH_EDGES_SQL, PH_CAT,
                       PH_VALUES, UNDER_SQL, WEIGHT_SQL, flows_sampled, gcn_weights, malware_union, nodes_df, oracle, path_edges, query, r6)


def mixed_sql(e: str) -> str:
    """``trees.mixed``."""
    return (f"list_reduce([(({e})::BIGINT) & {T.MASK}, 1, 1, 2], lambda a, b: "
            f"CASE WHEN b = 1 THEN (xor(a >> 16, a) * 73244475) & {T.MASK} ELSE xor(a >> 16, a) END)")


def bin_sql(edges: str, x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN -1 ELSE len(list_filter({edges}, lambda e: e <= {x})) END"


def distinct_bins_sql(cols: list[str], src: str) -> str:
    """``edges`` (a list per column): all distinct values but the least."""
    return "edges AS MATERIALIZED (SELECT " + ", ".join(
        f"coalesce(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL))[2:], []) AS e_{c}" for c in cols) + f" FROM {src})"


def even_bins_sql(cols: list[str], src: str, bins: int) -> str:
    def one(c: str) -> str:
        cuts = f"list_transform(range(1, {bins}), lambda k: min({c}) + (max({c}) - min({c})) * k::DOUBLE / {bins}.0)"
        return f"CASE WHEN min({c}) = max({c}) THEN []::DOUBLE[] ELSE list_sort(list_distinct({cuts})) END AS e_{c}"
    return f"edges AS MATERIALIZED (SELECT {', '.join(one(c) for c in cols)} FROM {src})"


def _cuts_sql(cols: list[str]) -> str:
    """(f, cut): every possible cut of every column."""
    return "cuts AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {f} AS f, unnest(range(1, len(e_{c}) + 1)) AS cut FROM edges" for f, c in enumerate(cols)) + ")"


_GOES_LEFT = "CASE WHEN s.bins[b.f + 1] < 0 THEN b.side ELSE (s.bins[b.f + 1] < b.cut)::INT END"


def boost_sql(cols: list[str], src: str, y: str, s: T.Boost, names: list[str] | None = None, edges: str | None = None) -> str:
    """CTEs of a boosted fit; ``tree_nodes`` at the end has a row per node. ``names``: the columns' names in it."""
    p, S_ = len(cols), f"{T.SCALE}.0"

    def score(g: str, h: str) -> str:
        return f"(({g}) / {S_}) * (({g}) / {S_}) / (({h}) / {S_} + {s.reg})"
    parts = [edges or distinct_bins_sql(cols, src), _cuts_sql(cols), f"""
c0 AS MATERIALIZED (
  SELECT [{', '.join(bin_sql(f'e_{c}', c) for c in cols)}] AS bins, {y}::DOUBLE AS y, count(*) AS n, 0::DOUBLE AS margin
  FROM {src}, edges GROUP BY ALL)"""]
    kept = []
    for r in range(s.rounds):
        parts.append(f"""
s{r}_0 AS MATERIALIZED (
  SELECT bins, y, margin, n, 0 AS node, NULL::DOUBLE AS leaf,
    round((1 / (1 + exp(-margin)) - y) * {S_})::BIGINT * n AS g,
    round(1 / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin))) * {S_})::BIGINT * n AS h FROM c{r})""")
        for lv in range(s.depth + 1):
            at = f"{r}_{lv}"
            last = lv == s.depth
            parts.append(f"""
t{at} AS MATERIALIZED (SELECT node, sum(g) AS g, sum(h) AS h FROM s{at} WHERE node IS NOT NULL GROUP BY node),
h{at} AS MATERIALIZED (
  SELECT node, f, bins[f + 1] AS b, sum(g) AS g, sum(h) AS h FROM s{at}, range({p}) x(f) WHERE node IS NOT NULL GROUP BY ALL),
k{at} AS (
  SELECT h.node, h.f, cut, side, sum(CASE WHEN b < 0 THEN side * g WHEN b < cut THEN g ELSE 0 END) AS lg,
    sum(CASE WHEN b < 0 THEN side * h.h WHEN b < cut THEN h.h ELSE 0 END) AS lh
  FROM h{at} h JOIN cuts USING (f), range(2) y(side) GROUP BY ALL),
g{at} AS (
  SELECT k.*, {score('lg', 'lh')} + {score('t.g - lg', 't.h - lh')} - {score('t.g', 't.h')} AS gain
  FROM k{at} k JOIN t{at} t USING (node)
  WHERE lh >= {s.min_child} * {S_} AND t.h - lh >= {s.min_child} * {S_}),
b{at} AS MATERIALIZED (
  SELECT * FROM g{at} WHERE gain > {max(s.gamma, T.LEAST_GAIN)}{' AND false' if last else ''}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut, side) = 1),
n{at} AS MATERIALIZED (
  SELECT {r} AS tree, t.node, b.f, b.cut, b.side, b.gain, t.g / {S_} AS grad, t.h / {S_} AS hess,
    CASE WHEN b.f IS NULL THEN -(t.g / {S_}) / (t.h / {S_} + {s.reg}) * {s.step} END AS value
  FROM t{at} t LEFT JOIN b{at} b USING (node)),
s{r}_{lv + 1} AS MATERIALIZED (
  SELECT s.bins, s.y, s.margin, s.n, CASE WHEN b.f IS NOT NULL THEN 2 * s.node + 2 - ({_GOES_LEFT}) END AS node,
    coalesce(s.leaf, b.value) AS leaf, s.g, s.h FROM s{at} s LEFT JOIN n{at} b ON s.node = b.node)""")
            kept.append(f"SELECT * FROM n{at}")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT bins, y, n, margin + leaf AS margin FROM s{r}_{s.depth + 1})")
    names = "CASE f " + " ".join(f"WHEN {f} THEN '{c}'" for f, c in enumerate(names or cols)) + " END"
    cut = "CASE f " + " ".join(f"WHEN {f} THEN e_{c}[cut]" for f, c in enumerate(cols)) + " END"
    parts.append(f"nodes_raw AS ({' UNION ALL '.join(kept)}), "
                 f"tree_nodes AS (SELECT *, {names} AS feature, {cut} AS threshold FROM nodes_raw, edges)")
    return ",".join(parts)


def forest_sql(cols: list[str], src: str, key: str, y: str, classes: int, s: T.Forest, edges: str, decimals: int) -> str:
    """CTEs of a forest; ``importance`` (Feature, Importance) at the end. ``y`` is a class number from 0."""
    p = len(cols)
    k = min(p, s.tries or max(1, int(p ** 0.5)))
    u = f"{mixed_sql(mixed_sql(f'key + {s.seed}') + ' + t * 40503')} / {2 ** 32}.0"
    times = " + ".join(f"(u >= {float(c)!r})::INT" for c in T.POISSON)
    each = range(classes)

    def purity(n: list[str]) -> str:
        return f"({' + '.join(f'({x})::DOUBLE * ({x})' for x in n)}) / greatest({' + '.join(n)}, 1)"
    parts = [edges, _cuts_sql(cols), f"""
drawn AS MATERIALIZED (
  SELECT t, bins, y, {u} AS u FROM (
    SELECT [{', '.join(bin_sql(f'e_{c}', c) for c in cols)}] AS bins, {y} AS y, {key} AS key FROM {src}, edges), range({s.trees}) x(t)),
s0 AS MATERIALIZED (
  SELECT t, bins, 0 AS node, {', '.join(f'sum(CASE WHEN y = {c} THEN {times} ELSE 0 END) AS n{c}' for c in each)}
  FROM drawn WHERE {times} > 0 GROUP BY ALL)"""]
    kept = []
    for lv in range(s.depth):
        sums = ", ".join(f"sum(n{c}) AS n{c}" for c in each)
        left = ", ".join(f"sum(CASE WHEN b < 0 THEN side * n{c} WHEN b < cut THEN n{c} ELSE 0 END) AS l{c}" for c in each)
        lefts, rights = [f"l{c}" for c in each], [f"(t.n{c} - l{c})" for c in each]
        order = mixed_sql(mixed_sql(mixed_sql(f"f * 2654435 + {s.seed}") + " + t * 40503") + " + node * 30011")
        parts.append(f"""
t{lv} AS MATERIALIZED (SELECT t, node, {sums} FROM s{lv} GROUP BY ALL),
a{lv} AS MATERIALIZED (
  SELECT t, node, f FROM t{lv}, range({p}) x(f) QUALIFY row_number() OVER (PARTITION BY t, node ORDER BY {order}, f) <= {k}),
h{lv} AS MATERIALIZED (SELECT t, node, f, bins[f + 1] AS b, {sums} FROM s{lv} JOIN a{lv} USING (t, node) GROUP BY ALL),
k{lv} AS (SELECT h.t, h.node, h.f, cut, side, {left} FROM h{lv} h JOIN cuts USING (f), range(2) y(side) GROUP BY ALL),
g{lv} AS (
  SELECT k.*, {purity(lefts)} + {purity(rights)} - {purity([f't.n{c}' for c in each])} AS gain
  FROM k{lv} k JOIN t{lv} t USING (t, node)
  WHERE {' + '.join(lefts)} >= {s.least_rows} AND {' + '.join(rights)} >= {s.least_rows}),
b{lv} AS MATERIALIZED (
  SELECT * FROM g{lv} WHERE gain > {T.LEAST_GAIN}
  QUALIFY row_number() OVER (PARTITION BY t, node ORDER BY gain DESC, f, cut, side) = 1),
s{lv + 1} AS MATERIALIZED (
  SELECT s.t, s.bins, 2 * s.node + 2 - ({_GOES_LEFT}) AS node, {', '.join(f's.n{c}' for c in each)}
  FROM s{lv} s JOIN b{lv} b USING (t, node))""")
        kept.append(f"SELECT t, f, gain FROM b{lv}")
    names = "CASE f " + " ".join(f"WHEN {f} THEN '{c}'" for f, c in enumerate(cols)) + " END"
    parts.append(f"""
own AS (SELECT t, f, sum(gain) AS g FROM ({' UNION ALL '.join(kept)}) GROUP BY ALL),
share AS (SELECT f, g / sum(g) OVER (PARTITION BY t) AS g FROM own),
total AS (SELECT f, sum(g) AS g FROM share GROUP BY f),
importance AS (
  SELECT {names} AS "Feature", round(coalesce(g / (SELECT sum(g) FROM total), 0), {decimals}) AS "Importance"
  FROM range({p}) x(f) LEFT JOIN total USING (f))""")
    return ",".join(parts)


def key_sql(cols: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {cols})), 1, 8))::BIGINT"


# ---------------------------------------------------------------- M1 - M3

FOREST = T.Forest(trees=10, depth=4, seed=10)
FLOW_RANKED = [c for c in FLOW_FEATS if c != "rare_zero"]
RANK_BINS = 16


@query("forest_rank", oracle(["flows"], 'SELECT * FROM importance', FLOW_CLEAN_SQL + "," + UNDER_SQL + "," + forest_sql(
    FLOW_RANKED, "sampled", key_sql(KEY_SQL), "CASE label WHEN 'BENIGN' THEN 0 WHEN 'DDoS' THEN 1 ELSE 2 END", 3, FOREST,
    even_bins_sql(FLOW_RANKED, "sampled", RANK_BINS), 5)))
def q_forest_rank(spark, sf):
    """M1: forest importance against the multi-class label on the sampled flows."""
    d = flows_sampled(spark, sf)
    return I.forest_importance(d, FLOW_RANKED, "label", seed=FOREST.seed, num_trees=FOREST.trees, depth=FOREST.depth, key_cols=KEY,
                               binning=T.Binning.even(d, FLOW_RANKED, RANK_BINS))


MAL_FOREST = T.Forest(trees=10, depth=4, seed=42)
MAL_RANKED = [c for c in MAL_COLS]
MAL_TRAIN_SQL = f"""
mm AS (SELECT event_id, {', '.join(
    f"coalesce(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN NULL ELSE "
    f"(coalesce({c}, avg({c}) OVER ()) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) "
    f"END, 0) AS {c}" for c in MAL_COLS + ['Label'])} FROM mal),
train AS (SELECT * FROM mm QUALIFY row_number() OVER (ORDER BY md5(concat_ws(':', '42', event_id)), event_id)
          <= count(*) OVER () - ceil(0.2 * count(*) OVER ()))"""


@query("malware_rank", oracle(["malware_attack", "malware_normal"], 'SELECT * FROM importance WHERE "Importance" > 0.01',
                              MAL_UNION_SQL + "," + MAL_TRAIN_SQL + "," + forest_sql(
    MAL_RANKED, "train", key_sql("event_id"), "CAST(Label AS INT)", 2, MAL_FOREST, even_bins_sql(MAL_RANKED, "train", RANK_BINS), 10)))
def q_malware_rank(spark, sf):
    """M2 + M3: importance on the normalised malware rows, keep > 0.01."""
    norm = MW.normalise(malware_union(spark, sf), exclude=["event_id"]).fillna(0.0, ["const_col"])
    train = S.train_test(norm, ["event_id"], MAL_FOREST.seed, test=0.2).where("is_train")
    return MW.rank_features(norm.select("event_id", *MAL_RANKED, "Label"), ["event_id"], seed=MAL_FOREST.seed,
                            num_trees=MAL_FOREST.trees, depth=MAL_FOREST.depth, binning=T.Binning.even(train, MAL_RANKED, RANK_BINS))


# ---------------------------------------------------------------- M5, M6

TWO_ROUNDS = T.Boost(rounds=2, depth=2)


@query("boosted_nodes", oracle(["malware_attack", "malware_normal"], """
SELECT tree, node, feature, threshold, (side = 1) AS missing_left, round(gain, 6) AS gain, round(grad, 6) AS grad,
       round(hess, 6) AS hess, round(value, 6) AS value FROM tree_nodes""",
                               MAL_UNION_SQL + "," + boost_sql(MAL_COLS, "mal", "Label", TWO_ROUNDS,
                                                               edges=even_bins_sql(MAL_COLS, "mal", RANK_BINS))))
def q_boosted_nodes(spark, sf):
    """M5: the nodes of a two-round fit on columns with missing values, gradient and hessian sums, the learned sides."""
    d = malware_union(spark, sf)
    model = T.boost(d, MAL_COLS, "Label", TWO_ROUNDS, T.Binning.even(d, MAL_COLS, RANK_BINS))
    return model.nodes(spark).select("tree", "node", "feature", "threshold", "missing_left",
                                     *[r6(c).alias(c) for c in ("gain", "grad", "hess", "value")])


#: Numeric phishing columns, one of them with missing values.
PH_NUM = ["url_length", "long_url", "request_url", "lang_no"]


def phishing_numeric(spark, sf):
    d = fx.phishing(spark, sf).where("result IS NOT NULL")
    lang = F.array_position(F.array(*[F.lit(v) for v in PH_VALUES["lang"]]), F.col("lang"))
    return L.map_values(d, "result", L.PHISHING_TARGET_CODES, out="target").select(
        "doc_id", F.col("url_length").cast("double").alias("url_length"),
        F.nullif("url_length", F.lit("-1")).cast("double").alias("long_url"),
        F.col("request_url").cast("double").alias("request_url"), lang.cast("double").alias("lang_no"), "target")


PH_PAIRS = [(c, v) for c in PH_CAT for v in PH_VALUES[c][1:]]
PH_ONE_HOT = [f"{c}_{v}" for c, v in PH_PAIRS]
PH_ONE_HOT_SQL = "ph AS (SELECT " + ", ".join(
    f"coalesce(CAST({c} = '{v}' AS DOUBLE), 0) AS x{i}" for i, (c, v) in enumerate(PH_PAIRS)) + """,
  CASE result WHEN -1 THEN 0 ELSE 1 END AS target FROM phishing WHERE result IS NOT NULL)"""
FEW_ROUNDS = T.Boost(rounds=4, depth=3, reg=0.0)


def phishing_one_hot(spark, sf):
    d = dummies(fx.phishing(spark, sf).select("doc_id", *PH_CAT, "result").where("result IS NOT NULL"), PH_CAT)
    d = L.map_values(d, "result", L.PHISHING_TARGET_CODES, out="target")
    return d, [c for c in d.columns if c not in ("doc_id", "result", "target")]


@query("boosted_split_counts", oracle(["phishing"], """
SELECT feature AS "Feature", count(*)::DOUBLE AS "Importance" FROM tree_nodes WHERE feature IS NOT NULL GROUP BY ALL""",
                                      PH_ONE_HOT_SQL + "," + boost_sql([f"x{i}" for i in range(len(PH_ONE_HOT))], "ph", "target",
                                                                       FEW_ROUNDS, PH_ONE_HOT)))
def q_boosted_split_counts(spark, sf):
    """M5 + M6: boosted trees on the one-hot phishing table, split counts."""
    d, feats = phishing_one_hot(spark, sf)
    return T.boost(d, feats, "target", FEW_ROUNDS).split_counts(spark)


@query("boosted_rank")
def q_boosted_rank(spark, sf):
    """M5 + M6 with the reference's 100 rounds."""
    d, feats = phishing_one_hot(spark, sf)
    return I.boosted_fit(d, feats, "target").split_counts(spark)


# ---------------------------------------------------------------- M7


@query("phish_search")
def q_phish_search(spark, sf):
    """M7: ten settings of the reference's grid, five folds each, by mean accuracy."""
    d = phishing_numeric(spark, sf)
    split = S.train_test(d, ["doc_id"], 42, test=0.2).where("is_train")
    train = S.stratified_folds(split, "target", ["doc_id"], MD.SEARCH_FOLDS, seed=42)
    found = MD.random_search(train, PH_NUM, "target")
    return found.results.select("setting", "rounds", "depth", "step", "subsample", "colsample",
                                F.transform("fold_accuracy", lambda a: F.round(a, 6)).alias("fold_accuracy"),
                                r6("mean_accuracy").alias("mean_accuracy"), r6("std_accuracy").alias("std_accuracy"), "place")


# ---------------------------------------------------------------- M8, M9, S15

STEP_COLS = ["x0", "x1", "x2"]
STEPS, STEP_RATE = 4, 0.1
FOCAL = N.Objective(N.FOCAL_GAMMA, N.FOCAL_ALPHA)


def scaled_flows(spark, sf):
    """The sampled flows with three columns near one, a 0/1 label and a fifth of them held out by key."""
    return flows_sampled(spark, sf).select(
        *KEY, (F.col("fwd_packet_length_max") / 50).alias("x0"), (F.col("flow_iat_mean") * 10).alias("x1"),
        (F.col("flow_iat_min") * 10).alias("x2"), (F.col("traffic_type") == "Attack").cast("int").alias("y"),
        (T.row_key(KEY) % 5 == 0).alias("held"))


def focal_sql() -> str:
    """Adam steps on the focal loss of a logistic model, an epoch for each pair of expressions."""
    start, _ = N.ResidualNet(len(STEP_COLS), ()).start(42)
    eps, g, a = N.EPSILON, FOCAL.gamma, FOCAL.alpha
    names = ["w0", "w1", "w2", "b"]
    loss = (f"-CASE WHEN y = 1 THEN {a} * pow(1 - p, {g}) * ln(p + {eps}) ELSE {1 - a} * pow(p, {g}) * ln(1 - p + {eps}) END")
    one = f"{a} * ({g} * pow(1 - p, {g - 1}) * ln(p + {eps}) - pow(1 - p, {g}) / (p + {eps}))"
    zero = f"{1 - a} * (pow(p, {g}) / (1 - p + {eps}) - {g} * pow(p, {g - 1}) * ln(1 - p + {eps}))"
    parts = [f"""
data AS MATERIALIZED (
  SELECT fwd_packet_length_max / 50 AS x0, flow_iat_mean * 10 AS x1, flow_iat_min * 10 AS x2,
    (traffic_type = 'Attack')::INT AS y, {key_sql(KEY_SQL)} % 5 = 0 AS held FROM sampled),
e0 AS (SELECT {', '.join(f'{float(v)!r}::DOUBLE AS {n}, 0::DOUBLE AS m_{n}, 0::DOUBLE AS v_{n}' for n, v in zip(names, start, strict=True))})"""]
    for t in range(1, STEPS + 1):
        sums = ", ".join(f"sum(d * {x}) FILTER (NOT held) / count(*) FILTER (NOT held) AS g_{n}"
                         for n, x in zip(names, [*STEP_COLS, "1"], strict=True))
        moved = ", ".join(f"0.9 * m_{n} + 0.1 * g_{n} AS m_{n}, 0.999 * v_{n} + 0.001 * g_{n} * g_{n} AS v_{n}, {n}" for n in names)
        new = ", ".join(f"{n} - {STEP_RATE} * (m_{n} / (1 - pow(0.9, {t}))) / (sqrt(v_{n} / (1 - pow(0.999, {t}))) + 1e-7) AS {n}, m_{n}, v_{n}"
                        for n in names)
        parts.append(f"""
p{t} AS MATERIALIZED (SELECT data.*, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + b))) AS p FROM data, e{t - 1}),
d{t} AS MATERIALIZED (SELECT *, {loss} AS loss, (CASE WHEN y = 1 THEN {one} ELSE {zero} END) * p * (1 - p) AS d FROM p{t}),
s{t} AS MATERIALIZED (
  SELECT {t} AS epoch, avg(loss) FILTER (NOT held) AS loss, avg(((p > 0.5) = (y = 1))::INT) FILTER (NOT held) AS accuracy,
    avg(loss) FILTER (held) AS val_loss, avg(((p > 0.5) = (y = 1))::INT) FILTER (held) AS val_accuracy, {sums} FROM d{t}),
e{t} AS MATERIALIZED (SELECT {new} FROM (SELECT {moved} FROM e{t - 1}, s{t}))""")
    return ",".join(parts)


@query("focal_history", oracle(["flows"], " UNION ALL ".join(
    f"SELECT epoch, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(val_loss, 6) AS val_loss, "
    f"round(val_accuracy, 6) AS val_accuracy FROM s{t}" for t in range(1, STEPS + 1)),
    FLOW_CLEAN_SQL + "," + UNDER_SQL + "," + focal_sql()))
def q_focal_history(spark, sf):
    """M8 + S15: focal loss and accuracies of each Adam step of a logistic model on the sampled flows."""
    model = N.fit_network(scaled_flows(spark, sf), STEP_COLS, "y", KEY, "held", hidden=(), objective=FOCAL, epochs=STEPS, rate=STEP_RATE)
    return N.history_table(spark, model.state).select("epoch", *[r6(c).alias(c) for c in ("loss", "accuracy", "val_loss", "val_accuracy")])


@query("network_history")
def q_network_history(spark, sf):
    """M8 + S15: the residual network on the prepared flows, warm-up and focal epochs, held-out loss, early stop."""
    prepared, state = FL.prepare_flows(fx.flows(spark, sf), KEY, label="label", identifiers=["flow_ts"], redundant=[],
                                       drop_low_importance=["rare_zero"])
    d = prepared.withColumnRenamed(L.TRAFFIC_TYPE, "y").withColumn("held", ~F.col("is_train"))
    model = N.fit_network(d, state.features, "y", KEY, "held", epochs=12, warmup=3, rate=0.01, class_weight="balanced")
    return N.history_table(spark, model.state)


@query("network_scores")
def q_network_scores(spark, sf):
    """M8 + M10: held-out scores of the focal network at its best epoch."""
    d = scaled_flows(spark, sf)
    model = N.fit_network(d, STEP_COLS, "y", KEY, "held", epochs=8, rate=0.02)
    return model.score(d.filter("held")).select(*KEY, "y", r6("p").alias("p"), "decision")


@query("network_cv")
def q_network_cv(spark, sf):
    """M9: five-fold cross-validation of the focal network, then A14's summary of it."""
    d = S.stratified_folds(scaled_flows(spark, sf), "y", KEY, 5, seed=42)
    return M.cv_summary(N.cv_network(d, STEP_COLS, "y", KEY, "fold", 5, epochs=4, rate=0.05))


CV_FOLDS, CV_STEPS = 5, 3


def focal_cv_sql() -> str:
    """``focal_sql`` with every fold held out in turn: (k, fold's accuracy at the epoch of least held-out loss)."""
    start, _ = N.ResidualNet(len(STEP_COLS), ()).start(42)
    eps, g, a = N.EPSILON, FOCAL.gamma, FOCAL.alpha
    names = ["w0", "w1", "w2", "b"]
    loss = f"-CASE WHEN y = 1 THEN {a} * pow(1 - p, {g}) * ln(p + {eps}) ELSE {1 - a} * pow(p, {g}) * ln(1 - p + {eps}) END"
    one = f"{a} * ({g} * pow(1 - p, {g - 1}) * ln(p + {eps}) - pow(1 - p, {g}) / (p + {eps}))"
    zero = f"{1 - a} * (pow(p, {g}) / (1 - p + {eps}) - {g} * pow(p, {g - 1}) * ln(1 - p + {eps}))"
    parts = [f"""
data AS MATERIALIZED (
  SELECT fwd_packet_length_max / 50 AS x0, flow_iat_mean * 10 AS x1, flow_iat_min * 10 AS x2, (traffic_type = 'Attack')::INT AS y,
    (row_number() OVER (PARTITION BY traffic_type ORDER BY md5(concat_ws(':', '42', {KEY_SQL})), {KEY_SQL}) - 1) % {CV_FOLDS} AS fold FROM sampled),
e0 AS (SELECT k, {', '.join(f'{float(v)!r}::DOUBLE AS {n}, 0::DOUBLE AS m_{n}, 0::DOUBLE AS v_{n}' for n, v in zip(names, start, strict=True))}
       FROM range({CV_FOLDS}) r(k))"""]
    for t in range(1, CV_STEPS + 1):
        sums = ", ".join(f"sum(d * {x}) FILTER (fold <> k) / count(*) FILTER (fold <> k) AS g_{n}"
                         for n, x in zip(names, [*STEP_COLS, "1"], strict=True))
        moved = ", ".join(f"0.9 * m_{n} + 0.1 * g_{n} AS m_{n}, 0.999 * v_{n} + 0.001 * g_{n} * g_{n} AS v_{n}, {n}" for n in names)
        new = ", ".join(f"{n} - {STEP_RATE} * (m_{n} / (1 - pow(0.9, {t}))) / (sqrt(v_{n} / (1 - pow(0.999, {t}))) + 1e-7) AS {n}, m_{n}, v_{n}"
                        for n in names)
        parts.append(f"""
p{t} AS MATERIALIZED (SELECT data.*, k, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + b))) AS p FROM data, e{t - 1}),
d{t} AS MATERIALIZED (SELECT *, {loss} AS loss, (CASE WHEN y = 1 THEN {one} ELSE {zero} END) * p * (1 - p) AS d FROM p{t}),
s{t} AS MATERIALIZED (
  SELECT k, {t} AS epoch, avg(loss) FILTER (fold = k) AS val_loss, avg(((p > 0.5) = (y = 1))::INT) FILTER (fold = k) AS val_accuracy, {sums}
  FROM d{t} GROUP BY k),
e{t} AS MATERIALIZED (SELECT k, {new} FROM (SELECT k, {moved} FROM e{t - 1} JOIN s{t} USING (k)))""")
    return ",".join(parts)


@query("cv_focal", oracle(["flows"], "SELECT CAST(k AS INTEGER) AS fold, round(arg_min(val_accuracy, val_loss), 6) AS accuracy FROM ("
                          + " UNION ALL ".join(f"SELECT k, val_loss, val_accuracy FROM s{t}" for t in range(1, CV_STEPS + 1)) + ") GROUP BY k",
                          FLOW_CLEAN_SQL + "," + UNDER_SQL + "," + focal_cv_sql()))
def q_cv_focal(spark, sf):
    """M9: five folds of the focal objective on a logistic model, each fold's accuracy at the best epoch."""
    d = S.stratified_folds(scaled_flows(spark, sf), "y", KEY, CV_FOLDS, seed=42)
    cv = N.cv_network(d, STEP_COLS, "y", KEY, "fold", CV_FOLDS, hidden=(), objective=FOCAL, epochs=CV_STEPS, rate=STEP_RATE)
    return cv.select("fold", r6("accuracy").alias("accuracy"))


# ---------------------------------------------------------------- M11 - M13


@query("graph_propagate_vectors", oracle(["nodes"], """
SELECT node_id, CAST(j AS INTEGER) AS j, round(x, 6) AS x FROM prop""", PATH_EDGES_SQL))
def q_graph_propagate_vectors(spark, sf):
    """M11 with a row per node: id neighbours in a chunk."""
    n = nodes_df(spark, sf)
    out = G.edge_propagation(n, path_edges(n))(n.select("node_id", F.col("features").cast("array<double>").alias("h")), G.vector_width(n))
    return out.select("node_id", F.posexplode("h").alias("j", "x")).select("node_id", "j", r6("x").alias("x"))


EDGE_FORWARD_SQL = """
el1 AS (SELECT prop.node_id, w.j, greatest(sum(prop.x * w.w) + max(b.w), 0) AS x FROM prop
        JOIN wt w ON w.layer = 1 AND w.i = prop.j JOIN wt b ON b.layer = 1 AND b.i = -1 AND b.j = w.j GROUP BY ALL),
ep AS (SELECT e2.dst AS node_id, el1.j, sum(el1.x / sqrt(ds.d * dd.d)) AS x FROM e2
       JOIN deg ds ON ds.n = e2.src JOIN deg dd ON dd.n = e2.dst JOIN el1 ON el1.node_id = e2.src GROUP BY ALL),
ez AS (SELECT ep.node_id, w.j, sum(ep.x * w.w) + max(b.w) AS x FROM ep
       JOIN wt w ON w.layer = 2 AND w.i = ep.j JOIN wt b ON b.layer = 2 AND b.i = -1 AND b.j = w.j GROUP BY ALL),
elp AS (SELECT node_id, j, x - max(x) OVER w - ln(sum(exp(x)) OVER w / exp(max(x) OVER w)) AS lp FROM ez WINDOW w AS (PARTITION BY node_id))"""


@query("graph_forward_edges", oracle(["nodes"], """
SELECT node_id, round(max(CASE WHEN j = 0 THEN lp END), 6) AS logp0, round(max(CASE WHEN j = 1 THEN lp END), 6) AS logp1,
       CAST(arg_max(j, lp) AS INTEGER) AS prediction FROM elp GROUP BY node_id""", PATH_EDGES_SQL + "," + WEIGHT_SQL + "," + EDGE_FORWARD_SQL))
def q_graph_forward_edges(spark, sf):
    """M12 over given edges."""
    n = nodes_df(spark, sf)
    out = G.gcn_forward(n, path_edges(n), gcn_weights(spark, G.vector_width(n)))
    return out.select("node_id", r6(F.col("logp")[0]).alias("logp0"), r6(F.col("logp")[1]).alias("logp1"), "prediction")


@query("node_history")
def q_node_history(spark, sf):
    """M13 + S15: epochs of the graph network over given edges, loss and accuracy on both masks."""
    n = S.chunk_masks(nodes_df(spark, sf), "chunk_id", ["node_id"], 0.8, seed=0)
    model = N.fit_nodes(n, G.edge_propagation(n, path_edges(n)), G.vector_width(n), epochs=8, rate=0.05)
    return N.history_table(spark, model.state)


@query("node_early_stop")
def q_node_early_stop(spark, sf):
    """M13 + W1: where the history of the graph network on complete chunks stops."""
    n = S.chunk_masks(nodes_df(spark, sf), "chunk_id", ["node_id"], 0.8, seed=0)
    model = N.fit_nodes(n, G.chunk_propagation(n), G.vector_width(n), epochs=8, rate=0.05, patience=3)
    return M.early_stop(N.history_table(spark, model.state), patience=3)
