import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark import fixtures as fx
from threatspark.operators import graph as G
from threatspark.plans.registry import gcn_weights
from conftest import SF001


def _small_nodes(spark, n=12, f=3, chunk=5):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, f))
    rows = [(i, i // chunk, [float(v) for v in x[i]], int(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "node_id long, chunk_id long, features array<double>, "
                                       "label int"), x


def test_propagation_on_complete_graph_is_chunk_mean(spark):
    nodes, x = _small_nodes(spark)
    # brute force: the explicit complete graph of each chunk (test fixture only)
    ids = nodes.select("node_id", "chunk_id")
    edges = ids.alias("a").join(ids.alias("b"), "chunk_id") \
               .where("a.node_id <> b.node_id") \
               .select(F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"))
    prop = G.gcn_propagate(G.to_long(nodes), edges)
    mean = G.chunk_mean(nodes)
    got = {(r[0], r[1]): r[2] for r in prop.collect()}
    chunk_of = {r[0]: r[1] for r in ids.collect()}
    means = {(r[0], r[1]): r[2] for r in mean.collect()}
    assert max(abs(v - means[(chunk_of[n], j)]) for (n, j), v in got.items()) < 1e-12


def test_propagation_matches_dense_formula(spark):
    nodes, x = _small_nodes(spark, n=6, f=2, chunk=6)
    e = [(0, 1), (1, 0), (1, 2), (2, 1), (3, 4), (5, 4)]
    edges = spark.createDataFrame(e, "src long, dst long")
    a = np.zeros((6, 6))
    for s, d in e:
        a[d, s] = 1.0
    a_hat = a + np.eye(6)
    deg = a_hat.sum(axis=1)
    dinv = np.diag(deg ** -0.5)
    exp = dinv @ a_hat @ dinv @ x
    got = G.gcn_propagate(G.to_long(nodes), edges).collect()
    for r in got:
        assert r["x"] == pytest.approx(exp[r["node_id"], r["j"]], abs=1e-12)


def test_complete_graph_counts(spark):
    nodes, _ = _small_nodes(spark)
    got = {r[0]: (r[1], r[2]) for r in G.complete_graph(nodes).collect()}
    assert got == {0: (5, 20), 1: (5, 20), 2: (2, 2)}


def test_forward_matches_numpy(spark):
    nodes = fx.nodes(spark, SF001)
    w = gcn_weights(spark, 64)
    out = {r["chunk_id"]: r for r in G.gcn_forward_complete(nodes, w).collect()}
    wrows = w.collect()
    W1 = np.zeros((64, 16)); b1 = np.zeros(16); W2 = np.zeros((16, 2)); b2 = np.zeros(2)
    for r in wrows:
        if r["layer"] == 1:
            (b1.__setitem__(r["j"], r["w"]) if r["i"] < 0 else W1.__setitem__((r["i"], r["j"]), r["w"]))
        else:
            (b2.__setitem__(r["j"], r["w"]) if r["i"] < 0 else W2.__setitem__((r["i"], r["j"]), r["w"]))
    rows = nodes.collect()
    for c in {r["chunk_id"] for r in rows}:
        x = np.array([r["features"] for r in rows if r["chunk_id"] == c], dtype=float)
        h = np.maximum(x.mean(axis=0) @ W1 + b1, 0)
        z = h @ W2 + b2
        lp = z - np.log(np.exp(z - z.max()).sum()) - z.max()
        assert out[c]["logp"] == pytest.approx(list(lp), abs=1e-9)
        assert out[c]["prediction"] == int(np.argmax(lp))


def test_build_graph(spark):
    df = spark.range(0, 23).select(F.col("id").alias("rid"), (F.col("id") * 0.5).alias("a"),
                                   (F.col("id") % 2).alias("Label"))
    g = G.build_graph(df, ["a"], "rid", "Label", chunk=10)
    assert g.select("chunk_id").distinct().count() == 3
    assert g.where("is_train").count() == 8 + 8 + 2
    assert dict(g.dtypes)["features"] == "array<float>"
