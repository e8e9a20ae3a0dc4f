"""Graph tables and graph propagation.

The reference links every pair of rows inside a chunk (a complete directed
graph, n(n-1) edges per chunk) and runs two graph-convolution layers on it.
With self loops every node of an n-node complete graph has degree n, so the
normalised propagation D^-1/2 (A+I) D^-1/2 H is exactly the chunk mean of H.
We therefore never materialise the pairs: the complete graph is kept
implicit (one row per chunk with its node and edge counts) and propagation
over it is one ``groupBy(chunk)``. Explicit sparse edge tables (any graph)
go through ``edge_propagation`` (whole vectors, hubs cut into pieces), or through
``gcn_propagate``, a join + aggregate in long form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import scratch_path
from .sampling import chunk_masks, with_chunk

# Fixed value: rows per graph chunk in the reference.
CHUNK_ROWS = 10_000


def to_long(nodes: DataFrame, node: str = "node_id", features: str = "features") -> DataFrame:
    """(node, array) -> long form (node, j, x), j 0-based."""
    return nodes.select(q(node), F.posexplode(q(features)).alias("j", "x")) \
                .withColumn("x", F.col("x").cast("double"))


def complete_graph(nodes: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """J3, implicit: per chunk the node count and the n(n-1) directed edges of
    its complete graph without self loops. Edges are counted, not emitted."""
    return nodes.groupBy(q(chunk)).agg(F.count(F.lit(1)).alias("n_nodes")) \
                .withColumn("n_edges", F.col("n_nodes") * (F.col("n_nodes") - 1))


def chunk_mean(nodes: DataFrame, chunk: str = "chunk_id", node: str = "node_id",
               features: str = "features") -> DataFrame:
    """Propagation over each chunk's complete graph with self loops, i.e.
    the chunk mean of every feature, in long form (chunk, j, mean)."""
    lng = nodes.select(q(chunk), F.posexplode(q(features)).alias("j", "x"))
    return lng.groupBy(q(chunk), "j").agg(F.avg(F.col("x").cast("double")).alias("h"))


def gcn_propagate(long_h: DataFrame, edges: DataFrame, node: str = "node_id",
                  src: str = "src", dst: str = "dst", value: str = "x") -> DataFrame:
    """H' = D^-1/2 (A + I) D^-1/2 H for an explicit edge list.

    ``long_h`` is (node, j, value); degrees count incoming edges plus the self
    loop; each edge carries weight 1/sqrt(d_src * d_dst); the result is
    (node, j, value) summed at the destination.
    """
    nodes = long_h.select(F.col(node).alias("_n")).distinct()
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")) \
             .unionByName(nodes.select(F.col("_n").alias("_s"), F.col("_n").alias("_d")))
    deg = e.groupBy("_d").agg(F.count(F.lit(1)).cast("double").alias("_deg"))
    w = (e.join(deg.select(F.col("_d").alias("_s"), F.col("_deg").alias("_ds")), "_s")
          .join(deg, "_d")
          .withColumn("_w", 1.0 / F.sqrt(F.col("_ds") * F.col("_deg"))))
    h = long_h.select(F.col(node).alias("_s"), "j", F.col(value).alias("_x"))
    return (w.join(h, "_s").groupBy(F.col("_d").alias(node), "j")
             .agg(F.sum(F.col("_w") * F.col("_x")).alias(value)))


#: A node with more outgoing edges is cut into pieces, each with a copy of its values.
HUB_EDGES = 100_000
MOST_HUBS = 1 << 17


def vector_width(nodes: DataFrame, features: str = "features") -> int:
    """The length that all vectors share; unequal or missing vectors are an error."""
    r = nodes.agg(F.min(F.size(q(features))).alias("a"), F.max(F.size(q(features))).alias("b"),
                  F.count_if(q(features).isNull()).alias("n")).first()
    if r.a != r.b or r.n:
        raise ValueError(f"vectors of {r.a} to {r.b} values, {r.n} missing")
    return r.a or 0


def edge_propagation(nodes: DataFrame, edges: DataFrame, node: str = "node_id", src: str = "src", dst: str = "dst",
                     back: bool = False, hub_edges: int = HUB_EDGES) -> Callable[[DataFrame, int], DataFrame]:
    """M11 for whole vectors: h -> A h with A = D^-1/2 (A + I) D^-1/2 of an edge list, one row per node.

    Degrees count incoming edges and the self loop; repeated edges count as often as they stand; edges
    from or to unknown nodes are left out. ``back`` gives the transpose. The weighted edges are
    stored once, the sums per destination are combined before the shuffle, and a node with more than ``hub_edges`` outgoing
    edges is cut into pieces by destination, so neither a hub's edges nor its row meet in one task.
    """
    ids = nodes.select(q(node).alias("k"))
    e = _stored(edges.select(q(src).alias("s"), q(dst).alias("d")).union(ids.select(F.col("k").alias("s"), F.col("k").alias("d"))), "edges")
    most = max(hub_edges, -(-e.count() // MOST_HUBS))

    def hubs(side: str) -> DataFrame:
        """Nodes with more than ``most`` edges on a side, at most MOST_HUBS of them, and their pieces."""
        n = e.groupBy(F.col(side).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        return F.broadcast(_stored(n.select("k", F.ceil(F.col("n") / most).alias("pieces")), "hubs"))

    def cut(rows: DataFrame, hub: DataFrame) -> DataFrame:
        """A row for every piece of its node k."""
        return (rows.join(hub, "k", "left")
                .withColumn("piece", F.explode(F.expr("sequence(0L, coalesce(pieces, 1L) - 1)"))).drop("pieces"))

    def joined(rows: DataFrame, side: str, values: DataFrame, hub: DataFrame, how: str = "inner") -> DataFrame:
        """Edges with what ``values`` (k, ...) says of their node on a side."""
        own = cut(values, hub).withColumnsRenamed({"k": side, "piece": f"{side}_piece"})
        return rows.join(own, [side, f"{side}_piece"], how)
    hub = {"s": hubs("s"), "d": hubs("d")}
    for side, other in ("sd", "ds"):
        piece = F.pmod(F.xxhash64(other), F.coalesce("pieces", F.lit(1)).cast("bigint"))
        e = e.join(hub[side].withColumnRenamed("k", side), side, "left").withColumn(f"{side}_piece", piece).drop("pieces")
    for side in "sd":
        e = joined(e, side, ids, hub[side], "left_semi")
    e = _stored(e, "edges")
    into = e.groupBy(F.col("d").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    for side in "sd":
        e = joined(e, side, into.withColumnRenamed("n", f"{side}_n"), hub[side])
    come, go = ("d", "s") if back else ("s", "d")
    e = _stored(e.select(F.col(come).alias("s"), F.col(f"{come}_piece").alias("s_piece"), F.col(go).alias("to"),
                         (1.0 / F.sqrt(F.col("s_n") * F.col("d_n"))).alias("w")), "weights")

    def run(h: DataFrame, width: int) -> DataFrame:
        name = h.columns[0]
        met = joined(e, "s", h.select(F.col(name).alias("k"), "h"), hub[come])
        sums = met.groupBy("to").agg(*[F.sum(F.col("w") * F.get("h", F.lit(k))).alias(f"h{k}") for k in range(width)])
        return sums.select(F.col("to").alias(name), F.array(*[F.col(f"h{k}") for k in range(width)]).alias("h"))
    return run


def chunk_propagation(nodes: DataFrame, chunk: str = "chunk_id", node: str = "node_id") -> Callable[[DataFrame, int], DataFrame]:
    """h -> A h on the complete graph of each chunk: the chunk's mean, for every node of it."""
    of = _stored(nodes.select(q(node).alias("n"), q(chunk).alias("c")), "chunks")

    def run(h: DataFrame, width: int) -> DataFrame:
        name = h.columns[0]
        d = h.select(F.col(name).alias("n"), "h").join(of, "n")
        mean = d.groupBy("c").agg(*[F.avg(F.get("h", F.lit(k))).alias(f"h{k}") for k in range(width)])
        mean = mean.select("c", F.array(*[F.col(f"h{k}") for k in range(width)]).alias("h"))
        return of.join(mean, "c").select(F.col("n").alias(name), "h")
    return run


def _matrix(weights: DataFrame, layer: int) -> tuple[list[list[float]], list[float]]:
    """(columns of a layer's weights, its offsets): inputs x units values."""
    rows = weights.where(F.col("layer") == layer).collect()
    units, inputs = 1 + max(r["j"] for r in rows), 1 + max(r["i"] for r in rows)
    w, b = [[0.0] * inputs for _ in range(units)], [0.0] * units
    for r in rows:
        if r["i"] < 0:
            b[r["j"]] = float(r["w"])
        else:
            w[r["j"]][r["i"]] = float(r["w"])
    return w, b


def dense_vectors(h: DataFrame, weights: DataFrame, layer: int) -> DataFrame:
    """(node, h array) through a linear layer."""
    w, b = _matrix(weights, layer)
    units = F.array(*[F.struct(F.array(*[F.lit(v) for v in c]).alias("w"), F.lit(o).alias("b")) for c, o in zip(w, b, strict=True)])

    def unit(u):
        return F.aggregate(F.zip_with("h", u["w"], lambda x, y: x * y), u["b"], lambda a, x: a + x)
    return h.withColumn("h", F.transform(units, unit))


def gcn_forward(nodes: DataFrame, edges: DataFrame, weights: DataFrame, node: str = "node_id", features: str = "features",
                propagate: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """M12 over given edges: (node, logp array, prediction), the vector width taken from the data."""
    width = vector_width(nodes, features)
    propagate = propagate or edge_propagation(nodes, edges, node)
    h = nodes.select(q(node).alias(node), q(features).cast("array<double>").alias("h"))
    h = dense_vectors(propagate(h, width), weights, 1).withColumn("h", F.transform("h", lambda x: F.greatest(x, F.lit(0.0))))
    hidden = len(_matrix(weights, 1)[1])
    z = dense_vectors(propagate(h, hidden), weights, 2)
    z = z.withColumn("_m", F.array_max("h")).withColumn("h", F.transform("h", lambda x: x - F.col("_m")))
    total = F.log(F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp(x)))
    z = z.withColumn("_t", total).withColumn("logp", F.transform("h", lambda x: x - F.col("_t")))
    return z.select(node, "logp", (F.array_position("logp", F.array_max("logp")) - 1).cast("int").alias("prediction"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense(long_h: DataFrame, weights: DataFrame, bias: DataFrame, key: str = "node_id",
          value: str = "x") -> DataFrame:
    """Linear layer in long form: out[key, j] = sum_i h[key, i] * W[i, j] + b[j].
    ``weights`` (i, j, w) and ``bias`` (j, b) are small (inputs x units), so
    the join against them is broadcast."""
    wt = weights.select(F.col("i").alias("j"), F.col("j").alias("_o"), "w")
    prod = long_h.join(F.broadcast(wt), "j") \
                 .groupBy(q(key), F.col("_o").alias("j")) \
                 .agg(F.sum(F.col(value) * F.col("w")).alias("_z"))
    return prod.join(F.broadcast(bias), "j").select(q(key), "j",
                                                    (F.col("_z") + F.col("b")).alias(value))


def gcn_forward_complete(nodes: DataFrame, weights: DataFrame, chunk: str = "chunk_id",
                         node: str = "node_id", features: str = "features") -> DataFrame:
    """M12 on the implicit complete graph of each chunk.

    Layer 1: propagate (chunk mean), linear W1 b1, ReLU. Layer 2: propagate
    (a no-op: after layer 1 all nodes of a chunk are equal), linear W2 b2,
    log-softmax. ``weights`` is (layer, i, j, w); bias rows have i = -1.
    Output per chunk: (chunk, logp array, prediction); every node of the chunk
    shares it.
    """
    w1 = weights.where("layer = 1 AND i >= 0").select("i", "j", "w")
    b1 = weights.where("layer = 1 AND i < 0").select("j", F.col("w").alias("b"))
    w2 = weights.where("layer = 2 AND i >= 0").select("i", "j", "w")
    b2 = weights.where("layer = 2 AND i < 0").select("j", F.col("w").alias("b"))
    h0 = chunk_mean(nodes, chunk, node, features).withColumnRenamed("h", "x")
    h1 = dense(h0, w1, b1, key=chunk).withColumn("x", F.greatest(F.col("x"), F.lit(0.0)))
    z = dense(h1, w2, b2, key=chunk)
    return log_softmax(z, key=chunk)


def log_softmax(z: DataFrame, key: str = "node_id", value: str = "x") -> DataFrame:
    """Per key: logp = z - log(sum(exp(z))) (max-shifted), argmax prediction."""
    w = Window.partitionBy(key)
    m = F.max(value).over(w)
    s = z.withColumn("_m", m).withColumn("_e", F.exp(F.col(value) - F.col("_m")))
    s = s.withColumn("lp", F.col(value) - F.col("_m") - F.log(F.sum("_e").over(w)))
    return s.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "lp"))), lambda t: t["lp"])
         .alias("logp"),
        F.max_by("j", "lp").cast("int").alias("prediction"))


def build_graph(df: DataFrame, features: Sequence[str], row_id: str, label: str = "Label",
                chunk: int = CHUNK_ROWS, frac: float = 0.8, seed=0) -> DataFrame:
    """Node table from a feature table: project the selected features into
    an array, chunk consecutive rows, draw per-chunk train/validation masks.
    The edges of each chunk's complete graph stay implicit (``complete_graph``)."""
    nodes = df.select(q(row_id).alias("node_id"),
                      F.array(*[q(c).cast("float") for c in features]).alias("features"),
                      q(label).cast("bigint").alias("label"))
    nodes = with_chunk(nodes, "node_id", chunk)
    return chunk_masks(nodes, "chunk_id", ["node_id"], frac, seed)
