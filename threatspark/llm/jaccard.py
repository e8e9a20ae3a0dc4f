"""Exact n-gram Jaccard join by vertical partitioning (operator 10).

A document's set holds the 64-bit hashes of its distinct word shingles. One
global order of all shingles, (frequency level, hash), is cut into fragments:

* its head: documents that reach the threshold share a shingle within the
  rarest ``n - ceil(t n) + 1`` shingles of each (prefix filtering), so
  candidates meet on those; the level comes from a count sketch over all
  documents and pushes common passages out of the head. Any fixed order gives
  the same links; the sketch only decides how many candidates there are.
* fragments by hash range: for candidate pairs the overlap is counted in every
  fragment by itself and the partial counts are summed per pair.

Equal sets are one node from the start. Candidates first pair each node with
the least node of a bucket (a star: linear in the bucket), are verified and
joined into components; then all remaining pairs of a bucket that lie in
different components follow, so no link between components is lost and pairs
inside one are never listed. Within the joins, sizes, the places of the shared shingle in both
orders and parity bitmaps of both sets rule pairs out: the bitmaps' Hamming distance
never exceeds the symmetric difference.

Defined results: null or empty text, or white space only: empty set, linked
with nothing, component_id the own id; fewer words than a shingle: the whole
sequence is the one shingle; repeated rows and copies are one node; a repeated id
with different texts is two nodes; null ids take part, and a component's id is its
smallest non-null id (null if there is none); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import blocks
from .common import map_arrow, read_table, stored, sub_batches, texts
from .graph import components

WORDS, PERCENT = 5, 80
FRAGMENTS = 8
PARITY_BITS = 1024
LEAST_SKETCH, MOST_SKETCH = 20, 24   # log2 of the cells of the count sketch
BYTES_PER_CELL = 200

def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    from xxhash import xxh3_64_intdigest
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, own), np.uint64, len(own))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * blocks.ODD + w[i:len(w) - size + 1 + i]
    return np.unique(blocks.mixed(h))


def _signature(own: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest
    return int(np.uint64(xxh3_64_intdigest(own.tobytes())).view(np.int64))


def _sketch_rows(text_col: str, words: int, bits: int):
    def run(batches):
        cells = np.zeros(1 << bits, np.uint32)
        mask = np.uint64((1 << bits) - 1)
        for whole in batches:
            for batch in sub_batches(whole, text_col):
                sets = [shingles(t, words) for t in texts(batch, text_col)]
                at = (np.concatenate(sets) & mask).astype(np.int64) if sets else []
                np.add.at(cells, at, 1) if len(at) < 1000 else cells.__iadd__(
                    np.bincount(at, minlength=1 << bits).astype(np.uint32))
        yield from blocks.emitted(cells)
    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _parity(own: np.ndarray) -> np.ndarray:
    bit = (own >> np.uint64(20)).astype(np.int64) % PARITY_BITS
    odd = (np.bincount(bit, minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _head_rows(text_col: str, words: int, percent: int, bits: int, level):
    """Node of every row; of each node's first row in a task also parity bitmap and head."""
    def run(batches):
        mask = np.uint64((1 << bits) - 1)
        order = level.value
        seen: set[int] = set()
        for whole in batches:
            for batch in sub_batches(whole, text_col):
                n, node, parity, head = [], [], [], []
                for t in texts(batch, text_col):
                    own = shingles(t, words)
                    n.append(len(own))
                    node.append(_signature(own) if len(own) else None)
                    if not len(own) or node[-1] in seen:
                        parity.append(None)
                        head.append(None)
                        continue
                    seen.add(node[-1])
                    size = len(own) - (percent * len(own) + 99) // 100 + 1
                    lv = order[(own & mask).astype(np.int64)]
                    at = np.argsort(lv, kind="stable")[:size]
                    parity.append(_parity(own))
                    head.append(own[at].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(parity, pa.list_(pa.int64())), pa.array(head, pa.list_(pa.int64()))],
                    names=["id", "row_key", "n", "node", "parity", "head"])
    return run


def _segment_rows(words: int, wanted):
    def run(batches):
        bits = wanted.value
        seen: set[int] = set()
        for whole in batches:
            keys = whole.column(0).to_numpy(zero_copy_only=False)
            whole = whole.filter(pa.array(blocks.in_bloom(bits, keys)))
            for batch in sub_batches(whole, "text"):
                node, frag, toks = [], [], []
                for t in texts(batch, "text"):
                    own = shingles(t, words)
                    sig = _signature(own)
                    if not len(own) or sig in seen:
                        continue
                    seen.add(sig)
                    cut = np.searchsorted(own >> np.uint64(61), np.arange(FRAGMENTS + 1, dtype=np.uint64))
                    for f in range(FRAGMENTS):
                        part = own[cut[f]:cut[f + 1]]
                        if len(part):
                            node.append(sig)
                            frag.append(f)
                            toks.append(part.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(frag, pa.int32()), pa.array(toks, pa.binary())],
                    names=["node", "frag", "toks"])
    return run


def _overlaps(batches):
    for b in batches:
        x, y = (texts(b, c) for c in ("toks_a", "toks_b"))
        n = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
             for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["a", "b", "c"])


def _may_reach(percent: int, a: str, b: str):
    """Condition on two sides' n and parity: their sets can reach the threshold."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}parity")[k].bitwiseXOR(F.col(f"{b}parity")[k]))
                 for k in range(PARITY_BITS // 64)), F.lit(0))
    # the overlap is at most half of what the sizes leave after the known differences
    most = F.shiftright(na + nb - apart, 1)
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & (100 * most >= percent * (na + nb - most)))


def _first_may_reach(percent: int, a: str, b: str):
    """Condition on two sides that share the token at places ``at`` of the global order, as their first one:
    what follows it on either side is enough. A pair that reaches the threshold passes at its first common token.
    """
    most = F.least(F.col(f"{a}n") - F.col(f"{a}at"), F.col(f"{b}n") - F.col(f"{b}at"))
    return (100 + percent) * most >= percent * (F.col(f"{a}n") + F.col(f"{b}n"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by partial overlaps per fragment."""
    spark = pairs.sparkSession
    na = nodes.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("parity").alias("a_parity"))
    nb = nodes.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("parity").alias("b_parity"))
    near = pairs.join(na, "a").join(nb, "b").filter(_may_reach(percent, "a_", "b_"))
    near = stored(near.select("a", "b", F.col("a_n").alias("na"), F.col("b_n").alias("nb")), "pairs")
    ends = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    wanted = spark.sparkContext.broadcast(blocks.bloom(ends.join(nodes, "node").select("row_key")))
    seg = map_arrow(docs.select("row_key", "text"), _segment_rows(words, wanted),
                    "node bigint, frag int, toks binary")
    seg = seg.join(ends, "node", "left_semi").dropDuplicates(["node", "frag"])
    sa = seg.select(F.col("node").alias("a"), "frag", F.col("toks").alias("toks_a"))
    sb = seg.select(F.col("node").alias("b"), "frag", F.col("toks").alias("toks_b"))
    met = near.select("a", "b").join(sa, "a").join(sb, ["b", "frag"]).select("a", "b", "toks_a", "toks_b")
    part = map_arrow(met, _overlaps, "a bigint, b bigint, c bigint")
    total = part.groupBy("a", "b").agg(F.sum("c").alias("c")).join(near, ["a", "b"])
    links = stored(total.filter(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c")))
                   .select("a", "b"), "links")
    wanted.destroy()        # else every worker keeps it
    return links


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT, with_keys: bool = False) -> DataFrame:
    """(id, n_shingles, component_id), one row per input row.

    ``with_keys`` adds row_key, xxhash64 of id and text, and group, one number per
    component (null for empty sets).
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn(
        "row_key", F.xxhash64("id", "text"))
    size = df.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, (size // BYTES_PER_CELL).bit_length()))
    level = blocks.added(map_arrow(docs.select("text"), _sketch_rows("text", words, bits), blocks.SCHEMA),
                         1 << bits, np.uint32, finish=_levels)
    level = spark.sparkContext.broadcast(level)
    id_type = docs.schema["id"].dataType.simpleString()
    rows = stored(map_arrow(docs.select("id", "row_key", "text"), _head_rows("text", words, percent, bits, level),
                            f"id {id_type}, row_key bigint, n bigint, node bigint, parity array<bigint>, head array<bigint>"),
                  "heads")
    level.destroy()         # else every worker keeps it
    # without a head the row repeats a node of its task
    nodes = stored(rows.filter("head is not null").select("node", "n", "parity", "row_key")
                   .dropDuplicates(["node"]), "nodes")
    met = rows.filter("head is not null").select("node", F.posexplode("head").alias("at", "token"))
    own = W.partitionBy("token")
    shared = stored(met.withColumn("least", F.min("node").over(own)).withColumn("most", F.max("node").over(own))
                    .filter("least <> most").select("token", "node", "at", "least").distinct(), "shared")
    stars = shared.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = _verified(stars, nodes, docs, words, percent)
    comp = stored(components(links), "comps")
    # what is left: pairs of one bucket in different components
    labelled = (shared.join(comp, "node", "left").join(nodes.select("node", "n", "parity"), "node")
                .select("token", "node", "at", "n", "parity", F.coalesce("comp", "node").alias("comp"))
                .withColumn("lo", F.min("comp").over(own)).withColumn("hi", F.max("comp").over(own))
                .filter("lo <> hi").drop("lo", "hi"))
    labelled = stored(labelled, "mixed")
    x, y = labelled.alias("x"), labelled.alias("y")
    rest = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp"))
                   & _first_may_reach(percent, "x.", "y.") & _may_reach(percent, "x.", "y."))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    more = _verified(rest.join(stars, ["a", "b"], "left_anti"), nodes, docs, words, percent)
    if not more.isEmpty():
        comp = stored(components(links.union(more)), "comps")
    # the smallest id of each component; grouped minima, combined before the shuffle
    of_node = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("low"))
    of_node = of_node.join(comp, "node", "left").select("node", "low", F.coalesce("comp", "node").alias("comp"))
    of_node = stored(of_node, "of_node")
    of_comp = of_node.groupBy("comp").agg(F.min("low").alias("component_id"))
    label = of_node.join(of_comp, "comp").select("node", "component_id", F.col("comp").alias("group"))
    out = (rows.select("id", "n", "node", "row_key").join(label, "node", "left")
           .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                   F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
                   .alias("component_id"), "row_key", "group"))
    return out if with_keys else out.drop("row_key", "group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
