"""Embedding near-duplicates by iterative quantisation and multi-index tables (operator 3).

Vectors with equal labels and cosine of at least the threshold link. Equal (label, vector) rows are
one weighted member from the start. Codes of 64 bits under a learned rotation are the nodes of the
search: distinct (label, code). Two codes within Hamming radius ``RADIUS`` differ in at most 2 bits in one of
their four substrings; both sides put every substring into the tables with up to one
bit flipped, so such codes meet on an equal key.

How far apart the codes of a pair at the threshold lie depends on the data (a direction that all
vectors share costs angle once it is taken off). So rotations are learnt until ``CAUGHT`` of sampled pairs at the
very threshold lie within the radius under one of them at least (``pairs_at``); each has tables of its
own, and a pair counts under the first that catches it.

Code pairs within the radius are reranked by double-precision cosine over the original vectors, in packed
blocks of the codes' members: a code with many members is dealt into blocks, and a pair
of blocks returns link counts and its local components, never the pairs.

Defined results: vectors that are null, zero, of another dimension or with null or
non-finite components or an infinite square sum, and rows with a null label, link with nothing; every row
is a vector of its own, so repeated rows link with each other and each is returned;
a component's id is its smallest non-null vec_id; ties cannot arise; other
columns are ignored; an empty table gives no rows.

Joins of tables that grow with the rows are merge joins (``MERGE``): Spark judges a stored table by its compressed files, and neither
they nor a table before ``explode`` tell how large a broadcast of it would be on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import itq
from .common import MERGE, map_arrow, read_table, stored
from .graph import components

COSINE = 0.93
RADIUS = 11
CAUGHT = 0.997
MOST_ROTATIONS = 16
PAIRS = 4_000        # sampled pairs at the threshold
BLOCK_ROWS = 256
SALTS = 16           # pieces that the rows of one vector are dealt into when results are joined to them
FLIPS = [0, *(1 << b for b in range(itq.SUB_BITS))]


def pairs_at(x: np.ndarray, cosine: float, n: int = PAIRS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of unit vectors of this cosine: a sampled vector, and one turned from it in a random direction."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(0, len(x), n)]
    a = a / np.sqrt((a * a).sum(1))[:, None]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1)[:, None] * a
    norm = np.sqrt((side * side).sum(1))[:, None]
    side = np.where(norm > 1e-9, side / np.maximum(norm, 1e-9), 0)      # in one dimension there is none
    return a, cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * side


def rotations_for(x: np.ndarray, cosine: float, radius: int, caught: float = CAUGHT) -> list[itq.Rotation]:
    """Rotations until that share of pairs at the threshold lies within the radius under one of them."""
    a, b = pairs_at(x, cosine)
    missed, out = np.ones(len(a), bool), []
    while len(out) < MOST_ROTATIONS and (not out or missed.mean() > 1 - caught):
        out.append(itq.learn(x, len(out) + 1))
        missed &= np.bitwise_count(out[-1].codes(a) ^ out[-1].codes(b)) > radius
    return out


def _coded(rotations: list[itq.Rotation]):
    def run(batches):
        for b in batches:
            at, x = itq.vectors(b.column(2), rotations[0].dim)
            codes = np.stack([r.codes(x).view(np.int64) for r in rotations], 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(codes.tolist(), pa.list_(pa.int64())),
                 pa.array([v.tobytes() for v in x], pa.binary())], names=["uid", "label", "codes", "vec"])
    return run


def _local(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id that each row and column reaches through the links of the mask."""
    big = np.iinfo(np.int64).max
    while True:
        up = np.minimum(x, np.where(mask, y[None, :], big).min(1, initial=big))
        down = np.minimum(y, np.where(mask, up[:, None], big).min(0, initial=big))
        if (up == x).all() and (down == y).all():
            return up, down
        x, y = up, down


def _linked(dim: int, cosine: float, radius: int, turn: int):
    """Links of two blocks of members that no rotation before ``turn`` catches: (member, rows linked, root)."""
    def run(batches):
        for b in batches:
            uid, n, root = [], [], []
            for row in b.to_pylist():
                x, y = (np.frombuffer(b"".join(m["vec"] for m in row[c]), "<f8").reshape(-1, dim) for c in ("a", "b"))
                i, j = (np.array([m["uid"] for m in row[c]]) for c in ("a", "b"))
                wi, wj = (np.array([m["n"] for m in row[c]]) for c in ("a", "b"))
                norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
                mask = x @ y.T / norm >= cosine
                ci, cj = (np.array([m["codes"] for m in row[c]], np.int64).view(np.uint64) for c in ("a", "b"))
                for k in range(turn):
                    mask &= np.bitwise_count(ci[:, k, None] ^ cj[None, :, k]) > radius
                if row["same"]:
                    mask = np.triu(mask, 1)
                    mask = mask | mask.T
                up, down = _local(mask, i, j)
                sides = [(i, mask @ wj, up)] if row["same"] else [(i, mask @ wj, up), (j, mask.T @ wi, down)]
                for ids, count, low in sides:
                    some = count > 0
                    uid.append(ids[some])
                    n.append(count[some])
                    root.append(low[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in (uid, n, root)],
                names=["uid", "n", "root"])
    return run


def _met(members: DataFrame, turn: int, radius: int) -> DataFrame:
    """Pairs of blocks of members whose codes lie within the radius under a rotation, and blocks within themselves."""
    coded = members.withColumn("code", F.get("codes", F.lit(turn)))
    nodes = stored(coded.groupBy("label", "code").agg(F.count(F.lit(1)).alias("size")), "codes")
    keys = (nodes.select("label", "code", F.explode(F.array(*[F.lit(k) for k in range(itq.SUBSTRINGS)])).alias("k"))
            .select("label", "code", "k", F.explode(F.array(*[F.lit(f) for f in FLIPS])).alias("flip"))
            .withColumn("key", F.expr(f"(shiftright(code, k * {itq.SUB_BITS}) & {(1 << itq.SUB_BITS) - 1}) ^ flip"))
            .drop("flip"))
    a, b = keys.alias("a"), keys.alias("b")
    on = ((F.col("a.label") == F.col("b.label")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key"))
          & (F.col("a.code") < F.col("b.code"))
          & (F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= radius))
    pairs = (a.join(b.hint(MERGE), on).select("a.label", F.col("a.code").alias("a_code"), F.col("b.code").alias("b_code"))
             .distinct())
    alone = nodes.filter("size > 1").select("label", F.col("code").alias("a_code"), F.col("code").alias("b_code"))
    # codes of several blocks, a row for each BLOCK_ROWS rows at most; the others are one block
    large = nodes.filter(F.col("size") > BLOCK_ROWS)
    dealt = (coded.join(large, ["label", "code"], "left")
             .withColumn("block", F.coalesce(F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") / BLOCK_ROWS)), F.lit(0).cast("bigint")))
             .groupBy("label", "code", "block").agg(F.collect_list(F.struct("uid", "n", "codes", "vec")).alias("m")))
    dealt = stored(dealt, "members")
    left, right = (dealt.select("label", F.col("code").alias(f"{s}_code"), F.col("block").alias(f"{s}_block"), F.col("m").alias(s))
                   for s in "ab")
    return (pairs.union(alone).join(left, ["label", "a_code"]).join(right, ["label", "b_code"])
            .filter("a_code <> b_code or a_block <= b_block")
            .select("a", "b", F.expr("a_code = b_code and a_block = b_block").alias("same")))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, radius: int = RADIUS) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row."""
    if radius // itq.SUBSTRINGS > 2:
        raise ValueError("one flipped bit on either side reaches a radius of 11 at most")
    rows = stored(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"),
                            F.col(label_col).alias("label"))
                  .withColumn("uid", F.monotonically_increasing_id()), "vectors")
    sample = itq.sample_vectors(rows, "uid", "v")
    if not len(sample):
        return rows.select(F.col("vec_id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rotations = rotations_for(sample, cosine, radius)
    kind = rows.schema["label"].dataType.simpleString()
    coded = stored(map_arrow(rows.filter("label is not null").select("uid", "label", "v"), _coded(rotations),
                             f"uid bigint, label {kind}, codes array<bigint>, vec binary"), "coded")
    members = stored(coded.groupBy("label", "vec").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n"),
                                                       F.first("codes").alias("codes")), "members")
    found = None
    for turn in range(len(rotations)):
        new = map_arrow(_met(members, turn, radius), _linked(rotations[0].dim, cosine, radius, turn), "uid bigint, n bigint, root bigint")
        found = new if found is None else found.unionByName(new)
        found = stored(found.groupBy("uid", "root").agg(F.sum("n").alias("n")), "links")
    comp = stored(components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))), "comps")
    links = found.groupBy("uid").agg(F.sum("n").alias("others"))
    # rows find their member: copies by label and vector, in pieces, as a third of all rows may be one member; others are it
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    piece = F.pmod("uid", F.lit(SALTS).cast("bigint"))
    copies = members.filter("n > 1").select("label", "vec", F.col("uid").alias("member"), salts.alias("salt"))
    of_row = (coded.select("uid", "label", "vec", piece.alias("salt")).join(copies.hint(MERGE), ["label", "vec", "salt"], "left")
              .select("uid", F.coalesce("member", "uid").alias("member"),
                      F.when(F.col("member").isNull(), 0).otherwise(F.col("salt")).cast("bigint").alias("salt")))
    told = (members.select("uid", "n").join(comp.withColumnRenamed("node", "uid").hint(MERGE), "uid", "left")
            .join(links.hint(MERGE), "uid", "left")
            .select(F.col("uid").alias("member"), F.coalesce("comp", "uid").alias("comp"),
                    (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                    F.explode(F.expr(f"sequence(0L, if(n > 1, {SALTS - 1}L, 0L))")).alias("salt")))
    linked = of_row.join(told.hint(MERGE), ["member", "salt"]).select("uid", "comp", "n_links")
    of_row = stored(rows.select("uid", "vec_id").join(linked.hint(MERGE), "uid", "left"), "of_row")
    least = of_row.filter("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("low"))
    return (of_row.withColumn("salt", piece).join(least.withColumn("salt", salts).hint(MERGE), ["comp", "salt"], "left")
            .select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
