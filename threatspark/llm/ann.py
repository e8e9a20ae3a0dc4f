"""Approximate nearest neighbours by multi-index hashing (operator 1).

Vectors become 64-bit codes under a learned rotation. A block of the index
holds up to ``BLOCK_ROWS`` vectors with one table per code substring: rows sorted
by the substring's value. A code within Hamming radius r of the query agrees
with it up to floor(r / substrings) bits in at least one substring (pigeonhole),
so every table's values within that distance are probed; what is found is
filtered by the whole code's radius and reranked by cosine on the original
vectors. The radius is learned: it covers ``COVER`` of the true neighbours of
sample vectors within the sample, whose neighbours are farther than those in
the whole table. A block with fewer than k rows in the radius offers all its rows,
so k neighbours come back whenever there are that many.

The stated query set meets all rows in blocks: packed query blocks by packed
index blocks, k rows of each query leaving each pair.

Defined results: vectors that are null, zero, of another dimension or with null or
non-finite components, and rows with a null id, take no part; a query never
meets rows of its own id; repeated rows are candidates each; query rows that repeat an
id are one query (their first vector in array order); ties go to the smaller id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import itq
from .common import map_arrow, read_table, stored

K = 5
BLOCK_ROWS = 4096
QUERY_ROWS = 512
COVER = 0.985
PACKED = "n bigint, ids binary, vecs binary, codes binary"


def learned_radius(rotation: itq.Rotation, sample: np.ndarray, k: int, cover: float = COVER, probes: int = 400) -> int:
    unit = sample / np.sqrt((sample * sample).sum(1))[:, None]
    codes = rotation.codes(sample)
    apart = []
    for i in range(min(probes, len(sample))):
        cos = unit @ unit[i]
        cos[i] = -2
        near = np.argsort(-cos)[:min(k, len(sample) - 1)]
        apart.append(np.bitwise_count(codes[near] ^ codes[i]))
    apart = np.concatenate(apart) if apart else np.zeros(0)
    return int(np.quantile(apart, cover)) + 1 if len(apart) else itq.BITS


def _packed(rotation: itq.Rotation, rows: int):
    def run(batches):
        ids, vecs = [], []

        def block(n):
            nonlocal ids, vecs
            i, x = np.concatenate(ids), np.vstack(vecs)
            ids, vecs = [i[n:]], [x[n:]]
            i, x = i[:n], x[:n]
            return pa.RecordBatch.from_pydict({
                "n": pa.array([len(i)], pa.int64()), "ids": [i.astype("<i8").tobytes()],
                "vecs": [x.astype("<f8").tobytes()], "codes": [rotation.codes(x).astype("<u8").tobytes()]})
        held = 0
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column(0)))
            at, x = itq.vectors(b.column(1), rotation.dim)
            if not len(at):
                continue
            ids.append(b.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64))
            vecs.append(x)
            held += len(at)
            while held >= rows:
                yield block(rows)
                held -= rows
        if held:
            yield block(held)
    return run


class BlockIndex:
    """Multi-index tables over the codes of one block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.tables = codes, []
        for values in itq.substrings(codes):
            order = np.argsort(values, kind="stable")
            keys, n = np.unique(values[order], return_counts=True)
            self.tables.append((order, keys, n))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes lie within the radius."""
        each = radius // itq.SUBSTRINGS
        found = np.zeros(len(self.codes), bool)
        for part, (order, keys, n) in zip(itq.substrings(np.array([code]))[:, 0], self.tables, strict=True):
            found[order[np.repeat(np.bitwise_count(keys ^ part) <= each, n)]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _search(dim: int, radius: int, k: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                qid, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q, x = (np.frombuffer(row[c], "<f8").reshape(-1, dim) for c in ("q_vecs", "vecs"))
                q_codes, index = np.frombuffer(row["q_codes"], "<u8"), BlockIndex(np.frombuffer(row["codes"], "<u8"))
                q_norm, norm = (np.sqrt((v * v).sum(1)) for v in (q, x))
                out = []
                for i in range(len(q)):
                    rows = index.within(q_codes[i], radius)
                    rows = rows[ids[rows] != qid[i]]
                    if len(rows) < k:
                        rows = np.flatnonzero(ids != qid[i])
                    cos = (x[rows] * q[i]).sum(1) / (norm[rows] * q_norm[i])
                    best = np.lexsort((ids[rows], -cos))[:k]
                    out.append((np.full(len(best), qid[i]), ids[rows][best], cos[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 names=["query_id", "vec_id", "score"])
    return run


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
           radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found in ``df`` of every row of ``queries``."""
    spark = df.sparkSession
    rotation, sample = itq.fit(df, id_col, vec_col)
    if rotation is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    radius = learned_radius(rotation, sample, k) if radius is None else radius
    pair = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")]
    index = stored(map_arrow(df.select(*pair), _packed(rotation, BLOCK_ROWS), PACKED), "index")
    one = queries.select(*pair).groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(map_arrow(one, _packed(rotation, QUERY_ROWS), PACKED), "queries")
    both = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "vecs", "codes")]).crossJoin(
        index.select("ids", "vecs", "codes"))
    near = map_arrow(both, _search(rotation.dim, radius, k), "query_id bigint, vec_id bigint, score double")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return search(df, df.filter(F.col("vec_id") % 50 == 0))
