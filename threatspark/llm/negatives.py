"""Hard-negative mining over an inverted multi-index (operator 12).

Vectors become integers; scores are exact integer inner products. The two halves of a vector
have a codebook each, fitted on a bounded sample (``SAMPLE`` rows of least hash); a cell is a pair
of entries, and every row lies in one. An entry's radius is the largest distance of any row's
half from it, over all rows. By Cauchy's inequality no row of cell (i, j) scores above
u_i + w_j, where u_i = <half, entry i> + |half| * radius i. A heap visits an anchor's cells
by falling sums (multi-sequence). Once as many rows as wanted are known and the next sum is below the
last of them, no unvisited cell can hold a better one: the window is certified.

Two searches use it. The first finds each anchor's nearest rows of its own label. Their scores
fix the score windows of the second, which takes the best rows of other labels in each window;
it also passes over cells whose lower bound lies above all windows. Anchors visit cells in rounds of
growing length; certified anchors leave. Where vectors lie evenly, bounds are loose and most cells
are visited: the stated anchors then meet all rows in blocks, and results stay exact.

Equal (label, vector) rows are one entry of the index with as many of their smallest ids as any
result can hold, cut before the shuffle, and equal anchors are searched once: a vector in a third of the rows
is one row of the search. Cells are cut into blocks and anchors into chunks of bounded size.

Defined results: rows with a null id, a null label, a null or empty vector, one of another length than the
most frequent one, or null or non-finite components take no part; zero vectors do. Every row
is its own: a repeated anchor row returns its results again, and rows that repeat it are other
rows. Ties go to the smaller id, among equal ids any. A window below zero is empty. Labels other than
integers and (label, vector) pairs are compared by 64-bit hashes. Integers beyond ``ints.limit`` are cut to it.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MERGE, drop_path, map_arrow, read_table, stored, stored_at
from .ints import dimension, integers, products

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95           # percent of the positive's score
SAMPLE = 20_000
MOST_ENTRIES = 256
FIT_ROUNDS = 10
BLOCK_ROWS = 1_024
CHUNK_ROWS = 128
#: Cells of the first round, and how much longer each next one is.
FIRST_CELLS = 16
GROWTH = 8
#: Pieces that the rows of one anchor vector are dealt into when results are joined to them.
SALTS = 16
NO_WINDOW = {"low": 2**63 - 1, "high": -2**63}
EDGES = "array<struct<low:bigint,high:bigint>>"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _as_integers(dim: int, scale: int):
    def run(batches):
        for b in batches:
            at, x = integers(b.column(2), dim, scale)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(pa.array(at)) for k in (0, 1)), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary()),
                 pa.array((x * x).sum(1))], names=["vec_id", "lab", "vec", "own_score"])
    return run


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<i4").reshape(-1, dim).astype(np.int64)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None, :], 0)


def fit(x: np.ndarray, entries: int, seed: int = 1) -> list[np.ndarray]:
    """A codebook per half by Lloyd rounds over the sample."""
    out = []
    for h in halves(x.astype(float)):
        rng = np.random.default_rng(seed)
        book = h[rng.permutation(len(h))[:entries]]
        for _ in range(FIT_ROUNDS):
            at = _squares(h, book).argmin(1)
            n = np.bincount(at, minlength=len(book))
            sums = np.stack([np.bincount(at, h[:, d], len(book)) for d in range(h.shape[1])], 1) if h.shape[1] else book
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        out.append(book)
    return out


def _celled(books: list[np.ndarray], dim: int):
    def run(batches):
        for b in batches:
            x = _matrix(b.column("vec").to_pylist(), dim).astype(float)
            cols = {}
            for name, h, book in zip("ij", halves(x), books, strict=True):
                d = _squares(h, book)
                at = d.argmin(1)
                cols[name] = pa.array(at.astype(np.int32))
                far = np.sqrt(((h - book[at]) ** 2).sum(1))     # the distance itself, without cancellation
                cols[f"far_{name}"] = pa.array(far)
            yield pa.RecordBatch.from_arrays([*b.columns, *cols.values()], names=[*b.schema.names, *cols])
    return run


class Bounds:
    """Half-score bounds of one anchor over the entries of both codebooks."""

    def __init__(self, x: np.ndarray, books: list[np.ndarray], radii: list[np.ndarray]):
        self.high, self.low, self.order = [], [], []
        for h, book, r in zip(halves(x[None, :].astype(float)), books, radii, strict=True):
            mid, off = (book @ h[0]), np.sqrt((h[0] * h[0]).sum()) * r
            slack = 1e-9 * (np.abs(mid) + off) + 1e-6                # rounding of the bound itself
            known = r >= 0
            self.high.append(np.where(known, mid + off + slack, -np.inf))
            self.low.append(np.where(known, mid - off - slack, np.inf))
            self.order.append(np.argsort(-self.high[-1], kind="stable")[:int(known.sum())])

    def cells(self):
        """(i, j, upper bound, lower bound) by falling upper bound."""
        a, b = self.order
        if not len(a) or not len(b):
            return
        ha, hb, la, lb = *self.high, *self.low
        heap = [(-(ha[a[0]] + hb[b[0]]), 0, 0)]
        while heap:
            bound, p, q = heapq.heappop(heap)
            i, j = int(a[p]), int(b[q])
            yield i, j, -bound, la[i] + lb[j]
            # (p, q + 1) only follows (p, q); (p + 1, 0) follows (p, 0): each pair enters once
            if q + 1 < len(b):
                heapq.heappush(heap, (-(ha[i] + hb[b[q + 1]]), p, q + 1))
            if q == 0 and p + 1 < len(a):
                heapq.heappush(heap, (-(ha[a[p + 1]] + hb[b[0]]), p + 1, 0))


def _visits(books, radii, there: np.ndarray, dim: int, start: int, stop: int):
    """Each anchor's cells from ``start`` to ``stop`` of its sequence, while a window is not certified.

    ``least``: no result is below it (the last of the known ones, or the window's lower end); ``most``: none is above.
    """
    def run(batches):
        for b in batches:
            x = _matrix(b.column("vec").to_pylist(), dim)
            least, most = b.column("least").to_pylist(), b.column("most").to_pylist()
            src, ci, cj = [], [], []
            for r in range(len(x)):
                k = -1
                for i, j, high, low in Bounds(x[r], books, radii).cells():
                    k += there[i, j]
                    if k >= stop or least[r] is not None and high < least[r]:
                        break
                    if k >= start and there[i, j] and (most[r] is None or low <= most[r]):
                        src.append(r)
                        ci.append(i)
                        cj.append(j)
            got = b.take(pa.array(src, pa.int64())) if len(src) else b.slice(0, 0)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(ci, pa.int32()), pa.array(cj, pa.int32())],
                                             names=[*got.schema.names, "i", "j"])
    return run


def _best(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of each anchor's ``keep`` first by (score descending, id)."""
    by = np.lexsort((ids, -score, anchor))
    a = anchor[by]
    first = np.searchsorted(a, a, side="left")
    return by[np.arange(len(a)) - first < keep]


def _index_kind(dim: int, keep: int) -> np.dtype:
    return np.dtype([("lab", "<i8"), ("n", "<i8"), ("ids", "<i8", (keep,)), ("vec", "<i4", (dim,))])


def _packed(kind: np.dtype):
    """Index rows as fixed-length records."""
    def run(batches):
        for b in batches:
            rec = np.zeros(b.num_rows, kind)
            rec["lab"] = b.column("lab").to_numpy(zero_copy_only=False)
            rec["vec"] = _matrix(b.column("vec").to_pylist(), kind["vec"].shape[0])
            for r, ids in enumerate(b.column("ids").to_pylist()):
                rec["n"][r] = len(ids)
                rec["ids"][r, :len(ids)] = ids
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("j"), pa.array([v.tobytes() for v in rec], pa.binary())],
                                             names=["i", "j", "rec"])
    return run


def _expanded(rows: np.ndarray, anchor: np.ndarray, at: np.ndarray, score: np.ndarray, keep: int):
    """(anchor, score, id) of the hits, one for each id of a hit's vector."""
    n = np.minimum(rows["n"][at], keep)
    rep = np.repeat(np.arange(len(at)), n)
    slot = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
    return anchor[rep], score[rep], rows["ids"][at[rep], slot]


def _met(dim: int, ids_kept: int, keep: int, windows: bool):
    """Scores of a chunk of anchors against a block of a cell; the ``keep`` best of each anchor or window."""
    kind = _index_kind(dim, ids_kept)

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for row in b.to_pylist():
                rows, asked = np.frombuffer(b"".join(row["recs"]), kind), row["anchors"]
                aid, lab = (np.array([a[c] for a in asked], np.int64) for c in ("aid", "lab"))
                s = products(_matrix([a["vec"] for a in asked], dim), rows["vec"].astype(np.int64))
                same = lab[:, None] == rows["lab"][None, :]
                for w in range(max(len(a["edges"]) for a in asked) if windows else 1):
                    if windows:
                        edges = [a["edges"][w] if w < len(a["edges"]) else NO_WINDOW for a in asked]
                        low, high = (np.array([e[c] for e in edges], np.int64)[:, None] for c in ("low", "high"))
                        mask = ~same & (s >= low) & (s <= high)
                    else:
                        least = np.array([NO_WINDOW["high"] if a["least"] is None else a["least"] for a in asked], np.int64)
                        mask = same & (s >= least[:, None])
                    anchor, at = np.nonzero(mask)
                    if len(at):
                        a, score, ids = _expanded(rows, anchor, at, s[anchor, at], keep)
                        first = _best(a, score, ids, keep)
                        for part, v in zip(out, (aid[a[first]], np.full(len(first), w), score[first], ids[first]), strict=True):
                            part.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in out],
                                             names=["aid", "w", "score", "vec_id"])
    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


class MultiIndex:
    """The rows of a table in cells, and searches over it."""

    def __init__(self, rows: DataFrame, dim: int, keep: int, entries: int | None = None):
        """``rows``: (vec_id, lab, vec); ``keep``: the most ids that a result can take from equal rows."""
        self.spark, self.dim, self.keep = rows.sparkSession, dim, keep
        w = Window.partitionBy("lab", "vec").orderBy("vec_id")
        distinct = stored(rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
                          .groupBy("lab", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
        self.entries = entries or max(4, min(MOST_ENTRIES, round(distinct.count() ** 0.25)))
        sample = (distinct.select("vec", F.xxhash64("vec", "lab").alias("_o")).orderBy("_o", "vec").limit(SAMPLE)
                  .select("vec").toArrow())
        self.books = fit(_matrix(sample.column(0).to_pylist(), dim), self.entries)
        celled = stored(map_arrow(distinct, _celled(self.books, dim),
                                  f"{_ddl(distinct)}, i int, far_i double, j int, far_j double"), "cells")
        self.radii = []
        for name, book in zip("ij", self.books, strict=True):
            r = np.full(len(book), -1.0)
            for got in celled.groupBy(name).agg(F.max(f"far_{name}").alias("r")).collect():     # one row per entry
                r[got[name]] = got.r * (1 + 1e-9)
            self.radii.append(r)
        sizes = celled.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
        records = map_arrow(celled.select("lab", "vec", "ids", "i", "j"), _packed(_index_kind(dim, keep)), "i int, j int, rec binary")
        self.blocks = stored(records.join(sizes, ["i", "j"])
                             .withColumn("block", F.pmod(F.xxhash64("rec"), F.col("blocks")))
                             .groupBy("i", "j", "block").agg(F.collect_list("rec").alias("recs")), "blocks")
        self.there = np.zeros((self.entries, self.entries), bool)
        for cell in sizes.collect():        # at most entries x entries rows
            self.there[cell.i, cell.j] = True
        #: Filled cells visited by each search, and what visiting all of them would take.
        self.visited: list[tuple[int, int]] = []

    def search(self, anchors: DataFrame, keep: int, windows: bool) -> DataFrame:
        """(aid, w, score, vec_id): the ``keep`` best rows of each anchor's label, or of other labels in each window w.

        ``anchors``: (aid, lab, vec, edges); ``edges`` holds the windows, null without them.
        """
        n = anchors.count()
        kind = "aid bigint, w bigint, score bigint, vec_id bigint"
        anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64("aid"), F.lit(max(1, -(-n // CHUNK_ROWS)))))
        most = F.array_max(F.transform("edges", lambda e: e["high"])) if windows else F.lit(None).cast("bigint")
        best = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "vec_id")
        found, found_at = self.spark.createDataFrame([], kind), None
        start, step, visited = 0, FIRST_CELLS, 0
        cells = int(self.there.sum())
        while n and start < cells:
            known = (found.groupBy("aid", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
                     .filter(F.col("n") >= keep).groupBy("aid")
                     .agg(F.map_from_entries(F.collect_list(F.struct("w", "last"))).alias("known")))
            state = anchors.join(known.hint(MERGE), "aid", "left")
            if windows:
                least = F.array_min(F.transform("edges", lambda e, k: F.greatest(e["low"], F.try_element_at("known", k.cast("bigint")))))
            else:
                least = F.try_element_at("known", F.lit(0).cast("bigint"))
            state = state.select(*anchors.columns, least.alias("least"), most.alias("most"))
            visits, visits_at = stored_at(map_arrow(state, _visits(self.books, self.radii, self.there, self.dim, start, start + step),
                                                    f"{_ddl(state)}, i int, j int"), "visits")
            count = visits.count()
            if count:
                packed = visits.groupBy("i", "j", "chunk").agg(
                    F.collect_list(F.struct("aid", "lab", "vec", "least", "edges")).alias("anchors"))
                # the stored visits name each anchor's vector once a file, so their size tells nothing of what a broadcast would take
                hits = map_arrow(self.blocks.join(packed.hint(MERGE), ["i", "j"]).select("anchors", "recs"),
                                 _met(self.dim, self.keep, keep, windows), kind)
                new, at = stored_at(found.union(hits).withColumn("_r", F.row_number().over(best))
                                    .filter(F.col("_r") <= keep).drop("_r"), "found")
                if found_at:
                    drop_path(self.spark, found_at)
                found, found_at = new, at
            drop_path(self.spark, visits_at)
            visited += count
            start, step = start + step, step * GROWTH
        self.visited.append((visited, n * cells))
        return found


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         entries: int | None = None) -> tuple[DataFrame, MultiIndex | None]:
    """((anchor_id, positive_id, rank, negative_id, positive_score, negative_score), the index searched).

    ``is_anchor``: a condition on ``vec_id``. A negative's score lies between ``low`` and ``high``
    percent of the positive's.
    """
    spark = df.sparkSession
    whole = df.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"),
                     (F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col)))
                     .alias("lab"), F.col(vec_col).alias("v")).filter("vec_id is not null and lab is not null")
    dim = dimension(rows, "v")
    if not dim:
        return spark.createDataFrame([], OUT), None
    ready = stored(map_arrow(rows, _as_integers(dim, scale), "vec_id bigint, lab bigint, vec binary, own_score bigint"), "integers")
    if ready.isEmpty():
        return spark.createDataFrame([], OUT), None
    index = MultiIndex(ready.drop("own_score"), dim, max(positives + 1, negatives), entries)
    own = ready.filter(is_anchor).withColumn("aid", F.xxhash64("lab", "vec"))
    anchors = stored(own.select("aid", "lab", "vec").dropDuplicates(["aid"]), "anchors")

    # one more than wanted, as an anchor may find itself
    first = Window.partitionBy("aid").orderBy(F.desc("score"), "vec_id")
    pos = index.search(anchors.withColumn("edges", F.lit(None).cast(EDGES)), positives + 1, False)
    pos = (pos.withColumn("w", F.row_number().over(first) - 1).groupBy("aid")
           .agg(F.sort_array(F.collect_list(F.struct("w", "score", "vec_id"))).alias("pos")))
    ends = (f"named_struct('low', (cast(p.score as decimal(20,0)) * {low} + 99) div 100,"
            f" 'high', cast(p.score as decimal(20,0)) * {high} div 100)")
    none = f"named_struct('low', {NO_WINDOW['low']}L, 'high', cast('{NO_WINDOW['high']}' as bigint))"
    edges = F.expr(f"transform(transform(pos, p -> if(p.score < 0, {none}, {ends})), e -> if(e.low > e.high, {none}, e))")
    asked = stored(anchors.join(pos.hint(MERGE), "aid").withColumn("edges", edges), "windows")
    neg = index.search(asked.drop("pos"), negatives, True)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))),
                          lambda n: F.struct((-n["s"]).alias("score"), n["vec_id"].alias("vec_id")))
    neg = (neg.groupBy("aid", "w").agg(ordered.alias("negs")).groupBy("aid")
           .agg(F.map_from_entries(F.collect_list(F.struct("w", "negs"))).alias("negs")))
    found = asked.select("aid", "pos").join(neg.hint(MERGE), "aid").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))

    itself = F.array_position(F.transform("pos", lambda p: F.struct(p["score"], p["vec_id"])), F.struct(F.col("own_score").alias("score"), "vec_id"))
    others = F.slice(F.filter("pos", lambda p, k: k + 1 != F.col("itself")), 1, positives)
    out = (own.select("vec_id", "aid", "own_score", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
           .join(found.hint(MERGE), ["aid", "salt"]).withColumn("itself", itself).select("vec_id", "negs", F.explode(others).alias("p"))
           .select("vec_id", "p", F.posexplode(F.try_element_at("negs", F.col("p.w").cast("bigint"))).alias("at", "n"))
           .select(F.col("vec_id").alias("anchor_id"), F.col("p.vec_id").alias("positive_id"),
                   (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
                   F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score")))
    return out, index


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)[0]


def oracle() -> str:
    return f"""
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scores USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
