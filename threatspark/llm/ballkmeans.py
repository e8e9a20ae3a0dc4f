"""Vector codes by ball k-means over integer parts (operator 13).

Vectors become integers and are cut into equal parts; every part position has a codebook
that exact Lloyd rounds refine. An entry and the parts assigned to it form a ball. After an
update, its radius about the new entry is at most the old radius plus the entry's shift, so no
further pass is needed to bound it. Entries further away than twice the radius cannot be nearer
to any part of the ball: what is left are its neighbour entries.

* A ball is a stable core when neither its entry nor a neighbour moved: its parts keep their code and
  no distance is computed.
* In any other ball, neighbours are sorted by distance. A part at squared distance d from its
  entry lies in the annular ring of those neighbours whose squared distance to the entry is at most 4 d,
  and is compared with these alone. A part in the innermost ring (none) keeps its code.

All tests are on integers, and equality keeps a candidate, so ties go to the lower index exactly as
a full search would have it. Each round reads the rows once: a task rewrites them with their new
codes and adds one row per (part, entry) of counts, sums and radii, which Spark adds up. Between rounds
the driver holds the codebooks alone; the previous round's table is dropped.

Defined results: rows whose vector is null, empty, of another length than the most frequent one, or
holds null or non-finite components are dropped; if the length is no multiple of the number of parts,
the last parts are shorter; fewer rows than entries give fewer entries; rows of equal id are ordered by
their integers' bytes, null ids last; integers beyond ``ints.limit`` are cut to it; repeated rows each get
a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_path, map_arrow, read_table, stored, stored_at
from .ints import dimension, distances, integers

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows that a task works on at a time.
ROWS = 1 << 15
#: Pieces that the rows of one label are dealt into when label sums are joined to them.
SALTS = 16


@dataclass
class Part:
    """One position's codebook, and what the last assignment and update tell of its balls."""
    book: np.ndarray                       # (entries, width)
    radius: np.ndarray | None = None       # squared, no part of the ball is further away; None before the first round
    moved: np.ndarray | None = None
    order: list = field(default_factory=list)     # neighbours of each entry by distance, and those distances
    reach: list = field(default_factory=list)

    def prepare(self) -> None:
        if self.radius is None:
            return
        apart = distances(self.book, self.book)
        self.order, self.reach = [], []
        for i, d in enumerate(apart):
            near = np.flatnonzero(d <= 4 * self.radius[i])
            near = near[near != i]
            near = near[np.argsort(d[near], kind="stable")]
            self.order.append(near)
            self.reach.append(d[near])

    def stable(self, i: int) -> bool:
        return not self.moved[i] and not self.moved[self.order[i]].any()

    def assign(self, x: np.ndarray, codes: np.ndarray | None, always: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(codes, squared distances or -1 where a stable core skipped them, distances computed)."""
        if self.radius is None:
            d = distances(x, self.book)
            codes = d.argmin(1)
            return codes, d[np.arange(len(x)), codes], d.size
        new, best, work = codes.copy(), np.full(len(x), -1, np.int64), 0
        by = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[by], np.arange(len(self.book) + 1))
        for i in range(len(self.book)):
            rows = by[cuts[i]:cuts[i + 1]]
            if not len(rows) or self.stable(i) and not always:
                continue
            own = ((x[rows] - self.book[i]) ** 2).sum(1)
            best[rows] = own
            work += len(rows)
            if self.stable(i):
                continue
            ring = np.searchsorted(self.reach[i], 4 * own, side="right")
            inner = 0
            while inner < ring.max():
                outer = min(max(2 * inner, 4), len(self.reach[i]))
                at = np.flatnonzero((ring > inner) & (ring <= outer))
                if len(at):
                    near = np.append(self.order[i][:ring[at].max()], i)
                    near.sort()
                    d = distances(x[rows[at]], self.book[near])
                    to = d.argmin(1)            # the first of the least: the lower index
                    new[rows[at]] = near[to]
                    best[rows[at]] = d[np.arange(len(at)), to]
                    work += d.size
                inner = outer
        return new, best, work

    def update(self, n: np.ndarray, radius: np.ndarray, sums: np.ndarray) -> None:
        """Means, rounded down, and bounds of the radii about them."""
        book = np.where(n[:, None] > 0, np.floor_divide(sums, np.maximum(n, 1)[:, None]), self.book).astype(np.int64)
        if self.radius is not None:     # skipped parts did not tell their distance
            radius = np.where([self.stable(i) for i in range(len(book))], np.maximum(radius, self.radius), radius)
        radius = np.maximum(radius, 0)
        shift = ((book - self.book) ** 2).sum(1)
        self.moved = shift > 0
        grown = np.ceil((np.sqrt(radius.astype(float)) + np.sqrt(shift.astype(float))) ** 2 * (1 + 1e-9)) + 1
        self.radius = np.where(self.moved, np.minimum(grown, 2.0**60).astype(np.int64), radius)
        self.book = book


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = -(-x.shape[1] // parts)
    return [x[:, k * width:(k + 1) * width] for k in range(parts)]


OWN = "vec binary, code binary, error bigint"
SUMS = "part int, entry int, n bigint, radius bigint, sums array<bigint>, work bigint"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _prepared(dim: int, scale: int):
    def run(batches):
        for b in batches:
            at, x = integers(b.column(2), dim, scale)
            x = x.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(pa.array(at)) for k in (0, 1)), pa.array([v.tobytes() for v in x], pa.binary()),
                 pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64())], names=["vec_id", "label", *_names(OWN)])
    return run


def _gathered(batches, rows: int):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _round(parts: list[Part], dim: int, label: pa.DataType, last: bool):
    """Assigns a task's rows, and unless it is the last assignment adds them up per entry."""
    names = ["vec_id", "label", *_names(OWN if last else f"{OWN}, {SUMS}")]
    sum_types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())

    def run(batches):
        for p in parts:
            p.prepare()
        n = [np.zeros(len(p.book), np.int64) for p in parts]
        radius = [np.full(len(p.book), -1, np.int64) for p in parts]
        sums = [np.zeros(p.book.shape, np.int64) for p in parts]
        work = 0
        for t in _gathered(batches, ROWS):
            x = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)
            old = t.column("code").to_pylist()
            old = None if old[0] is None else np.frombuffer(b"".join(old), np.uint8).reshape(len(x), -1)
            codes, error = [], np.zeros(len(x), np.int64)
            for k, (p, xk) in enumerate(zip(parts, cut(x, len(parts)), strict=True)):
                c, d, did = p.assign(xk, None if old is None else old[:, k].astype(np.int64), last)
                codes.append(c.astype(np.uint8))
                error += d
                work += did
                if not last:
                    n[k] += np.bincount(c, minlength=len(p.book))
                    np.maximum.at(radius[k], c, d)
                    for j in range(xk.shape[1]):    # exact: ROWS x ints.limit is below 2^53
                        sums[k][:, j] += np.bincount(c, xk[:, j], len(p.book)).astype(np.int64)
            out = [t.column("vec_id"), t.column("label"), pa.nulls(len(x), pa.binary()) if last else t.column("vec"),
                   pa.array([v.tobytes() for v in np.stack(codes, 1)], pa.binary()),
                   pa.array(error) if last else pa.nulls(len(x), pa.int64())]
            if not last:
                out += [pa.nulls(len(x), kind) for kind in sum_types]
            yield from pa.Table.from_arrays(out, names=names).combine_chunks().to_batches()
        for k in range(0 if last else len(parts)):
            at = np.flatnonzero(n[k])
            did = np.zeros(len(at), np.int64)
            did[:1] = work if k == 0 else 0
            yield pa.RecordBatch.from_arrays([
                *(pa.nulls(len(at), kind) for kind in (pa.int64(), label, pa.binary(), pa.binary(), pa.int64())),
                pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[k][at]),
                pa.array(radius[k][at]), pa.array(sums[k][at].tolist(), pa.list_(pa.int64())), pa.array(did)], names=names)
    return run


@dataclass
class Codebooks:
    parts: list[np.ndarray]
    #: Distances computed by each assignment but the last; a full search takes rows x entries x parts.
    work: list[int]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.parts for v in p.ravel().tolist()).encode()).hexdigest()


def fit_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
              scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
              rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error) of every kept row, the codebooks).

    ``code`` holds a byte per part, ``error`` the squared distances summed over parts.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte per part: 1 to 256 entries")
    kind = df.schema[label_col].dataType
    head = f"vec_id bigint, label {kind.simpleString()}"
    dim = dimension(df, vec_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    now, path = stored_at(map_arrow(rows, _prepared(dim, scale), f"{head}, {OWN}"), "vectors")
    # a bounded read: as many rows as there are entries
    least = now.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).select("vec").toArrow().column(0).to_pylist()
    if not least:
        return now.drop("vec"), Codebooks([], [])
    if dim < parts or (parts - 1) * -(-dim // parts) >= dim:
        raise ValueError(f"vectors of length {dim} cannot be cut into {parts} parts")
    first = np.frombuffer(b"".join(least), "<i4").reshape(-1, dim).astype(np.int64)
    books = [Part(b) for b in cut(first, parts)]
    as_arrow, work = to_arrow_type(kind), []
    for _ in range(rounds):
        new, to = stored_at(map_arrow(now, _round(books, dim, as_arrow, False), f"{head}, {OWN}, {SUMS}"), "codes")
        drop_path(df.sparkSession, path)
        width = books[0].book.shape[1]
        got = (new.filter("part is not null").groupBy("part", "entry")
               .agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("work").alias("work"),
                    *[F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])
               .collect())     # at most parts x entries rows
        work.append(sum(r.work for r in got))
        for k, p in enumerate(books):
            n, radius = np.zeros(len(p.book), np.int64), np.full(len(p.book), -1, np.int64)
            sums = np.zeros(p.book.shape, object)
            for r in got:
                if r.part == k:
                    n[r.entry], radius[r.entry] = r.n, r.radius
                    sums[r.entry] = [int(r[f"s{j}"]) for j in range(p.book.shape[1])]
            p.prepare()
            p.update(n, radius, sums)
        now, path = new.filter("part is null").select("vec_id", "label", *_names(OWN)), to
    out = map_arrow(now, _round(books, dim, as_arrow, True), f"{head}, {OWN}").drop("vec")
    return out, Codebooks([p.book for p in books], work)


def coded(df: DataFrame, **how) -> DataFrame:
    """(vec_id, code in hex, error, label_error, codebooks_sha256) of every kept row."""
    rows, books = fit_codes(df, **how)
    rows = stored(rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label",
                              F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).alias("salt")), "coded")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    total = (rows.groupBy("label").agg(F.sum("error").alias("label_error"))
             .select(F.col("label").alias("l"), "label_error", salts.alias("s")))
    return (rows.join(total, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")))
            .select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(read_table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The same rounds by full search, a CTE each."""
    near = """
a{k} AS (
  SELECT vec_id, label, part, x, list_min(list_transform(book, lambda c: {{'d': list_sum(list_transform(range(len(x)),
    lambda j: (x[j + 1] - c.v[j + 1]) * (x[j + 1] - c.v[j + 1])))::BIGINT, 'i': c.i}})) AS best
  FROM parts JOIN b{k} USING (part))"""
    means = """
m{k} AS (
  SELECT part, best.i AS i, j, sum(x[j + 1])::HUGEINT AS s, count(*) AS n FROM a{o}, range(16) r(j) GROUP BY ALL),
v{k} AS (
  SELECT part, i, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END::BIGINT ORDER BY j) AS v FROM m{k} GROUP BY part, i),
b{k} AS (
  SELECT part, list({{'i': o.i, 'v': coalesce(v{k}.v, o.v)}} ORDER BY o.i) AS book
  FROM (SELECT part, unnest(book, recursive := true) FROM b{o}) o LEFT JOIN v{k} USING (part, i) GROUP BY part)"""
    rounds = ",".join(near.format(k=k) + "," + means.format(k=k + 1, o=k) for k in range(ROUNDS)) + "," + near.format(k=ROUNDS)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS (
  SELECT vec_id, label, part, v[16 * part + 1:16 * part + 16] AS x FROM kept, range({PARTS}) r(part)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS i FROM parts),
b0 AS (
  SELECT part, list({{'i': i, 'v': x}} ORDER BY i) AS book FROM numbered WHERE i < {ENTRIES} GROUP BY part),{rounds},
digest AS (
  SELECT sha256(string_agg(t, ',' ORDER BY part)) AS codebooks_sha256 FROM (
    SELECT part, array_to_string(flatten(list_transform(book, lambda c: c.v)), ',') AS t FROM b{ROUNDS})),
rows AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.i), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, digest"""
