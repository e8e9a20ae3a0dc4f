"""Exact removal of repeated substrings by sorted suffixes (operator 9).

A byte goes if it lies in a string of ``length`` bytes that also starts
elsewhere. Every window of that length selects one anchor in it: the block of
half the length with the least hash, leftmost first. The choice depends on the
window's bytes alone, so equal windows select equal blocks at equal offsets, and
only suffixes at anchors need sorting:

1. Anchors whose block occurs once cannot lie in a repeat. Blocks that occur
   again are found by a grouped aggregate and kept in a bit array of fixed size
   (it may let through too much, which costs time only).
2. Each task sorts the suffixes at its remaining anchors into runs, merges
   equal ones, front-codes the runs and sends them to the block's partition.
3. There a loser tree that knows common prefixes merges the runs. Neighbours
   whose common prefix spans the block form a group; common prefixes to the right
   and common bytes to the left give the windows that repeat.
4. The results go back to the documents by the key of the suffix, and bytes
   under repeated windows are cut.

A block with very many occurrences is dealt out again by the offset of the
window in it, in cells of ``CELL`` bytes, and goes to a partition by the bytes that
the members of a group share: all but that many bytes of a window. Equal texts are one text: each of their copies is
covered by the others, so it goes whole if it has ``length`` bytes.

Defined results: null text is empty; texts shorter than ``length`` stay; matches
never cross documents; repeated rows are copies of one another; ids may be null
or repeated, as rows are told apart by their text; columns of the input pass through
and one named like an output column is replaced; no rows give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import (extended_schema, map_arrow, read_table, stored, sub_batches, texts, with_columns, worker_stores,
                     workers_import)
from .suffixes import common, decoded, front_code, merged

LENGTH = 400
BLOOM_BITS = 26
HOT = 4096            # occurrences of a block from which its windows are dealt out by offset
CELL = 25
RUN_RECORDS = 20_000  # suffixes that a task sorts at a time
GROUP_BYTES = 8 << 20  # of front-coded suffixes for one merge, about
PAIRWISE = 8          # larger groups compare windows by hash
OUT = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint",
       "spans": "array<struct<start:bigint,stop:bigint>>", "kept": "binary"}

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
worker_stores["repeats"] = _powers.clear


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's odd base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 17, 1 << n.bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, x in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _prefix_hash(b: np.ndarray) -> np.ndarray:
    up, _ = _power(len(b))
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(blocks.mixed(np.arange(1, 257, dtype=np.uint64) * blocks.ODD)[b] * up, out=out[1:])
    return out


def _hash_at(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, stop)."""
    _, down = _power(len(prefix))
    return blocks.mixed((prefix[stop] - prefix[start]) * down[start])


def anchors(text: bytes, length: int = LENGTH):
    """(position, block hash, least offset, most offset) of the anchors that windows of ``text`` select.

    Window s selects the anchor at position p = s + offset.
    """
    n = len(text)
    if n < length:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e, e, None
    k = length // 2
    prefix = _prefix_hash(np.frombuffer(text, np.uint8))
    at = np.arange(n - k + 1)
    h = _hash_at(prefix, at, at + k)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, width = length - k + 1, 1
    while 2 * width <= span:  # least of `width` neighbours, doubled
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    p = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    last = np.r_[first[1:], len(p)] - 1
    p = p[first]
    return p, h[p], p - last, p - first, prefix


def _occurrences(length: int):
    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                hs, occ = [], []
                for key, t in zip(texts(batch, "text_key"), texts(batch, "text"), strict=True):
                    if t is None or key in seen:
                        continue
                    seen.add(key)
                    p, h, _, _, _ = anchors(t.encode("utf-8", "surrogatepass"), length)
                    if len(p):
                        hs.append(h)
                        occ.append(blocks.mixed(p.astype(np.uint64) * blocks.ODD + np.uint64(key & (2**64 - 1))))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (hs, occ)],
                                                     names=["h", "occ"])
    return run


class _Run:
    """Suffix records of one task, by partition."""

    def __init__(self, parts: int) -> None:
        self.parts, self.records = parts, {}

    def add(self, ctx: int, h: int, cell: int, right: bytes, left: bytes, lo: int, hi: int) -> None:
        found = self.records.get(ctx)
        if found is None:
            self.records[ctx] = [h % self.parts, bytes([cell]) + right, left, lo, hi, 1]
        else:
            found[5] = 2

    def batches(self):
        by: dict[int, list] = {}
        for ctx, r in self.records.items():
            by.setdefault(r[0], []).append((r[1], r[2], ctx, r[3], r[4], r[5]))
        self.records = {}
        for part, rows in by.items():
            rows.sort(key=lambda r: r[0])
            lcp, size, tails = front_code([r[0] for r in rows])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "lcp": [lcp], "size": [size], "tails": [tails],
                "lefts": [b"".join(r[1] for r in rows)],
                "info": [np.array([(len(r[1]), r[3], r[4], r[5]) for r in rows], "<i4").tobytes()],
                "ctx": [np.array([r[2] for r in rows], "<i8").tobytes()],
                "text_key": pa.array([None], pa.int64())})


RUN_SCHEMA = "part int, lcp binary, size binary, tails binary, lefts binary, info binary, ctx binary, text_key bigint"


def _runs(length: int, parts: int, again, hot):
    """Front-coded runs, and per text (text_key set) the places of its records in `info` and `ctx`."""
    def run(batches):
        wanted, often = again.value, hot.value
        seen: set[int] = set()
        out = _Run(parts)
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                for key, t in zip(texts(batch, "text_key"), texts(batch, "text"), strict=True):
                    if t is None or key in seen:
                        continue
                    seen.add(key)
                    b = t.encode("utf-8", "surrogatepass")
                    p, h, lo, hi, prefix = anchors(b, length)
                    if not len(p):
                        continue
                    keep = blocks.in_bloom(wanted, h.view(np.int64))
                    p, h, lo, hi = p[keep], h[keep], lo[keep], hi[keep]
                    if not len(p):
                        continue
                    is_hot = blocks.in_bloom(often, h.view(np.int64))
                    # one record per anchor, or per cell of offsets if its block is hot
                    first = np.where(is_hot, lo // CELL, 0)
                    n = np.where(is_hot, hi // CELL, 0) - first + 1
                    row = np.repeat(np.arange(len(p)), n)
                    cell = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    base = np.where(is_hot[row], cell * CELL, 0)
                    dlo = np.maximum(lo[row], base)
                    dhi = np.where(is_hot[row], np.minimum(hi[row], base + CELL - 1), hi[row])
                    pos, core = p[row], p[row] - base
                    start, stop = pos - dhi, pos - dlo + length
                    code = np.where(is_hot[row], cell + 1, 0)
                    shape = (code * 4096 + dlo) * 4096 + dhi
                    ctx = blocks.mixed(_hash_at(prefix, start, stop) + shape.astype(np.uint64) * blocks.ODD)
                    ctx = ctx.view(np.int64)
                    # hot records of a block part by the bytes that all members of a group share
                    dealt = is_hot[row]
                    part_of = h[row]
                    shared = _hash_at(prefix, core[dealt], core[dealt] + length - CELL + 1)
                    part_of[dealt] = blocks.mixed(part_of[dealt] + shared + code[dealt].astype(np.uint64) * blocks.ODD)
                    for c, q, s, a, e, x, y, z in zip(ctx.tolist(), part_of.tolist(), start.tolist(), core.tolist(),
                                                      stop.tolist(), dlo.tolist(), dhi.tolist(), code.tolist(),
                                                      strict=True):
                        out.add(c, q, z, b[a:e], b[s:a], x, y)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([None], pa.int32()),
                        **{k: pa.array([None], pa.binary()) for k in ("lcp", "size", "tails", "lefts")},
                        "info": [pos.astype("<i4").tobytes()], "ctx": [ctx.astype("<i8").tobytes()],
                        "text_key": pa.array([key], pa.int64())})
                    if len(out.records) >= RUN_RECORDS:
                        yield from out.batches()
        yield from out.batches()
    return run


def _suffix_common(x: bytes, y: bytes) -> int:
    return common(x[::-1], y[::-1])


def _by_pairs(group: list, base: int, length: int) -> list[list[tuple[int, int]]]:
    """Offsets of repeated windows by common prefixes; group: (lcp, right, left, lo, hi)."""
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    for i in range(len(group)):
        r = None
        for j in range(i + 1, len(group)):
            r = group[j][0] if r is None else min(r, group[j][0])
            left = _suffix_common(group[i][2], group[j][2])
            lo = max(base + length - (r - 1), group[i][3], group[j][3])
            hi = min(base + left, group[i][4], group[j][4])
            if lo <= hi:
                out[i].append((lo, hi))
                out[j].append((lo, hi))
    return out


def _by_hash(group: list, base: int, length: int) -> list[list[tuple[int, int]]]:
    """The same for a large group: windows of one offset are equal if their hashes are."""
    lo = np.array([g[3] for g in group])
    hi = np.array([g[4] for g in group])
    hashes = np.zeros((len(group), int(hi.max() - lo.min()) + 1), np.uint64)
    for k, g in enumerate(group):
        b = np.frombuffer(g[2] + g[1][1:], np.uint8)
        start = len(g[2]) - (np.arange(lo[k], hi[k] + 1) - base)
        hashes[k, lo[k] - lo.min():hi[k] - lo.min() + 1] = _hash_at(_prefix_hash(b), start, start + length)
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    for c in range(hashes.shape[1]):
        d = c + int(lo.min())
        own = np.flatnonzero((lo <= d) & (d <= hi))
        _, back, n = np.unique(hashes[own, c], return_inverse=True, return_counts=True)
        for k in own[n[back] > 1].tolist():
            if out[k] and out[k][-1][1] == d - 1:
                out[k][-1] = (out[k][-1][0], d)
            else:
                out[k].append((d, d))
    return out


def _merge_part(length: int):
    core = length // 2

    def run(table: pa.Table) -> pa.Table:
        runs = []
        for row in table.select(["lcp", "size", "tails", "lefts", "info", "ctx"]).to_pylist():
            def records(row=row):
                info = np.frombuffer(row["info"], "<i4").reshape(-1, 4).tolist()
                ctx, at = np.frombuffer(row["ctx"], "<i8").tolist(), 0
                for (n, s), (m, lo, hi, count), c in zip(decoded(row["lcp"], row["size"], row["tails"]), info, ctx,
                                                         strict=True):
                    yield n, s, (row["lefts"][at:at + m], lo, hi, count, c)
                    at += m
            runs.append(records())
        keys, spans = [], []

        def close(group: list) -> None:
            # equal records of several runs are one that occurs again
            one: dict[int, list] = {}
            for n, s, (left, lo, hi, count, c) in group:
                if c in one:
                    one[c][1] = 2
                    one[c][2] = min(one[c][2], n)
                else:
                    one[c] = [(s, left, lo, hi), count, n]
            own = [(n, *record) for record, _, n in one.values()]
            code = group[0][1][0]
            base = (code - 1) * CELL if code else 0
            found = ([[] for _ in own] if len(own) == 1 else _by_pairs(own, base, length) if len(own) <= PAIRWISE
                     else _by_hash(own, base, length))
            for (c, (_, count, _)), (_, _, _, lo, hi), f in zip(one.items(), own, found, strict=True):
                f = [(lo, hi)] if count > 1 else f
                if f:
                    keys.append(c)
                    spans.append(np.array(f, "<i4").tobytes())

        group: list = []
        for n, s, payload in merged(runs):
            need = 1 + (length - CELL + 1 if s[0] else core)
            if group and n < need:
                close(group)
                group = []
            group.append((n, s, payload))
        if group:
            close(group)
        return pa.table({"ctx": pa.array(keys, pa.int64()), "offsets": pa.array(spans, pa.binary())})
    return run


def _places(batches):
    for b in batches:
        key, pos, ctx = [], [], []
        for k, p, c in zip(texts(b, "text_key"), texts(b, "info"), texts(b, "ctx"), strict=True):
            p = np.frombuffer(p, "<i4")
            key.append(np.full(len(p), k, np.int64))
            pos.append(p)
            ctx.append(np.frombuffer(c, "<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, pos, ctx)],
                                         names=["text_key", "pos", "ctx"])


def removed_spans(pos: list[int], offsets: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs [start, stop) from anchors and offsets of their repeated windows."""
    own = []
    for p, f in zip(pos, offsets, strict=True):
        own += [(p - hi, p - lo + length) for lo, hi in np.frombuffer(f, "<i4").reshape(-1, 2).tolist()]
    out: list[tuple[int, int]] = []
    for a, b in sorted(own):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cut(text_col: str, length: int, names: list[str]):
    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, text_col):
                size, gone, spans, kept = [], [], [], []
                for t, copies, found in zip(texts(batch, text_col), texts(batch, "_copies"), texts(batch, "_found"),
                                            strict=True):
                    b = (t or "").encode("utf-8", "surrogatepass")
                    if copies and len(b) >= length:
                        own = [(0, len(b))]
                    else:
                        own = removed_spans([f["pos"] for f in found or ()], [f["offsets"] for f in found or ()], length)
                    at, rest = 0, []
                    for x, y in own:
                        rest.append(b[at:x])
                        at = y
                    rest.append(b[at:])
                    kept.append(b"".join(rest))
                    size.append(len(b))
                    gone.append(len(b) - len(kept[-1]))
                    spans.append([{"start": x, "stop": y} for x, y in own])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield with_columns(batch.select(names), {
                    "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                    "n_spans": pa.array([len(s) for s in spans], pa.int64()), "spans": pa.array(spans, kind),
                    "kept": pa.array(kept, pa.binary())})
    return run


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, spans and kept (bytes of the text that stay)."""
    if not 2 * CELL <= length < 4096:
        raise ValueError(f"length must be from {2 * CELL} to 4095")
    spark = df.sparkSession
    workers_import(spark)
    docs = df.select(F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    many = docs.groupBy("text_key").count().filter("count > 1").select("text_key", F.lit(True).alias("_copies"))
    met = map_arrow(docs, _occurrences(length), "h bigint, occ bigint")
    met = (met.groupBy("h").agg(F.min("occ").alias("lo"), F.max("occ").alias("hi"), F.count(F.lit(1)).alias("n"))
           .filter("lo <> hi").select("h", "n"))
    met = stored(met, "blocks")
    cells = (length - length // 2) // CELL + 1  # most records of an anchor of a hot block
    total = met.agg(F.sum(F.col("n") * F.when(F.col("n") >= HOT, cells).otherwise(1))).first()[0] or 0
    again = spark.sparkContext.broadcast(blocks.bloom(met.select("h"), BLOOM_BITS))
    hot = spark.sparkContext.broadcast(blocks.bloom(met.filter(F.col("n") >= HOT).select("h"), BLOOM_BITS - 4))
    parts = max(1, total * int(1.5 * length) // GROUP_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = stored(map_arrow(docs, _runs(length, parts, again, hot), RUN_SCHEMA), "runs")
    again.destroy()     # else every worker keeps them
    hot.destroy()
    found = runs.filter("part is not null").drop("text_key").groupBy("part").applyInArrow(
        _merge_part(length), "ctx bigint, offsets binary")
    places = map_arrow(runs.filter("text_key is not null").select("text_key", "info", "ctx"), _places,
                       "text_key bigint, pos int, ctx bigint")
    own = (places.join(found, "ctx").groupBy("text_key")
           .agg(F.collect_list(F.struct("pos", "offsets")).alias("_found")))
    own = stored(own.join(many, "text_key", "full"), "found")
    # texts that keep every byte need not move: they are told by a bit array of fixed size
    touched = spark.sparkContext.broadcast(blocks.bloom(own.select("text_key"), BLOOM_BITS - 2))
    keyed = df.withColumn("_key", F.xxhash64(text_col))
    names = df.columns
    schema = extended_schema(df, OUT)

    def picked(which: bool, then=None, out: str | None = None):
        def run(batches):
            for b in batches:
                hit = blocks.in_bloom(touched.value, b.column(b.schema.get_field_index("_key"))
                                      .to_numpy(zero_copy_only=False))
                b = b.filter(pa.array(hit if which else ~hit))
                yield from then(b) if then else [b]
        return map_arrow(keyed, run, out or extended_schema(keyed, {}))

    cut = _cut(text_col, length, names)

    def untouched(b):
        none = pa.nulls(len(b))
        yield from cut([with_columns(b, {"_copies": none, "_found": none})])

    # cut in the task that picks them: two chained functions would hold two workers a core
    still = picked(False, untouched, schema)
    moved = picked(True).join(own.withColumnRenamed("text_key", "_key"), "_key", "left")
    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in [*names, "_copies", "_found"]]
    return still.union(map_arrow(moved.select(*quoted), cut, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                       F.sha2("kept", 256).alias("kept_sha256"))
