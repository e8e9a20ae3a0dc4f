"""Byte-level BPE encoding and decoding with a bitmap rank queue (operator 2).

Merges of one pre-token run over a doubly linked list of byte spans. Every
adjacent pair that has a merge rank puts its left position into the bucket of
that rank; a two-level bitmap over the ranks marks the buckets in use, and
find-first-set on both levels gives the lowest rank. Entries whose pair has
changed meanwhile are stale and skipped when they surface, so a merge costs a
few bucket operations however long the pre-token is. Within a bucket the
leftmost position goes first.

A worker keeps the ids of recent short pre-tokens; the store is bounded.

Defined results: null text is the empty text (no ids, empty bytes); texts of any
length are encoded whole; repeated rows give repeated results; other columns
pass through, an input column named like an output column is replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from heapq import heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended_schema, map_arrow, read_table, sub_batches, texts, with_columns, worker_stores

RANKS = "byte_bpe_50k.tiktoken"
#: The same split as public_tokenizers.PATTERN for texts that are all ASCII.
ASCII_PATTERN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
WORD_BITS = 256         # ranks per lower bitmap word
STORE_ENTRIES = 250_000  # per generation of a worker's store
STORE_CHARS = 64        # longer pre-tokens are not kept


def merge(piece: bytes, ranks: dict[bytes, int], first: list[int]) -> list[int]:
    """Ids of one pre-token; ``first`` has the rank of each pair of bytes, -1 for none."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    after = list(range(1, n + 1))      # start of the next span
    before = list(range(-1, n - 1))    # start of the span on the left
    # rank of the pair that starts at a span, -1: none
    pair = [first[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)] + [-1, -1]
    # the queue: positions by rank, words of WORD_BITS ranks that are in use, and a bitmap of these words
    bucket: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for i, r in enumerate(pair):
        if r >= 0:
            if r in bucket:
                bucket[r].append(i)    # in order: the list is a heap
            else:
                bucket[r] = [i]
                w = r // WORD_BITS
                low[w] = low.get(w, 0) | 1 << r % WORD_BITS
                top |= 1 << w
    while top:
        w = (top & -top).bit_length() - 1
        bits = low[w]
        bit = bits & -bits
        rank = w * WORD_BITS + bit.bit_length() - 1
        found = bucket[rank]
        if len(found) > 1:
            i = heappop(found)
        else:
            i = found[0]
            del bucket[rank]
            bits ^= bit
            low[w] = bits
            if not bits:
                top &= top - 1
        if pair[i] != rank:
            continue                   # stale
        j = after[i]
        k = after[j]
        pair[j] = -1
        after[i] = k
        if k < n:
            before[k] = i
            r = pair[i] = get(piece[i:after[k]], -1)
            if r >= 0:
                if r in bucket:
                    heappush(bucket[r], i)
                else:
                    bucket[r] = [i]
                    w = r // WORD_BITS
                    low[w] = low.get(w, 0) | 1 << r % WORD_BITS
                    top |= 1 << w
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            r = pair[h] = get(piece[h:k], -1)
            if r >= 0:
                if r in bucket:
                    heappush(bucket[r], h)
                else:
                    bucket[r] = [h]
                    w = r // WORD_BITS
                    low[w] = low.get(w, 0) | 1 << r % WORD_BITS
                    top |= 1 << w
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class Store(dict):
    """pre-token -> packed ids; two bounded generations, the older one is dropped."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.older = ranks, {}
        self.first = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = merge(piece.encode("utf-8"), self.ranks, self.first)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= STORE_CHARS:
            if len(self) >= STORE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


_encoders: dict[tuple[str, str], tuple] = {}


def _encoder(path: str, pattern: str):
    """(split function, store, id -> bytes), once per worker."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = {v: k for k, v in ranks.items()}
        general = regex.compile(pattern).findall
        plain = ASCII_PATTERN.findall if pattern == public_tokenizers.PATTERN else general
        _encoders[path, pattern] = (lambda t: (plain if t.isascii() else general)(t), Store(ranks), by_id)
    return _encoders[path, pattern]


def _empty() -> None:
    for _, store, _ in _encoders.values():
        store.clear()
        store.older = {}


worker_stores["bpe"] = _empty


def encode_text(text: str | None, path: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    split, store, _ = _encoder(path, pattern)
    return b"".join([store[p] for p in split(text or "")])


def decode_ids(packed: bytes, path: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    by_id = _encoder(path, pattern)[2]
    ids = array("I")
    ids.frombytes(packed)
    if struct.pack("=I", 1) != struct.pack("<I", 1):
        ids.byteswap()
    return b"".join([by_id[i] for i in ids])


def encode(df: DataFrame, text_col: str = "text", path: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``n_tokens`` long and ``ids`` binary (packed as in encode_text)."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, text_col):
                ids = [encode_text(t, path, pattern) for t in texts(batch, text_col)]
                yield with_columns(batch, {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                                           "ids": pa.array(ids, pa.binary())})
    return map_arrow(df, run, extended_schema(df, {"n_tokens": "bigint", "ids": "binary"}), store="bpe")


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``decoded`` binary, the bytes of the ids."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, ids_col):
                out = [decode_ids(x or b"", path, pattern) for x in texts(batch, ids_col)]
                yield with_columns(batch, {"decoded": pa.array(out, pa.binary())})
    return map_arrow(df, run, extended_schema(df, {"decoded": "binary"}), store="bpe")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs).select("doc_id", "n_tokens", "ids")
    return decode(ids).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                              F.sha2("decoded", 256).alias("decoded_sha256"))
