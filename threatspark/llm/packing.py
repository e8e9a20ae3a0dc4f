"""Packing by power-of-two decomposition (operator 8).

Every document's ids (with one end id) are cut into pieces whose lengths are
the binary digits of the document's length, the longest sequence repeated as
often as it fits. Each piece is a sequence of its own: no sequence crosses
documents and none is padded. Sequences of equal length form a bucket; the
bucket is the upper part of the sequence id, so ordering by it brings equal
lengths together for batching, and ``write_buckets`` stores one folder per
length.

Ids are the tokenizer's for the whole text. Its pre-tokens never contain white
space, so the text is split at white space and each distinct word is encoded once
per worker (in bounded stores) and the ids are gathered in one array. Words of plain Latin
letters are cut further into the tokenizer's own pre-tokens, which many words
share; all others go to the tokenizer whole.

Defined results: null text is the empty text: one piece that holds the end id;
repeated rows are packed each for itself; other columns pass through and an
input column named like an output column is replaced; an empty table gives none.
"""

from __future__ import annotations

import os
import re
import struct
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, sub_batches, worker_stores

VOCAB = "word_bpe_49k.json"
END_ID = 2
LONGEST = 4096
BATCH_BYTES = 4 << 20
#: Strings that a worker's stores hold after a batch, about 200 bytes each.
STORE_WORDS, STORE_PARTS = 500_000, 400_000
STORE_CHARS = 64
JOINED = 512
#: Words of these characters have the same lower case and normal form in every Unicode version; and the
#: tokenizer's pre-token pattern for such words (lower-cased, one per line): fixed values.
NOT_PLAIN = "[^\\x{21}-\\x{7e}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{148}\\x{14a}-\\x{17f}]"
PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017f\n]+").findall
OUTPUT = ("start", "length", "ids", "doc_tokens")

_tokenizers: dict[str, tuple] = {}


class Words:
    """The ids of known words, one after the other in one array."""

    def __init__(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.slot)
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def slots(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these words, where each word's begin and the last one's end)."""
        size = self.size[slots]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        at = np.repeat(self.start[slots] - ends[:-1], size)
        at += np.arange(len(at))
        return self.ids[at], ends

    def keep(self, words: list[str]) -> None:
        """Forgets all other words."""
        ids, ends = self.gathered(self.slots(words))
        self.slot = dict(zip(words, range(len(words)), strict=True))
        self.start, self.size, self.ids = ends[:-1], np.diff(ends), ids


def _tokenizer(path: str):
    """(tokenizer, ids by word, ids by pre-token, which ids end a pre-token), once per worker."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        vocab = t.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        suffix = getattr(t.model, "end_of_word_suffix", None)
        if suffix:
            ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        _tokenizers[path] = (t, Words(), Words(), ends)
    return _tokenizers[path]


def _encoded(strings: list[str], t, ends: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the strings, how many each has); pre-tokens may go joined, as each ends with an id that says so."""
    ids, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for a in range(0, len(strings), JOINED):
        part = strings[a:a + JOINED]
        if joined:
            own = np.array(t.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ends[own]) + 1
            if len(cut) == len(part):
                ids.append(own)
                size.append(np.diff(cut, prepend=0))
                continue
        each = [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
        ids.append(np.array([i for e in each for i in e], "<u4"))
        size.append(np.array([len(e) for e in each], np.int64))
    return np.concatenate(ids), np.concatenate(size)


def _empty() -> None:
    for path, (t, _, _, ends) in list(_tokenizers.items()):
        _tokenizers[path] = (t, Words(), Words(), ends)


worker_stores["packing"] = _empty


def _strings(col: pa.Array) -> list[str]:
    """``to_pylist`` of strings, several times faster."""
    return col.to_numpy(zero_copy_only=False).tolist()


def _bounded(store: Words, most: int, used: list[str], new: list[str]) -> None:
    """Keeps a store within its size: when it is full, the strings of this batch stay; long ones never do."""
    full = len(store.slot) > most
    if full or any(len(w) > STORE_CHARS for w in new):
        store.keep([w for w in (used if full else store.slot) if len(w) <= STORE_CHARS])


def _learn(miss: list[str], words: Words, parts: Words, t, ends: np.ndarray, most: int) -> None:
    """Adds words to the store: plain ones by their pre-tokens, which many words share, the others whole."""
    odd = pc.match_substring_regex(pa.array(miss, pa.string()), NOT_PLAIN).to_numpy(zero_copy_only=False).tolist()
    whole = [w for w, x in zip(miss, odd, strict=True) if x]
    words.add(whole, *_encoded(whole, t, ends, False))
    plain = [w for w, x in zip(miss, odd, strict=True) if not x]
    pre = pa.array(PRE_TOKENS("\n".join(plain).lower()), pa.string())
    coded = pre.dictionary_encode()
    distinct = _strings(coded.dictionary)
    new = [p for p in distinct if p not in parts.slot]
    parts.add(new, *_encoded(new, t, ends, True))
    ids, at = parts.gathered(parts.slots(distinct)[coded.indices.to_numpy()])
    # a word's pre-tokens are those that end within it
    letters = np.cumsum(pc.utf8_length(pa.array(plain, pa.string())).to_numpy().astype(np.int64))
    last = np.searchsorted(np.cumsum(pc.utf8_length(pre).to_numpy().astype(np.int64)), letters, side="right")
    words.add(plain, ids, np.diff(at[last], prepend=0))
    _bounded(parts, most, distinct, new)


def encode_column(texts: pa.Array, path: str, store: tuple[int, int] = (STORE_WORDS, STORE_PARTS)) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, one after the other; where each text's begin and the last one's end).

    ``store``: words and pre-tokens that the worker remembers; fewer take less memory and more time, the ids are the same.

    ASCII white space is white space to the tokenizer too; any other stays inside its word, which goes to the tokenizer whole.
    """
    t, words, parts, ends = _tokenizer(path)
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    distinct = _strings(coded.dictionary)
    miss = [w for w in distinct if w not in words.slot]
    if miss:
        _learn(miss, words, parts, t, ends, store[1])
    ids, at = words.gathered(words.slots(distinct)[coded.indices.to_numpy()])
    offsets = split.offsets.to_numpy().astype(np.int64)
    _bounded(words, store[0], distinct, miss)
    return ids, at[offsets - offsets[0]]


def encode_texts(values: list[str | None], path: str) -> list[bytes]:
    """Packed little-endian ids of whole texts."""
    ids, at = encode_column(pa.array(values, pa.string()), path)
    return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n ids, longest first."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    bit = longest >> 1
    while at < n:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(df: DataFrame, text_col: str = "text", path: str | None = None, end_id: int = END_ID,
         longest: int = LONGEST, store: tuple[int, int] = (STORE_WORDS, STORE_PARTS), batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece: ``df``'s other columns, start, length, ids, doc_tokens, sequence_id, offset.

    ``store`` (as in ``encode_column``) and ``batch_bytes`` bound a worker's memory."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = path or public_tokenizers.path(VOCAB)
    keep = [f for f in df.schema.fields if f.name not in (text_col, *OUTPUT, "sequence_id", "offset")]
    names = [f.name for f in keep]
    end = struct.pack("<I", end_id)

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, text_col, batch_bytes):
                packed, at = encode_column(batch.column(batch.schema.get_field_index(text_col)), path, store)
                packed = np.insert(packed, at[1:], end_id).astype("<u4")        # an end after each text
                row, start, length = [], array("q"), array("q")
                for k, n in enumerate((np.diff(at) + 1).tolist()):
                    cut = pieces(n, longest)
                    row += [k] * len(cut)
                    for a, m in cut:
                        start.append(a)
                        length.append(m)
                row, length = np.array(row, np.int64), np.frombuffer(length, np.int64)
                # pieces follow one another in the ids as they do here
                edges = np.concatenate([np.zeros(1, np.int64), 4 * np.cumsum(length)])
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(packed)])
                other = batch.select(names).take(pa.array(row)).columns if names else []
                yield pa.RecordBatch.from_arrays(
                    [*other, pa.array(np.frombuffer(start, np.int64)), pa.array(length), ids,
                     pa.array((np.diff(at) + 1)[row])], names=[*names, *OUTPUT])

    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in keep]
    schema = ", ".join([*own, "start bigint", "length bigint", "ids binary", "doc_tokens bigint"])
    out = map_arrow(df.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names], text_col), run, schema, store="packing")
    # 13 buckets at most in the upper bits; the row number below them needs no shuffle
    bucket = F.log2(F.col("length").cast("double")).cast("long")
    return (out.withColumn("sequence_id", F.shiftleft(bucket, 56).bitwiseOR(F.monotonically_increasing_id()))
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store sequences in one folder per length."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                             "sequence_id", "offset")
