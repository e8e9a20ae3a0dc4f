import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threatspark.llm import packing

SF001 = "/root/testdata/sf0.001"
PATH = P.path(packing.VOCAB)


def brute(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


@given(st.integers(1, 20_000))
def test_pieces(n):
    got = packing.pieces(n)
    assert [a for a, _ in got] == [sum(m for _, m in got[:i]) for i in range(len(got))]
    assert sum(m for _, m in got) == n
    assert all(m & (m - 1) == 0 and m <= 4096 for _, m in got)
    small = [m for _, m in got if m < 4096]
    assert len(set(small)) == len(small)


@settings(deadline=None)
@given(st.text(max_size=60))
def test_words_as_whole_text(text):
    b = packing.encode_texts([text], PATH)[0]
    assert [*struct.unpack(f"<{len(b) // 4}I", b), 2] == brute(text)


def test_query_against_whole_text_tokenizer(spark):
    docs = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = packing.query(spark, SF001).collect()
    seen = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        want = docs[r.doc_id]
        assert r.start == seen.get(r.doc_id, 0) and r.doc_tokens == len(want)
        seen[r.doc_id] = r.start + r.length
        part = want[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert r.offset == 0 and r.length & (r.length - 1) == 0
    assert seen == {k: len(v) for k, v in docs.items()}
    assert len({r.sequence_id for r in out}) == len(out)


def test_edge_rows(spark, scratch):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, "word\x1cword <|endoftext|> " * 3_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = packing.pack(df)
    got = out.collect()
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    want = brute(rows[3][1])
    mine = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 2), key=lambda r: r.start))
    assert mine == struct.pack(f"<{len(want)}I", *want)
    packing.write_buckets(out, f"{scratch}/packed")
    assert spark.read.parquet(f"{scratch}/packed").count() == len(got)
    assert packing.pack(df.limit(0)).count() == 0


@settings(deadline=None)
@given(st.text(alphabet="aBé'sdLl R1²½ºÀÞßÿĳŉſİ_-.…<|>\x1c\xa0́", max_size=40))
def test_latin_words_as_whole_text(text):
    b = packing.encode_texts([text], PATH)[0]
    assert [*struct.unpack(f"<{len(b) // 4}I", b), 2] == brute(text)


def test_small_stores_give_the_same_ids():
    texts = pa.array([f"word{k} Ünïcode-{k} it's {k * 7919} {'x' * (k % 90)}" for k in range(300)] * 2)
    packing._empty()
    want, at = packing.encode_column(texts, PATH)
    packing._empty()
    parts = [packing.encode_column(texts.slice(a, 50), PATH, (40, 20)) for a in range(0, 600, 50)]
    assert np.concatenate([p for p, _ in parts]).tolist() == want.tolist()
    assert sum(len(a) - 1 for _, a in parts) == len(at) - 1
    assert all(len(s.slot) <= 400 for s in packing._tokenizer(PATH)[1:3])     # a batch's own at most
    packing._empty()
