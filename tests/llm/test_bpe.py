import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from threatspark.llm import bpe

PATH = P.path(bpe.RANKS)
SF001 = "/root/testdata/sf0.001"


LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))})


@pytest.fixture(scope="module")
def enc():
    return LIBRARY


def ids(text):
    b = bpe.encode_text(text, PATH)
    return list(struct.unpack(f"<{len(b) // 4}I", b))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aab the\n'st", max_size=300))
def test_same_as_tiktoken(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert bpe.decode_ids(bpe.encode_text(text, PATH), PATH) == text.encode()


def test_very_long_pretokens(enc):
    for text in ("a" * 30_000, "abcab" * 9_000, "thethe" * 3_000, "é" * 7_000, " " * 5_000, "!?" * 4_000):
        assert ids(text) == enc.encode_ordinary(text)


def test_edge_rows(spark, enc):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hi  there\n\n", None), (3, "Hi  there\n\n", None), (None, "a" * 70_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df)).collect()
    assert len(out) == 5
    for r, (i, text, _) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id, r.text or "")),
                               sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")), strict=True):
        want = enc.encode_ordinary(text or "")
        assert r.n_tokens == len(want) and bytes(r.ids) == struct.pack(f"<{len(want)}I", *want)
        assert bytes(r.decoded) == (text or "").encode()
    assert bpe.encode(df.limit(0)).count() == 0


def test_query_against_tiktoken(spark, enc):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = bpe.query(spark, SF001).collect()
    assert len(out) == len(docs)
    for r in out:
        want = enc.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
