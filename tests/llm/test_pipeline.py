import struct
import zlib

import corpus_pipeline as pipeline
from test_jaccard import brute as brute_jaccard
from test_packing import brute as brute_ids
from threatspark.llm import langid, packing

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, kept string, c1 int"


def cut(values, length=400):
    """Texts without bytes under a repeated window."""
    texts = [v.encode() for v in values]
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[hash(t[i:i + length])] = count.get(hash(t[i:i + length]), 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[hash(t[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.fit(docs)
    good = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.lang_score >= 0.5}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    assert len(rows) > 0.9 * docs.count()
    kept = {k for k, _, c in brute_jaccard(rows) if k == c}
    rows = [(k, t) for k, t in rows if k in kept]
    texts = cut([t for _, t in rows])
    want = {k: brute_ids(t.decode("utf-8", "replace")) for (k, _), t in zip(rows, texts, strict=True)}
    seen = {}
    for r in sorted(pipeline.run(spark, SF01).collect(), key=lambda r: (r.doc_id, r.start)):
        part = want[r.doc_id][r.start:r.start + r.length]
        assert r.start == seen.get(r.doc_id, 0) and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        seen[r.doc_id] = r.start + r.length
    assert seen == {k: len(v) for k, v in want.items()}


def test_stages_on_odd_rows(spark):
    word = lambda i: f"the word{i} of and"
    long = " ".join(word(i) for i in range(200))
    texts = [(1, None), (2, ""), (3, "12 -- 34"), (4, long), (4, long), (5, long), (None, long), (6, "the other of the and"),
             (6, "a different text under the same id"), (None, "nothing else is the same as this"),
             (None, "nothing else is the same as this"), (7, "é" * 10 + long[:900] + " and more of the rest " + "é" * 300),
             (8, "a " * 30_000 + " the end of this")]
    rows = [(k, t, None if i % 5 == 4 else "en", "s", len(t or ""), "x", "y", i) for i, (k, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.unionByName(spark.createDataFrame([(50, "le la des et une les", "fr", "s", 5, "x", "y", 0)], SCHEMA))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF01).cache()
        n = out.count()
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        got = sorted(((r.doc_id if r.doc_id is not None else -1) for r in out.select("doc_id").collect()))
        if name == "language_id":
            assert got == [-1, -1, -1, 4, 4, 5, 6, 6, 7, 8, 50]
        if name == "ngram_jaccard":
            assert got == [-1, 4, 6, 6, 7, 8, 50]
        if name == "suffix_dedup":
            by = {r.doc_id: r for r in out.collect()}
            assert len(by[7].text) < 700 and by[7].n_chars == len(by[7].text) and by[4].n_chars < len(long)
        empty = stage(spark, docs.limit(0), SF01)
        assert empty.count() == 0 and n
        docs = out if name != "packing" else docs
    assert out.agg({"length": "sum"}).first()[0] == sum(
        len(packing.encode_texts([r.text], packing.public_tokenizers.path(packing.VOCAB))[0]) // 4 + 1 for r in docs.collect())
