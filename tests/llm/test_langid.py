import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threatspark.llm import langid

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    return langid.fit(docs)


def test_forward_sums_all_segmentations(model):
    _, ids, _, byte_ids = langid._processor(model.vocab)
    for word in ("the", "tion", "éa中", "a$b"):
        s, total = langid.MARK + word, np.zeros(len(model.langs))
        for cut in itertools.product((0, 1), repeat=len(s) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(s)]
            p = np.ones(len(model.langs))
            for a, b in itertools.pairwise(at):
                if s[a:b] in ids:
                    p = p * model.prob[ids[s[a:b]]]
                elif b - a == 1:
                    p = p * np.prod(model.prob[byte_ids[list(s[a:b].encode())]], axis=0)
                else:
                    p = p * 0
            total += p
        assert np.allclose(langid.forward([word], model)[0], np.log(total))


def test_probabilities(model):
    assert np.allclose(model.prob.sum(0), 1) and (model.prob[:-1] > 0).all()


def test_long_words_stay_finite(model):
    assert np.isfinite(langid.forward(["tion" * 5_000, "中" * 3_000], model)).all()


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    out = langid.query(spark, SF01).collect()
    assert len(out) == len(truth)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    assert right >= 0.95, right


def test_edge_rows(spark, model):
    rows = [(1, None, None, 1.0), (2, "", "en", 2.0), (3, "12 $$ --", "en", 3.0), (None, "the " * 20_000, None, 4.0),
            (5, "the of and", "en", 5.0), (5, "the of and", "en", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score double")
    out = langid.predict(df, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and all(by[k].lang_pred == "und" and by[k].lang_score == 0 for k in (1, 2, 3))
    assert by[None].lang_pred == "en" and by[5].lang_pred == "en" and math.isfinite(by[5].lang_score)
    empty = langid.fit(df.limit(0))
    assert empty.langs == [] and {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def log_sum(word, model, k):
    """log P(word) under language k over all segmentations, one position at a time in log space."""
    _, ids, longest, byte_ids = langid._processor(model.vocab)
    s, a = langid.MARK + word, [0.0]
    for j in range(1, len(s) + 1):
        terms = [a[i] + math.log(model.prob[ids[s[i:j]], k]) for i in range(max(0, j - longest), j) if s[i:j] in ids]
        if s[j - 1:j] not in ids:
            terms.append(a[j - 1] + sum(math.log(model.prob[byte_ids[x], k]) for x in s[j - 1].encode()))
        top = max(terms)
        a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return a[-1]


def test_runs_of_unseen_characters(model):
    """Runs without white space of single pieces and byte-fallback characters, none ever seen."""
    _, ids, _, _ = langid._processor(model.vocab)
    prob = np.full(model.prob.shape, 1e-15)
    prob[:, 1:] = 3e-15
    prob[-1] = 0
    prob[ids["the"]] = 0.5
    unseen = langid.LanguageModel(model.langs, model.prior, prob, model.vocab)
    piece = next(c for c in "中é国" if c in ids)
    words = [piece * n for n in (15, 33, 64, 200)] + ["\U00010348" * n for n in (8, 33, 64)] + ["the" + piece * 40 + "the"]
    got = langid.forward(words, unseen)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([log_sum(w, unseen, k) for k in range(len(model.langs))], rel=1e-9)


def test_learning_segments_words_in_bounded_calls(model, monkeypatch):
    sp, *rest = langid._processor(model.vocab)
    asked = []

    class Recorder:
        def encode(self, words, **kw):
            asked.append(len(words))
            return sp.encode(words, **kw)

        def __getattr__(self, name):
            return getattr(sp, name)

    own = [f"word{i}" for i in range(30_000)]
    rows = [(" ".join(own[:20_000]), "en"), (" ".join(own[10_000:]), "en"), (None, "en"), ("le mot", "fr")]
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [x for _, x in rows]})
    monkeypatch.setattr(langid, "_processor", lambda path: (Recorder(), *rest))
    got = {}
    for b in langid._piece_counts(model.vocab, "text", "lang")([batch]):
        got |= {(r["lang"], r["piece"]): r["n"] for r in b.to_pylist()}
    want = Counter((x, -1) for _, x in rows)
    for t, x in rows:
        want.update((x, i) for w in (t or "").split() for i in sp.encode(w))
    assert got == want
    assert max(asked) <= langid.ROWS
