import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.llm import lm

SF01 = "/root/testdata/sf0.01"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(rows):
    """rows (text, train) -> [(n_tokens, n_known, N, base score)]"""
    c = Counter(t for text, train in rows if train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(len(w := tokens(text)), sum(c[t] > 0 for t in w), n,
             sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)) for text, _ in rows]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = [(t, zlib.crc32(str(k).encode()) % 7 != 2) for k, t in docs.items()]
    want = dict(zip(docs, base(rows), strict=True))
    out = lm.query(spark, SF01).collect()
    assert len(out) == len(docs)
    for r in out:
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(score, rel=1e-9) and r.score <= 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the contexts help on held-out text


def reference_score(tree, number, counts, text):
    """One token at a time, with plain dictionaries."""
    size, out, seq = len(tree.words), 0.0, tokens(text)
    nodes = [dict(zip(c.tolist(), r.tolist(), strict=True)) for c, r in zip(tree.ctx, tree.rest, strict=True)]
    probs = [dict(zip(k.tolist(), p.tolist(), strict=True)) for k, p in zip(tree.keys, tree.prob, strict=True)]
    for i, t in enumerate(seq):
        p = (counts[t] + 1) / (tree.total + tree.vocabulary + 1)
        one = tree.end if i == 0 else number(seq[i - 1])
        two = -1 if i == 0 else tree.end if i == 1 else number(seq[i - 2])
        for d, ctx in enumerate((one, two * size + one if one >= 0 and two >= 0 else -1)):
            if ctx in nodes[d] and ctx >= 0:
                p = p * nodes[d][ctx] + (probs[d].get(ctx * (size + 1) + number(t), 0) if number(t) >= 0 else 0)
        out += math.log10(p)
    return out


def test_scores_and_distributions(spark):
    from xxhash import xxh3_64_intdigest
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    out = {r.doc_id: r for r in lm.fit_and_score(df, F.col("doc_id") % 3 != 0, out=got).collect()}
    tree = got[0]
    assert len(tree.ctx) == 2 and len(tree.ctx[0]) > 5
    counts = Counter(t for k, text in rows if k % 3 for t in tokens(text))
    place = {int(h): i for i, h in enumerate(tree.words)}
    number = lambda t: place.get(xxh3_64_intdigest((t or "").encode()), -1)
    for k, text in rows[:60]:
        assert out[k].score == pytest.approx(reference_score(tree, number, counts, text), rel=1e-9)
    for d in range(2):  # kept shares and the parent's weight make one
        at = np.searchsorted(tree.ctx[d], tree.keys[d] // (len(tree.words) + 1))
        assert np.allclose(np.bincount(at, tree.prob[d], len(tree.ctx[d])) + tree.rest[d], 1)
        assert (tree.rest[d] > 0).all()


def test_edges(spark):
    rows = [(1, None, True), (2, "", True), (3, "The cat\x0b THE\x1cx", True), (3, "The cat\x0b THE\x1cx", True),
            (None, "the dog", None), (5, "the " * 50_000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    out = lm.fit_and_score(df, F.col("train")).collect()
    key = lambda r: (r[0], r[1], round(r[2], 6))
    want = base([(t, bool(f)) for _, t, f in rows])
    assert sorted(key((r.n_tokens, r.n_known, r.base_score)) for r in out) == sorted(key((w[0], w[1], w[3])) for w in want)
    none = lm.fit_and_score(df, F.lit(False)).collect()
    assert len(none) == 6 and all(r.train_tokens == 0 and r.score == r.base_score == 0 for r in none)
    assert lm.fit_and_score(df.limit(0), F.col("train")).count() == 0


def test_rare_phrase_in_a_large_table(spark):
    """What occurs five times is learnt however many other tokens there are."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 2_000)), True) for i in range(60)]
    rows += [(100 + i, "zig zag zug zog", True) for i in range(5)] + [(200, "zig zag zug zog", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = []
    out = {r.doc_id: r for r in lm.fit_and_score(df.repartition(3), F.col("train"), out=got).collect()}
    # each of the last tokens has probability (5 - 0.75) / 5 at least in its context
    assert out[200].train_tokens > 120_000 and out[200].base_score < -20 and out[200].score > -6
    tree = got[0]
    number = {int(h): i for i, h in enumerate(tree.words)}
    counts = Counter(t for _, text, train in rows if train for t in tokens(text))
    from xxhash import xxh3_64_intdigest
    want = reference_score(tree, lambda t: number.get(xxh3_64_intdigest((t or "").encode()), -1), counts, rows[-1][1])
    assert out[200].score == pytest.approx(want, rel=1e-9)


def grown(rows):
    """The tree by the rules alone, with plain dictionaries: ({context: (rest, {symbol: share})}, {contexts near the edge of the test})."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for text, train in rows:
        if train:
            seq = tokens(text)
            for i, t in enumerate(seq):
                c1[t] += 1
                c2[seq[i - 1] if i else None, t] += 1
                if i > 1:
                    c3[seq[i - 2], seq[i - 1], t] += 1
    n, v = sum(c1.values()), len(c1)
    nodes, edge = {}, set()

    def above(ctx, t):
        """The distribution of the next shorter context that is a node, or the root."""
        p = (c1[t] + 1) / (n + v + 1)
        for k in range(1, len(ctx) + 1):
            got = nodes.get(ctx[len(ctx) - k:])
            if got:
                p = p * got[0] + got[1].get(t, 0)
        return p

    def tested(ctx, total, symbols):
        kl, low, seen = 0.0, 0.0, sum(symbols.values())
        for t, k in symbols.items():
            q = above(ctx[1:], t)
            kl += k / total * math.log(k / total / q)
            low += q
        if total > seen:
            kl += (total - seen) / total * math.log((total - seen) / total / max(1 - low, 1e-12))
        cost = 0.5 * len(symbols) * math.log(max(total, 2))
        if abs(total * kl - cost) < 1e-3 * cost:
            edge.add(ctx)
        if total * kl > cost:
            return (total - seen + lm.DISCOUNT * len(symbols)) / total, {t: (k - lm.DISCOUNT) / total for t, k in symbols.items()}
        return None
    for depth, counts in ((1, c2), (2, c3)):
        found = {}
        for key, k in counts.items():
            if k >= 2 and (depth == 1 or c2[key[1:]] >= 2):
                found.setdefault(key[:-1], {})[key[-1]] = k
        for ctx, symbols in found.items():
            total = c1[ctx[0]] if depth == 1 else c2[ctx]
            got = tested(ctx, total, symbols) if total >= 2 else None
            if got:
                nodes[ctx] = got
    return nodes, edge, above


def test_tree_against_brute_force(spark):
    from xxhash import xxh3_64_intdigest
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(150).collect()
    rows = [(r.doc_id, r.text) for r in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    out = {r.doc_id: r for r in lm.fit_and_score(df.repartition(4), F.col("doc_id") % 3 != 0, out=got).collect()}
    nodes, edge, above = grown([(t, k % 3 != 0) for k, t in rows])
    tree = got[0]
    place = {int(h): i for i, h in enumerate(tree.words)}
    number = lambda t: place.get(xxh3_64_intdigest((t or "").encode()), -1)
    for d in (1, 2):
        want = {number(c[0]) if d == 1 else number(c[0]) * len(tree.words) + number(c[1]): c for c in nodes if len(c) == d}
        have = set(tree.ctx[d - 1].tolist())
        assert len(want) > 20 and {c for k, c in want.items() if k not in have} <= edge
        sure = [k for k in have if k in want]
        assert len(have) - len(sure) <= len(edge)
        rest = dict(zip(tree.ctx[d - 1].tolist(), tree.rest[d - 1].tolist(), strict=True))
        assert all(rest[k] == pytest.approx(nodes[want[k]][0]) for k in sure)
    if not edge:
        for k, text in rows:
            seq = tokens(text)
            score = sum(math.log10(above(tuple(seq[max(0, i - 2):i]) if i > 1 else (seq[0],) if i else (None,), t)) for i, t in enumerate(seq))
            assert out[k].score == pytest.approx(score, rel=1e-9)
