import hashlib

import numpy as np
import pytest

from threatspark.llm import ballkmeans as bk
from threatspark.llm import ints

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, code string, part int"


def lloyd(rows, scale, parts, entries, rounds):
    """Full search in plain integers: {vec_id: (code, error)} and the digest."""
    rows = sorted(rows)
    x = [np.floor(np.array(v) * scale).astype(int) for _, v in rows]
    width = len(x[0]) // parts
    codes, error, text = [""] * len(x), [0] * len(x), []
    for k in range(parts):
        y = [v[k * width:(k + 1) * width] for v in x]
        book = [list(v) for v in y[:entries]]

        def nearest(v, book=book):
            return min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(book))
        for _ in range(rounds):
            at = [nearest(v)[1] for v in y]
            means = []
            for i, c in enumerate(book):
                own = [v for v, j in zip(y, at, strict=True) if i == j]
                means.append([sum(int(v[d]) for v in own) // len(own) for d in range(width)] if own else c)
            book[:] = means
        for r, v in enumerate(y):
            d, i = nearest(v)
            codes[r] += f"{i:02x}"
            error[r] += d
        text += [str(int(v)) for c in book for v in c]
    return ({k: (c, e) for (k, _), c, e in zip(rows, codes, error, strict=True)},
            hashlib.sha256(",".join(text).encode()).hexdigest())


@pytest.mark.parametrize("kind", ["plain", "grid", "far"])
def test_against_full_search(spark, monkeypatch, kind):
    monkeypatch.setattr(bk, "ROWS", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 8))
    if kind == "grid":
        x = np.round(x * 2) / 2                   # many ties and equal parts
    if kind == "far":                             # clusters: stable cores, many rings
        x = np.round(x / 10, 2) + rng.integers(0, 4, (300, 1)) * 5
    x[100:200] = x[7]                             # one vector in a third of the rows
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(300) - 20, x, strict=True)]
    df = spark.createDataFrame([(k, v, k % 3 if k % 5 else None, "z", 1) for k, v in rows], SCHEMA).repartition(5)
    got = bk.coded(df, scale=16, parts=4, entries=20, rounds=4).collect()
    want, digest = lloyd(rows, 16, 4, 20, 4)
    assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == 300
    assert {r.codebooks_sha256 for r in got} == {digest}
    of = {k: k % 3 if k % 5 else None for k, _ in rows}
    for r in got:
        assert r.label_error == sum(e for k, (_, e) in want.items() if of[k] == of[r.vec_id])


def test_rings_and_cores_save_distances(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 10, (16, 8))
    x = centres[np.arange(2_000) % 16] + rng.normal(0, 0.1, (2_000, 8))
    df = spark.createDataFrame([(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)], SCHEMA)
    _, books = bk.fit_codes(df, entries=16)
    full = 2_000 * 16 * 4
    assert books.work[0] == full and books.work[1] < full / 8 and books.work[-1] == 0


def test_odd_rows(spark):
    v = [1.0, -0.5, 0.25, 2.0]
    rows = [(5, v, 1, "a", 1), (5, v, 1, "a", 1), (None, v, None, None, None), (1, [0.0] * 4, 2, "a", 0), (2, None, 1, "", 0),
            (3, [1.0, None, 0.0, 0.0], 1, "", 0), (4, [1.0, NAN, 0.0, 0.0], 1, "", 0), (6, [INF, 0.0, 0.0, 0.0], 1, "", 0),
            (7, [], 1, "", 0), (8, [1.0], 1, "", 0), (9, [1e300, -1e300, 0.0, 0.0], 3, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = bk.coded(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 5), (False, 5), (False, 9), (True, 0)]
    assert {r.error for r in got} == {0} and len({r.code for r in got if r.vec_id == 5}) == 1
    assert bk.coded(df.limit(0)).count() == 0
    assert bk.coded(df.filter("embedding is null")).count() == 0
    with pytest.raises(ValueError):
        bk.coded(df.filter("vec_id = 8"))
    with pytest.raises(ValueError):
        bk.fit_codes(df, entries=300)


def test_exact_integers_beyond_doubles():
    a = np.array([[2**27, 3], [-(2**27), 5]])
    b = np.array([[2**27 - 1, 4], [7, 2**27]])
    want = [[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in b] for u in a]
    assert ints.products(a, b).tolist() == want
    want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(u, v, strict=True)) for v in b] for u in a]
    assert ints.distances(a, b).tolist() == want
    assert ints.distances(a, b[:0]).shape == (2, 0)
