import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.llm import negatives as ng

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, lab string, w int"


def mined(rows, is_anchor, scale=256, positives=5, negatives=3):
    """All scores in plain integers."""
    rows = [(k, [int(np.floor(c * scale)) for c in v], y) for k, v, y in rows]
    out = []
    for a, (ka, va, ya) in enumerate(rows):
        if not is_anchor(ka):
            continue
        scores = [(-sum(p * q for p, q in zip(va, v, strict=True)), k, y) for b, (k, v, y) in enumerate(rows) if b != a]
        for s, k, _ in sorted(t for t in scores if t[2] == ya)[:positives]:
            fit = sorted(t for t in scores if t[2] != ya and 50 * -s <= 100 * -t[0] <= 95 * -s)
            out += [(ka, k, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit[:negatives])]
    return sorted(out)


def result(df, **how):
    out, index = ng.mine(df, F.col("vec_id") % 7 == 0, **how)
    return sorted(map(tuple, out.collect())), index


@pytest.mark.parametrize("kind", ["plain", "grid", "clusters"])
def test_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(ng, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ng, "CHUNK_ROWS", 8)
    monkeypatch.setattr(ng, "FIRST_CELLS", 3)
    monkeypatch.setattr(ng, "GROWTH", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (240, 9))
    label = rng.integers(0, 4, 240)
    if kind == "grid":
        x = np.round(x)                           # many ties, zero vectors among them
        x[80:160], label[80:130] = x[7], 2        # one vector in a third of the rows
    if kind == "clusters":
        x = x / 20 + rng.normal(0, 3, (12, 9))[np.arange(240) % 12]
        label = (np.arange(240) % 12) // 3
    rows = [(int(k), v.tolist(), int(y)) for k, v, y in zip(rng.permutation(240) - 10, x, label, strict=True)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).repartition(4)
    got, index = result(df, entries=20 if kind == "clusters" else 6)
    want = mined(rows, lambda k: k % 7 == 0)
    assert got == want and want
    if kind == "clusters":                        # certified windows leave cells unvisited
        assert all(seen < 0.6 * most for seen, most in index.visited), index.visited


def test_cells_come_by_falling_bounds_that_hold():
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (300, 7))
    books = ng.fit(x, 5)
    at, radii = [], []
    for h, book in zip(ng.halves(x.astype(float)), books, strict=True):
        d = np.sqrt(((h[:, None, :] - book[None]) ** 2).sum(2))
        at.append(d.argmin(1))
        radii.append(np.array([d[at[-1] == i, i].max(initial=-1) for i in range(len(book))]))
    cells = list(ng.Bounds(x[0], books, radii).cells())
    assert len({c[:2] for c in cells}) == len(cells) == (radii[0] >= 0).sum() * (radii[1] >= 0).sum()
    assert [c[2] for c in cells] == sorted((c[2] for c in cells), reverse=True)
    for i, j, high, low in cells:
        s = x[(at[0] == i) & (at[1] == j)] @ x[0]
        assert (s <= high).all() and (s >= low).all()


def test_odd_rows(spark):
    v, u = [1.0, 1.0, 0.5], [0.8, 0.7, 0.5]
    rows = [(0, v, 1), (0, v, 1), (1, v, 1), (2, u, 2), (2, u, 2), (3, u, 1), (7, u, 2), (14, [0.0] * 3, 1)]
    odd = [(None, v, 1), (21, v, None), (28, None, 1), (35, [], 1), (42, [1.0, None, 0.0], 1), (49, [NAN, 0.0, 0.0], 1),
           (56, [INF, 0.0, 0.0], 1), (63, [1.0], 1)]
    df = spark.createDataFrame([(*r, None, None) for r in rows + odd], SCHEMA)
    got, _ = result(df)
    assert got == mined(rows, lambda k: k % 7 == 0)
    text = df.withColumn("label", F.concat(F.lit("t"), F.col("label").cast("string")))
    assert result(text)[0] == got
    assert result(df.limit(0))[0] == [] and result(df.filter("label is null or embedding is null"))[0] == []
    assert result(df.filter("vec_id = 49"))[0] == [] and result(df.filter("vec_id = 1"))[0] == []


def test_large_components_stay_exact(spark):
    big = 400_000.0                               # products beyond the integers that doubles hold
    rows = [(k, [big * 200 + k, big * 199 - k, 3.0 * k], k % 2) for k in range(24)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert result(df, scale=1)[0] == mined(rows, lambda k: k % 7 == 0, scale=1)
