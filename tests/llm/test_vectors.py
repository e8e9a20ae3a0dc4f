import numpy as np
import pytest

from threatspark.llm import ann, itq, neardup

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    return rows, x / np.sqrt((x * x).sum(1))[:, None]


def test_codes_are_balanced(spark):
    rotation, x = itq.fit(spark.read.parquet(f"{SF01}/embeddings.parquet"), "vec_id", "embedding")
    bits = np.unpackbits(rotation.codes(x).view(np.uint8).reshape(-1, 8), axis=1)
    assert (abs(bits.mean(0) - 0.5) < 0.2).all()


def test_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**63, 3_000).astype(np.uint64)
    codes[:300] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    index = ann.BlockIndex(codes)
    for r in (0, 3, 8, 21, 28, 64):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[5]) <= r)
        assert (index.within(codes[5], r) == want).all()


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_search_recall(spark, sf):
    rows, u = table(spark, sf)
    ids = np.array([r.vec_id for r in rows])
    out = {}
    for r in ann.query(spark, sf).collect():
        out.setdefault(r.query_id, []).append(r)
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(out) == sorted(asked)
    hits = 0
    for q in asked:
        k = int(np.flatnonzero(ids == q)[0])
        cos = u @ u[k]
        cos[k] = -2
        want = ids[np.lexsort((ids, -cos))[:5]]
        got = sorted(out[q], key=lambda r: r.rank)
        assert [r.rank for r in got] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in got)
        for r in got:
            assert r.score == pytest.approx(cos[ids == r.vec_id][0], abs=1e-12)
        hits += len(set(want) & {r.vec_id for r in got})
    assert hits / (5 * len(asked)) >= 0.9


def odd_rows():
    v = [1.0, 2.0, 3.0, 4.0]
    return [(0, v, 1), (1, [2.0, 4.0, 6.0, 8.0], 1), (2, v, 1), (2, v, 1), (3, None, 1), (4, [0.0] * 4, 1),
            (5, [1.0, None, 3.0, 4.0], 1), (6, [1.0, NAN, 3.0, 4.0], 1), (7, [1.0, INF, 3.0, 4.0], 1), (8, v, None),
            (9, v, 2), (None, v, 1), (10, [-1.0, 0.5, 0.0, 0.1], 1), (11, [1.0, 2.0], 1), (12, [], 1)]


def test_search_edges(spark):
    df = spark.createDataFrame(odd_rows(), "vec_id long, embedding array<double>, label int")
    out = ann.search(df, df.filter("vec_id in (0, 2, 3, 4, 10)"), k=5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 2, 8, 9], 2: [0, 1, 8, 9, 10], 10: [0, 1, 2, 2, 8]}
    assert ann.search(df, df.filter("vec_id = 0"), k=50).count() == 6
    assert ann.search(df.limit(0), df).count() == 0
    assert ann.search(df, df.limit(0)).count() == 0


def test_neardup_query(spark):
    out = neardup.query(spark, SF01).collect()
    assert len(out) == spark.read.parquet(f"{SF01}/embeddings.parquet").count()
    assert all(r.n_links == 0 and r.kept for r in out)  # this table has no near copies


def test_neardup_against_all_pairs(spark):
    """The given rows and noisy copies of some, chains among them, against all pairs."""
    given, u = table(spark, SF01)
    rng = np.random.default_rng(2)
    rows = [(r.vec_id, x.tolist(), r.label) for r, x in zip(given, u, strict=True)]
    for i in range(0, 500, 4):
        x = u[i]
        for _ in range(rng.integers(1, 9)):
            x = (x if rng.random() < 0.5 else u[i]) + rng.normal(0, rng.choice([0.005, 0.02, 0.045]), 64)
            rows.append((1_000 + len(rows), x.tolist(), rows[i][2] if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids = np.array([r[0] for r in rows])
    lab = np.array([-1 if r[2] is None else r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :]) & (lab >= 0)[:, None]
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        low = np.minimum(comp, np.where(link, comp[None, :], 2**60).min(1))
        if (low == comp).all():
            break
        comp = low
    out = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    assert len(out) == len(ids) and link.sum() > 500
    assert all(out[i].n_links <= n for i, n in zip(ids, link.sum(1), strict=True))
    assert sum(r.n_links for r in out.values()) >= 0.98 * link.sum()
    assert sum(out[i].component_id == c for i, c in zip(ids, comp, strict=True)) >= 0.98 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_neardup_edges(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 2)
    df = spark.createDataFrame(odd_rows(), "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id if r.vec_id is not None else -1), r.n_links, r.component_id, r.kept)
                 for r in neardup.near_duplicates(df).collect())
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted([(0, 4, 0, True), (1, 4, 0, False), (2, 4, 0, False), (2, 4, 0, False), (-1, 4, 0, False), *alone])
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert {r.n_links for r in neardup.near_duplicates(df.filter("embedding is null")).collect()} == {0}


@pytest.mark.parametrize("share", [0.0, 0.4, 0.6])
def test_neardup_near_the_threshold(spark, share):
    """Pairs at cosine 0.93 to 0.95 among vectors of which a common direction makes a share of the squared norm."""
    rng = np.random.default_rng(9)
    dim, n = 48, 700
    common = np.zeros(dim)
    common[0] = 1
    x = rng.normal(0, 1, (n, dim))
    x = np.sqrt(share) * common + np.sqrt(1 - share) * x / np.sqrt((x * x).sum(1))[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    side = rng.normal(0, 1, (n, dim))
    side -= (side * x).sum(1)[:, None] * x
    cos = rng.uniform(0.9301, 0.95, n)[:, None]
    y = cos * x + np.sqrt(1 - cos * cos) * side / np.sqrt((side * side).sum(1))[:, None]
    both = np.vstack([x, y])
    want = np.triu(both @ both.T >= 0.93, 1).sum()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in neardup.near_duplicates(df).collect()) / 2
    assert want >= n and 0.98 * want <= found <= want


def test_neardup_of_equal_vectors(spark, monkeypatch):
    """One vector in a third of the rows is one member; names that clash with internal ones do no harm."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (60, 16))
    x[20:40] = x[3]
    x[40] = x[3] + 1e-3
    rows = [(100 - i, v.tolist(), "l", 0, 1, "z") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, uid int, n int, vec string")
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    same = [100 - i for i in (3, *range(20, 41))]
    assert all(got[k].n_links == 21 and got[k].component_id == min(same) for k in same)
    assert sum(r.kept for r in got.values()) == 60 - 21


def test_sample_skips_invalid_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 2 else [float("nan")] * 3, 1) for i in range(200)] + [(500, [1.0, 2.0, 3.0], 1), (501, [1.0, 2.0, 3.0], 1)],
                               "vec_id long, embedding array<double>, label int")
    x = itq.sample_vectors(df, "vec_id", "embedding", sample=2)
    assert len(x) == 2
    assert {r.vec_id for r in neardup.near_duplicates(df).collect() if r.n_links} == {500, 501}
