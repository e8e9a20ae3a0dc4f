import random
import re

import pytest

from threatspark.llm import jaccard

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(rows, words=5, percent=80):
    """rows (id, text) -> [(id, n, component)] by an inverted index over all shingles."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    index, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in enumerate(sets):
        n = {}
        for x in s:
            for j in index.setdefault(x, []):
                n[j] = n.get(j, 0) + 1
            index[x].append(i)
        for j, c in n.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        low[r] = k if low.get(r) is None else low[r] if k is None else min(low[r], k)
    return [(k, len(sets[i]), low[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = [tuple(r) for r in jaccard.query(spark, sf).collect()]
    assert order(out) == order(brute(rows))


def test_edges_and_near_groups(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"),
            (None, "one two"), (7, " ".join(base)), (7, " ".join(base)), (7, "quite different text here " * 3),
            (8, "\x0b".join(base)), (None, "alone with a null id here"), (9, "Ünicode \x1c words Éa b c d"), (10, "a " * 20_000)]
    for i in range(60):  # near copies that link only through one another
        words = list(base)
        for k in range(i % 12):
            words[(7 * i + 11 * k) % 120] = f"x{i}.{k}"
        rows.append((100 + i, " ".join(words)))
        rows.append((200 + i, passage + " " + " ".join(f"u{i}.{k}" for k in range(i))))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    out = [tuple(r) for r in jaccard.jaccard_components(df).collect()]
    assert order(out) == order(brute(rows))
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
