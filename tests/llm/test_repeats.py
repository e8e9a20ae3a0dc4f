import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from threatspark.llm import repeats
from threatspark.llm.suffixes import decoded, front_code, merged

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(values, length):
    """Texts -> (n_bytes, n_removed, n_spans, sha256 of the rest) by counting every window."""
    texts = [(v or "").encode() for v in values]
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            k = hash(t[i:i + length])
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[hash(t[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@given(st.lists(st.lists(st.binary(max_size=12), max_size=20).map(sorted), max_size=7))
def test_loser_tree(runs):
    coded = [front_code(r) for r in runs]
    out = list(merged([((n, s, i) for n, s in decoded(*c)) for i, c in enumerate(coded)]))
    assert [s for _, s, _ in out] == sorted(s for r in runs for s in r)
    last = b""
    for n, s, _ in out:
        want = next((i for i, (a, b) in enumerate(zip(last, s, strict=False)) if a != b), min(len(last), len(s)))
        assert n == want
        last = s


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: v for (k, _), v in zip(docs, brute([t for _, t in docs], 400), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in repeats.query(spark, sf).collect()}
    assert got == want
    assert sum(v[1] for v in want.values())


@pytest.mark.parametrize("hot", [4096, 3])
def test_edges(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeéü") for _ in range(rnd.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    parts = [text(n) for n in (5, 9, 12, 18, 25, 60)]
    rows = [None, "", "short", "a" * 3_000, "ab" * 1_000, "ab" * 1_001, parts[5], parts[5], text(4_000)]
    rows += ["x" * 59, "x" * 60, "y" * 61]
    for _ in range(80):
        rows.append(" ".join(rnd.choice([*parts, text(3), text(8)]) for _ in range(rnd.randrange(1, 7))))
    rows.append(rows[8][500:2_000] + "!" + rows[8][100:700])
    df = spark.createDataFrame([(i % 90, t, 7) for i, t in enumerate(rows)], "doc_id long, text string, n_spans int")
    out = repeats.remove_repeats(df.repartition(5), length=60).collect()
    got = sorted((r.text or "", r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)
    assert got == sorted((t or "", *v) for t, v in zip(rows, brute(rows, 60), strict=True))
    for r in out:
        b = (r.text or "").encode()
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and len(bytes(r.kept)) + r.n_removed == len(b)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_hot_block_is_dealt_over_partitions():
    """A passage with another neighbourhood in every text: its records go to several partitions."""
    rnd = random.Random(5)
    piece = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = piece(60)
    rows = pa.RecordBatch.from_pydict({"text": [piece(60) + passage + piece(60) for _ in range(40)],
                                       "text_key": pa.array(range(40), pa.int64())})
    every, none = (SimpleNamespace(value=np.full(1 << 17, x, np.uint8)) for x in (255, 0))

    def records(hot):
        out = {}
        for b in repeats._runs(60, 1 << 20, every, hot)(iter([rows])):
            for r in b.to_pylist():
                if r["part"] is not None:
                    out[r["part"]] = out.get(r["part"], 0) + len(r["ctx"]) // 8
        return out

    cold, dealt = records(none), records(every)
    assert max(cold.values()) >= 40  # a block of the passage, whole
    assert len(dealt) > len(cold) and sum(dealt.values()) > sum(cold.values())
    found = [h for t in rows.column(0).to_pylist() for h in repeats.anchors(t.encode(), 60)[1].tolist()]
    block = max(set(found), key=found.count)
    assert dealt.get(block % (1 << 20), 0) < found.count(block)


def test_untouched_rows_take_one_worker_a_task(spark):
    def chained(node, above=False):
        """Whether a MapInArrow feeds another one without a join between."""
        arrow, nodes = node.nodeName() == "MapInArrow", node.children()
        above = node.nodeName() != "Join" and (arrow or above)
        own = [nodes.apply(i) for i in range(nodes.size())]
        return any((above and n.nodeName() == "MapInArrow") or chained(n, above) for n in own)

    shared = "x" * 100 + " ".join(str(i) for i in range(200))
    values = [shared, "a" + shared, "nothing of this occurs again " * 3, None, "", shared]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    out = repeats.remove_repeats(df)
    assert not chained(out._jdf.queryExecution().optimizedPlan())
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows] == brute(values, 400)
