import zlib

import pytest
from pyspark.sql import functions as F

from threatspark.llm import shards
from threatspark.llm.shards import Leaf

SF001 = "/root/testdata/sf0.001"


def where(df, leaves):
    return {r.k: r.shard for r in shards.placed(df, ["k"], leaves).select("k", "shard").collect()}


def test_query_against_the_table(spark):
    got = shards.query(spark, SF001).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in docs.items()}
    assert len(got) == len(docs) and {r.law for r in got} == {"key"}
    assert all(r.grown_shard in (r.shard, shards.SHARDS) for r in got) and any(r.grown_shard != r.shard for r in got)
    for s in range(shards.SHARDS):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    again = shards.query(spark.newSession(), SF001).repartition(3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_weights_are_kept(spark):
    df = spark.range(40_000).select(F.col("id").alias("k"))
    tree = [Leaf("a", "x", 0, 1), Leaf("a", "y", 1, 3), Leaf("b", "x", 2, 4), Leaf("b", "x", 3, 0)]
    n = shards.placed(df, ["k"], tree).groupBy("shard").count().collect()
    n = {r.shard: r["count"] for r in n}
    assert n[0] == pytest.approx(5_000, rel=0.06) and n[1] == pytest.approx(15_000, rel=0.04)
    assert n[2] == pytest.approx(20_000, rel=0.03) and 3 not in n


def test_movement_stays_in_changed_subtrees(spark):
    df = spark.range(6_000).select(F.col("id").alias("k"))
    tree = shards.uniform_tree(8)                      # regions 0-3 and 4-7, racks of two
    old = where(df, tree)
    new = where(df, [Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in tree])
    moved = [(old[k], new[k]) for k in old if old[k] != new[k]]
    assert moved
    for a, b in moved:
        assert b // 4 == 1                             # into the heavier region, or inside it
        assert a // 4 == 0 or b // 2 == 2              # inside it: into the heavier rack, or inside that
        assert a // 2 != 2 or b == 5
    grown = where(df, shards.with_shard(tree, 8))
    assert all(grown[k] in (old[k], 8) for k in old)
    assert sum(grown[k] == 8 for k in old) == pytest.approx(6_000 / 9, rel=0.15)
    fewer = where(df, [x for x in tree if x.shard != 6])
    for a, b in [(old[k], fewer[k]) for k in old if old[k] != fewer[k]]:
        assert a // 4 == 1                             # out of the lighter region, or inside it
        assert b // 4 == 0 or a // 2 == 3              # inside it: out of the lighter rack
        assert a == 6 or b != 7 or a // 2 == 3


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(shards, "CHUNK", 3)
    schema = "k long, shard string, draw double, _n int"    # names that clash with internal ones
    rows = [(None, "", 1.0, 1)] * 8 + [(1, None, None, None)] * 4 + [(2, "x", 0.0, 2), (2, "y", 0.0, 2)]
    df = spark.createDataFrame(rows, schema).select("k", F.col("_n").alias("n"))
    got = shards.slotted(shards.placed(df, ["k"], shards.uniform_tree())).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.k == 2}) == 1
    assert shards.slotted(shards.placed(df.limit(0), ["k"], shards.uniform_tree())).count() == 0
    for bad in ([], [Leaf("a", "b", 0, 0.0)], [Leaf("a", "b", 0, -1.0)]):
        with pytest.raises(ValueError):
            shards.shard_of(F.lit("x"), bad)
    with pytest.raises(ValueError):
        shards.with_shard(shards.uniform_tree(), 3)
