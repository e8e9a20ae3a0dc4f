import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threatspark import fixtures as fx
from threatspark.operators import sampling as S
from conftest import SF001


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_hash_rank_equals_plain_row_number(spark):
    fl = fx.flows(spark, SF001).select(*fx.FLOW_KEY, "label")
    got = S.hash_rank(fl, fx.FLOW_KEY, 7, by=["label"], out="rk")
    w = Window.partitionBy("label").orderBy(S.hash_key(7, fx.FLOW_KEY), *fx.FLOW_KEY)
    exp = fl.withColumn("rk", F.row_number().over(w).cast("bigint"))
    assert _rows(got, *fx.FLOW_KEY, "rk") == _rows(exp, *fx.FLOW_KEY, "rk")


def test_rank_is_dense_and_unchanged_by_partitioning(spark):
    fl = fx.flows(spark, SF001).select(*fx.FLOW_KEY)
    a = _rows(S.hash_rank(fl, fx.FLOW_KEY, 3, hex_digits=2), *fx.FLOW_KEY, "rank")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = _rows(S.hash_rank(fl.repartition(5), fx.FLOW_KEY, 3, hex_digits=2),
                  *fx.FLOW_KEY, "rank")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
    assert sorted(r[-1] for r in a) == list(range(1, len(a) + 1))


def test_undersample_sizes(spark):
    df = spark.range(0, 1000).select(F.col("id"), F.when(F.col("id") % 4 == 0, "min")
                                     .otherwise("maj").alias("y"))
    out = S.undersample(df, "y", ["id"], ratio=0.85, seed=10)
    counts = {r[0]: r[1] for r in out.groupBy("y").count().collect()}
    assert counts == {"min": 250, "maj": math.floor(250 / 0.85)}
    with pytest.raises(ValueError):
        S.undersample(df, "y", ["id"], ratio=0.2)


def test_train_test_sizes_and_cover(spark):
    df = spark.range(0, 101)
    tt = S.train_test(df, ["id"], 10, train=0.7)
    assert tt.where("is_train").count() == 70 and tt.count() == 101
    t2 = S.train_test(df, ["id"], 42, test=0.2)
    assert t2.where("NOT is_train").count() == 21      # ceil(0.2 * 101)
    assert tt.select("id").distinct().count() == 101


def test_stratified_folds_balanced(spark):
    df = spark.range(0, 503).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    f = S.stratified_folds(df, "y", ["id"], 5, seed=42)
    sizes = f.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        s = [r[2] for r in sizes if r[0] == y]
        assert len(s) == 5 and max(s) - min(s) <= 1


def test_chunk_masks(spark):
    df = spark.range(0, 130).withColumn("chunk_id", F.floor(F.col("id") / 50))
    m = S.chunk_masks(df, "chunk_id", ["id"], 0.8, seed=1)
    got = {r[0]: r[1] for r in m.where("is_train").groupBy("chunk_id").count().collect()}
    assert got == {0: 40, 1: 40, 2: 24}


def test_shuffle_and_tail_split(spark):
    df = spark.range(0, 50)
    s = S.shuffle(df, ["id"], 42)
    assert sorted(r[0] for r in s.select("pos").collect()) == list(range(1, 51))
    t = S.tail_split(s, "pos", 0.2)
    assert t.where("is_validation").count() == 10


def test_smallest_hash_sample_is_exact(spark):
    df = spark.range(0, 500)
    a = {r[0] for r in S.smallest_hash_sample(df, ["id"], 10, 37).collect()}
    ranked = S.hash_rank(df, ["id"], 10)
    b = {r[0] for r in ranked.where("rank <= 37").select("id").collect()}
    assert a == b and len(a) == 37


def test_with_chunk(spark):
    df = spark.range(0, 25)
    got = {r[0]: r[1] for r in S.with_chunk(df, "id", 10).collect()}
    assert got[9] == 0 and got[10] == 1 and got[24] == 2


def test_ordered_rank_matches_row_number(spark):
    df = spark.range(0, 700).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).alias("t"),
                                    F.col("id"))
    got = S.ordered_rank(df, ["g"], ["t", "id"], [F.floor(F.col("t") / 10)], out="pos")
    w = Window.partitionBy("g").orderBy("t", "id")
    exp = df.withColumn("pos", F.row_number().over(w).cast("bigint"))
    assert _rows(got, "g", "id", "pos") == _rows(exp, "g", "id", "pos")


def test_smallest_hash_sample_retry_is_exact(spark):
    df = spark.range(0, 500)
    exp = {r[0] for r in S.hash_rank(df, ["id"], 4).where("rank <= 37").select("id").collect()}
    # an overstated row count makes the first threshold far too tight
    got = S.smallest_hash_sample(df, ["id"], 4, 37, n_rows=50_000)
    assert {r[0] for r in got.collect()} == exp
    got.unpersist()
    small = S.smallest_hash_sample(spark.range(0, 5), ["id"], 4, 37)
    assert small.count() == 5


def test_rank_with_more_hex_digits(spark):
    df = spark.range(0, 300)
    a = _rows(S.hash_rank(df, ["id"], 9, hex_digits=8), "id", "rank")
    b = _rows(S.hash_rank(df, ["id"], 9, hex_digits=4), "id", "rank")
    assert a == b
    assert S.rank_hex_digits(10**12) == 5 and S.rank_hex_digits(100) == 4
