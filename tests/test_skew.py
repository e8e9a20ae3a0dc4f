"""A hot key (one class / one series holding most rows) is spread over tasks."""
from pyspark.sql import functions as F

from threatspark.operators import metrics as M
from threatspark.operators import sampling as S


def _max_share(df):
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_class_rank_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 20000).select(
            "id", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("y"))
        ranked = S.hash_rank(df, ["id"], 3, by=["y"])
        # the window runs on (class, bucket): the hot class (90 %) is not one task
        assert _max_share(ranked.where(F.col("rank") >= 1)) < 0.35
        # plain per-class window for comparison: one task holds the hot class
        from pyspark.sql import Window
        plain = df.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("id")))
        assert _max_share(plain.where(F.col("r") >= 1)) >= 0.9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_series_early_stop_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # run 0 holds 90 % of all epochs
        hot = spark.range(1, 18001).select(F.lit(0).alias("run"), F.col("id").alias("epoch"),
                                           (F.lit(1.0) / F.col("id")).alias("val_loss"))
        cold = spark.range(1, 2001).select((F.col("id") % 50 + 1).alias("run"),
                                           (F.floor((F.col("id") - 1) / 50) + 1).alias("epoch"),
                                           F.rand(1).alias("val_loss"))
        h = hot.unionByName(cold)
        out = M.early_stop(h, patience=5, by=["run"], block_size=1000)
        r = out.where("run = 0").first()
        assert (r["best_epoch"], r["stop_epoch"], r["stopped_early"]) == (18000, 18000, False)
        # the in-block windows run per (run, block): the hot run is split
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        blocks = h.withColumn("_blk", F.floor((F.col("epoch") - 1) / 1000)) \
                  .repartition("run", "_blk")
        assert _max_share(blocks) < 0.35
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
