"""The reference's scripts as plans, end to end on small files derived from
the driver tables."""
import os

from pyspark.sql import functions as F

from threatspark import fixtures as fx
from threatspark.plans import flow as FL
from threatspark.plans import malware as MW
from threatspark.plans import phishing as PH
from conftest import SF001


def test_flow_preprocess_script(spark, scratch):
    fl = fx.flows(spark, SF001).drop("flow_ts")
    fl = fl.withColumnRenamed("label", "Label").withColumnRenamed("flow_bytes_s", "Flow Bytes/s")
    fl.write.option("header", True).csv(f"{scratch}/in")
    state = FL.run_flow_preprocess(spark, f"{scratch}/in", f"{scratch}/out",
                                   drop_low_importance=["rare_zero"])
    assert "Flow Bytes/s" in state.features
    tr = spark.read.option("header", True).csv(f"{scratch}/out/train_data")
    te = spark.read.option("header", True).csv(f"{scratch}/out/test_labels")
    full = spark.read.option("header", True).csv(f"{scratch}/out/scaled_data")
    assert tr.count() + te.count() == full.count()
    assert os.path.isdir(f"{scratch}/out/quantiles")


def test_malware_scripts(spark, scratch):
    fx.malware_attack(spark, SF001).drop("event_id").write.option("header", True) \
        .csv(f"{scratch}/attack")
    fx.malware_normal(spark, SF001).drop("event_id").write.option("header", True) \
        .csv(f"{scratch}/normal")
    important = MW.run_malware_preprocess(spark, f"{scratch}/attack", f"{scratch}/normal",
                                          f"{scratch}/out")
    processed = spark.read.option("header", True).option("inferSchema", True) \
                     .csv(f"{scratch}/out/processed_data")
    assert processed.agg(F.min("tot_bytes"), F.max("tot_bytes")).first() == (0.0, 1.0)
    feats = important or ["tot_bytes"]
    nodes = MW.run_graph_build(spark, processed, feats, f"{scratch}/nodes", chunk=50)
    assert nodes.select("chunk_id").distinct().count() == (processed.count() + 49) // 50


def test_phishing_scripts(spark):
    ph = fx.phishing(spark, SF001).where("result IS NOT NULL").select(
        "doc_id", F.col("url_length").alias("URL_Length"),
        F.col("request_url").alias("Request_URL"),
        F.col("result").cast("string").alias("Result"))
    imp = PH.rank_features(ph.drop("doc_id"))
    assert imp.count() >= 1 and set(imp.columns) == {"Feature", "Importance"}
    grid = {"n_estimators": [3], "max_depth": [2], "learning_rate": [0.1],
            "subsample": [1.0], "colsample_bytree": [1.0]}
    found, report, acc = PH.train_model(ph.drop("doc_id"), ["URL_Length", "Request_URL"],
                                      grid=grid, n_iter=1, folds=2)
    assert 0.0 <= acc <= 1.0 and report.where("class = 'accuracy'").count() == 1


def test_malware_fit_on_train(spark, scratch):
    fx.malware_attack(spark, SF001).drop("event_id").write.option("header", True) \
        .csv(f"{scratch}/attack")
    fx.malware_normal(spark, SF001).drop("event_id").write.option("header", True) \
        .csv(f"{scratch}/normal")
    MW.run_malware_preprocess(spark, f"{scratch}/attack", f"{scratch}/normal",
                              f"{scratch}/out", fit_on="train")
    processed = spark.read.option("header", True).option("inferSchema", True) \
                     .csv(f"{scratch}/out/processed_data")
    assert processed.count() == fx.malware_attack(spark, SF001).count() + \
        fx.malware_normal(spark, SF001).count()
