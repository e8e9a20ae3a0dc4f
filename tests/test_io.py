import json
import os

import pytest
from pyspark.sql import functions as F

from threatspark.sources import readers as R
from threatspark.sources.arff import read_arff


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_flows_csv_inference(spark, scratch):
    p = _write(f"{scratch}/flows/a.csv",
               "Flow ID,Flow Bytes/s,Label\n1,Infinity,BENIGN\n2,NaN,DDoS\n3,,BENIGN\n")
    df = R.read_flows(spark, p)
    assert dict(df.dtypes)["Flow Bytes/s"] == "double"
    vals = [r[0] for r in df.orderBy("Flow ID").select("Flow Bytes/s").collect()]
    assert vals[0] == float("inf") and vals[1] != vals[1] and vals[2] is None


def test_read_headerless(spark, scratch):
    p = _write(f"{scratch}/h/a.csv", "1,2\n3,4\n")
    assert R.read_headerless(spark, p).columns == ["_c0", "_c1"]


def test_read_two_class_missing(spark, scratch):
    p = _write(f"{scratch}/m/attack.csv", "a,b\n1,2\n")
    with pytest.raises(FileNotFoundError):
        R.read_two_class(spark, p, f"{scratch}/m/normal.csv")
    q = _write(f"{scratch}/m/normal.csv", "a,b,c\n3,4,5\n")
    a, n = R.read_two_class(spark, p, q)
    assert a.count() == 1 and n.columns == ["a", "b", "c"]


def test_features_roundtrip(spark, scratch):
    names = ["Flow Bytes/s", "Down/Up Ratio", "b", "a"]
    R.save_features(spark, names, f"{scratch}/feat")
    assert R.load_features(spark, f"{scratch}/feat") == names
    txt = _write(f"{scratch}/names.txt", "\n".join(names) + "\n")
    assert R.load_features(spark, txt) == names


def test_arff(spark, scratch):
    p = _write(f"{scratch}/p.arff", """% comment
@relation phishing
@attribute having_IP_Address { -1,1 }
@attribute URL_Length { 1,0,-1 }
@attribute score numeric
@attribute Result { -1,1 }
@data
-1,1,0.5,-1
1,-1,?,1
""")
    df = read_arff(spark, p)
    assert df.columns == ["having_IP_Address", "URL_Length", "score", "Result"]
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("-1", "1", 0.5, "-1"), ("1", "-1", None, "1")]


def test_requests_and_scores_sink(spark, scratch):
    p = _write(f"{scratch}/req/r.json",
               json.dumps({"row_id": 1, "x": 0.5}) + "\n" + "{bad json\n"
               + json.dumps({"row_id": 2, "x": 0.7}) + "\n")
    df = R.read_requests(spark, p, "row_id long, x double")
    assert len(df.where("_corrupt_record IS NOT NULL").collect()) == 1
    scored = df.withColumn("p", F.col("x")).withColumn("decision", (F.col("p") > 0.5).cast("int"))
    R.write_scores(scored, f"{scratch}/out")
    assert spark.read.parquet(f"{scratch}/out/scores").count() == 2
    assert spark.read.parquet(f"{scratch}/out/errors").count() == 1
    sizes = R.sink_sizes(spark, f"{scratch}/out").collect()
    assert sizes and all(r["length"] > 0 for r in sizes)


def test_write_history(spark, scratch):
    h = spark.createDataFrame([(1, 0.123456, 0.5, 0.9, 0.25), (2, 0.1, 0.6, 0.8, 0.5)],
                              "epoch int, loss double, accuracy double, val_loss double, "
                              "val_accuracy double")
    R.write_history(h, f"{scratch}/hist")
    files = [f for f in os.listdir(f"{scratch}/hist") if f.endswith(".csv")]
    text = open(f"{scratch}/hist/{files[0]}").read().splitlines()
    assert text[0] == "Epoch\tLoss\tAccuracy\tVal Loss\tVal Accuracy"
    assert text[1] == "1\t0.1235\t0.5000\t0.9000\t0.2500"


def test_csv_sink(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    R.write_csv(df, f"{scratch}/csv")
    back = spark.read.option("header", True).csv(f"{scratch}/csv")
    assert back.columns == ["k", "v"]
