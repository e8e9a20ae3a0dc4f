import json
import os

from pyspark.sql import functions as F

from threatspark.streaming import packets as SP


def _packets(path, start, n):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/p{start}.json", "w") as f:
        for i in range(start, start + n):
            f.write(json.dumps({"packet_id": i, "src_ip": "127.0.0.1", "dst_ip": "127.0.0.1",
                                "proto": "udp" if i % 7 == 0 else "tcp",
                                "sport": 900 + (i * 37) % 9300, "dport": 80,
                                "flags": "S", "length": 60.0}) + "\n")


def _expected(start, n):
    out = {"benign": 0, "attack": 0}
    for i in range(start, start + n):
        if i % 7 == 0:
            continue
        p = 900 + (i * 37) % 9300
        if 1000 <= p <= 5000:
            out["benign"] += 1
        elif 5001 <= p <= 10000:
            out["attack"] += 1
    return out


def test_packet_split_restart_no_duplicates(spark, scratch):
    src, out, ck = f"{scratch}/src", f"{scratch}/out", f"{scratch}/ck"
    _packets(src, 0, 500)
    SP.run_packet_split(spark, src, out, ck).awaitTermination()
    first = spark.read.parquet(out).groupBy("class").count().collect()
    assert {r[0]: r[1] for r in first} == _expected(0, 500)
    # a restart on the same checkpoint reads only the new file
    _packets(src, 500, 300)
    SP.run_packet_split(spark, src, out, ck).awaitTermination()
    second = {r[0]: r[1] for r in spark.read.parquet(out).groupBy("class").count().collect()}
    assert second == _expected(0, 800)
    assert spark.read.parquet(out).select("packet_id").distinct().count() == \
        sum(_expected(0, 800).values())
    assert sorted(os.listdir(out))[:2] == ["_spark_metadata", "class=attack"]


def test_running_counts_complete(spark, scratch):
    src = f"{scratch}/src2"
    _packets(src, 0, 400)
    classified = SP.split_packets(SP.packet_stream(spark, src))
    q = SP.start_running_counts(classified, f"{scratch}/ck2", name="pc_test")
    q.awaitTermination()
    got = {r[0]: r[1] for r in spark.sql("SELECT * FROM pc_test").collect()}
    assert got == _expected(0, 400)


def test_scoring_stream(spark, scratch):
    from pyspark.sql import types as T
    from threatspark.operators import models as MD
    from threatspark.operators.transforms import QuantileModel
    from threatspark.plans.flow import FlowState
    from threatspark.streaming.scoring import run_scoring_stream
    train = spark.range(0, 200).select(F.col("id").alias("row_id"),
                                       (F.col("id") % 10).cast("double").alias("Flow Bytes/s"),
                                       (F.col("id") % 7).cast("double").alias("Flow IAT Min"),
                                       ((F.col("id") % 10) > 4).cast("double").alias("y"))
    feats = ["Flow Bytes/s", "Flow IAT Min"]
    qm = QuantileModel.fit(train, feats, ["row_id"], n_quantiles=50, subsample=None)
    state = FlowState(features=feats, quantiles=qm)
    model = MD.flow_classifier(feats, "y", kind="logistic", max_iter=20).fit(qm.transform(train))
    src = f"{scratch}/req"
    os.makedirs(src)
    with open(f"{src}/a.json", "w") as f:
        for i in range(20):
            f.write(json.dumps({"row_id": i, "Flow ID": "x", "Flow Bytes/s": i % 10,
                                "Flow IAT Min": i % 7, "Label": "BENIGN"}) + "\n")
        f.write("{not json\n")
    schema = T.StructType.fromJson({"type": "struct", "fields": [
        {"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in
        [("row_id", "long"), ("Flow ID", "string"), ("Flow Bytes/s", "double"),
         ("Flow IAT Min", "double"), ("Label", "string")]]})
    q = run_scoring_stream(spark, src, f"{scratch}/out", f"{scratch}/ck", schema, state, model)
    q.awaitTermination()
    scores = spark.read.parquet(f"{scratch}/out/scores")
    assert scores.count() == 20 and scores.where("p IS NULL").count() == 0
    assert spark.read.parquet(f"{scratch}/out/errors").count() == 1


class CountedModel:
    """Gives every row a probability and counts the rows it has scored."""

    def __init__(self, made):
        self.made = made

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        made = self.made

        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b
        rows, x = df.mapInArrow(run, df.schema), F.coalesce("x", F.lit(float("nan")))
        return rows.withColumn("probability", array_to_vector(F.array(1 - x, x)))


def test_scoring_stream_scores_each_row_once(spark, scratch):
    from threatspark.plans.flow import FlowState
    from threatspark.streaming.scoring import run_scoring_stream
    src = f"{scratch}/req"
    os.makedirs(src)
    with open(f"{src}/a.json", "w") as f:
        for i in range(40):
            f.write(json.dumps({"row_id": i, "x": None if i % 10 == 3 else i / 40}) + "\n")
        f.write("{not json\n")
    schema = spark.createDataFrame([], "row_id long, x double").schema
    made = spark.sparkContext.accumulator(0)
    run_scoring_stream(spark, src, f"{scratch}/out", f"{scratch}/ck", schema, FlowState(features=["x"]),
                       CountedModel(made)).awaitTermination()
    assert made.value == 40
    scores = {r.row_id: (r.p, r.decision) for r in spark.read.parquet(f"{scratch}/out/scores").collect()}
    assert scores == {i: (i / 40, int(i > 20)) for i in range(40) if i % 10 != 3}
    errors = sorted((str(r.row_id), r._corrupt_record) for r in spark.read.parquet(f"{scratch}/out/errors").collect())
    assert errors == [("13", None), ("23", None), ("3", None), ("33", None), ("None", "{not json")]
