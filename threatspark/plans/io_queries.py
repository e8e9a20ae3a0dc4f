"""Queries over written copies of the given tables: sources and sinks (S1-S16), streams (R1-R3), one-object scoring
and the column steps that need files' names and types (P3, P4, P7, P14, P25).

Each writes what it reads below the shared scratch folder, a new folder each time.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..functions import columns as C
from ..operators import models as MD
from ..operators import networks as N
from ..operators import stages
from ..operators.transforms import QuantileModel
from ..session import scratch_path
from ..sources import arff, capture, readers
from ..streaming import packets as SP
from ..streaming import scoring, totals
from . import flow as FL
from .model_queries import STEP_COLS, focal_sql, scaled_flows
from .registry import (FLOW_CLEAN_SQL, FLOW_FEATS, KEY, KEY_SQL, ORACLE, PORT_SQL, QF, UNDER_SQL, oracle, query, r6)

FLOW_READ = [*KEY, "fwd_packet_length_max", "flow_bytes_s", "flow_iat_mean", "rare_zero", "label"]
FLOW_READ_SQL = ", ".join(FLOW_READ)
FLOW_SCHEMA = "flow_id long, source_port int, part_id long, supp_id long, fwd_packet_length_max double, flow_bytes_s double, " \
              "flow_iat_mean double, rare_zero double, label string"


def flow_columns(spark, sf):
    return fx.flows(spark, sf).select(*FLOW_READ)


def same_scores(a, b):
    """(n, scored, different): rows and scores of ``a``, and rows that only one of two scored tables has."""
    both = a.withColumn("side", F.lit(1)).union(b.withColumn("side", F.lit(-1)))
    rows = both.groupBy(*KEY, "p").agg(F.count_if(F.col("side") == 1).alias("n"), F.sum("side").alias("rest"))
    return rows.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).alias("scored"),
                    F.sum(F.abs("rest")).alias("different"))


# ---------------------------------------------------------------- files


@query("io_flow_csv", oracle(["flows"], f"SELECT {FLOW_READ_SQL.replace('source_port', 'CAST(source_port AS INTEGER) AS source_port')} FROM flows"))
def q_io_flow_csv(spark, sf):
    """S8 then S1: CSV with a header; empty cells are null."""
    path = scratch_path(spark, "flows-csv")
    readers.write_csv(flow_columns(spark, sf), path)
    return readers.read_flows(spark, path, FLOW_SCHEMA)


@query("io_headerless_csv", oracle(["flows"], "SELECT " + ", ".join(
    f"{'CAST(source_port AS INTEGER)' if c == 'source_port' else c} AS _c{i}" for i, c in enumerate(FLOW_READ)) + " FROM flows"))
def q_io_headerless_csv(spark, sf):
    """CSV without a header, columns by number."""
    path = scratch_path(spark, "flows-bare")
    readers.write_csv(flow_columns(spark, sf), path, header=False)
    named = T._parse_datatype_string(FLOW_SCHEMA)
    return readers.read_headerless(spark, path, T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(named)]))


@query("io_two_class", oracle(["malware_attack", "malware_normal"], """
SELECT 1 AS side, count(*) AS n, count(pkt_rate) AS known, round(sum(tot_bytes), 6) AS total FROM malware_attack
UNION ALL SELECT 0, count(*), count(pkt_rate), round(sum(tot_bytes), 6) FROM malware_normal"""))
def q_io_two_class(spark, sf):
    """S3: both class files of the malware track."""
    paths = [scratch_path(spark, n) for n in ("attack", "normal")]
    for view, path in zip((fx.malware_attack, fx.malware_normal), paths):
        readers.write_csv(view(spark, sf), path)
    sides = readers.read_two_class(spark, *paths)
    a, b = (d.agg(F.lit(k).alias("side"), F.count(F.lit(1)).alias("n"), F.count("pkt_rate").alias("known"),
                  r6(F.sum("tot_bytes")).alias("total")) for k, d in zip((1, 0), sides))
    return a.union(b)


_KEPT_SQL = " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS name FROM flows HAVING NOT coalesce(bool_and(coalesce({c} = 0, false)), true)"
    for i, c in enumerate(fx.FLOW_NUMERIC))


@query("io_feature_list", oracle(["flows"], f"SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS place, name FROM ({_KEPT_SQL})"))
def q_io_feature_list(spark, sf):
    """S7 then S6: names of the columns that are not all zero, written and read in order."""
    d = C.drop_zero_columns(fx.flows(spark, sf).select(*fx.FLOW_NUMERIC))
    path = scratch_path(spark, "features")
    readers.save_features(spark, d.columns, path)
    return spark.createDataFrame(list(enumerate(readers.load_features(spark, path))), "place int, name string")


@query("io_training_outputs", oracle(["flows"], f"""
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, traffic_type = 'Attack' AS attack, count(*) AS n FROM (
  SELECT traffic_type, row_number() OVER (ORDER BY md5(concat_ws(':', '10-split', {KEY_SQL})), {KEY_SQL})
         <= floor(0.7 * count(*) OVER ()) AS is_train FROM sampled) GROUP BY ALL""", FLOW_CLEAN_SQL + "," + UNDER_SQL))
def q_io_training_outputs(spark, sf):
    """The preparation's label files, read back and counted."""
    prepared, state = FL.prepare_flows(fx.flows(spark, sf), KEY, label="label", identifiers=["flow_ts"], redundant=[],
                                       drop_low_importance=["rare_zero"])
    path = scratch_path(spark, "training")
    FL.write_training_outputs(prepared, state, path, KEY, label="label")
    parts = [readers.read_flows(spark, f"{path}/{p}_labels").withColumn("part", F.lit(p)) for p in ("train", "test")]
    return parts[0].union(parts[1]).groupBy("part", (C.q("traffic type") == 1).alias("attack")).agg(F.count(F.lit(1)).alias("n"))


@query("io_requests", oracle(["flows"], f"SELECT {KEY_SQL}, flow_bytes_s, label, false AS broken FROM flows UNION ALL "
                             "SELECT NULL, NULL, NULL, NULL, NULL, NULL, true FROM flows WHERE source_port = 7"))
def q_io_requests(spark, sf):
    """JSON rows, with a broken line for every flow of port 7."""
    path = scratch_path(spark, "requests")
    d = fx.flows(spark, sf).select(*KEY, "flow_bytes_s", "label")
    good = d.select(F.to_json(F.struct(*d.columns)).alias("value"))
    good.union(d.where("source_port = 7").select(F.lit("{broken").alias("value"))).write.text(path)
    kept = scratch_path(spark, "requests-read")     # Spark refuses queries on the corrupt-record column alone over raw files
    readers.read_requests(spark, path, d.schema).write.parquet(kept)
    return spark.read.parquet(kept).select(*d.columns, F.col("_corrupt_record").isNotNull().alias("broken"))


@query("io_arff", oracle(["phishing"], """
SELECT CAST(doc_id AS DOUBLE) AS doc_id, lang, source, url_length, request_url, CAST(result AS DOUBLE) AS result FROM phishing"""))
def q_io_arff(spark, sf):
    """An ARFF copy of the phishing table, several files in ranges."""
    path = scratch_path(spark, "phishing-arff")
    arff.write_arff(fx.phishing(spark, sf), path, "phishing", files=3)
    return arff.read_arff(spark, path, rangeBytes=1 << 20)


@query("io_scores", oracle(["scores"], """
SELECT 'scores' AS sink, count(*) AS n, round(sum(p), 6) AS total FROM scores WHERE row_id % 10 <> 0
UNION ALL SELECT 'errors', count(*), NULL FROM scores WHERE row_id % 10 = 0"""))
def q_io_scores(spark, sf):
    """Scores to one sink, rows without a score to the other."""
    path = scratch_path(spark, "scored")
    s = fx.scores(spark, sf).withColumn("p", F.when(F.col("row_id") % 10 != 0, F.col("p"))).withColumn("decision", F.col("p") > 0.5)
    readers.write_scores(s, path)
    good, bad = (spark.read.parquet(f"{path}/{n}") for n in ("scores", "errors"))
    return (good.agg(F.lit("scores").alias("sink"), F.count(F.lit(1)).alias("n"), r6(F.sum("p")).alias("total"))
            .union(bad.agg(F.lit("errors").alias("sink"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"))))


@query("io_history", oracle(["flows"], "SELECT epoch, round(loss, 4) AS loss, round(accuracy, 4) AS accuracy, round(val_loss, 4) AS val_loss, "
                            "round(val_accuracy, 4) AS val_accuracy FROM (" + " UNION ALL ".join(f"SELECT * FROM s{t}" for t in (1, 2)) + ")",
                            FLOW_CLEAN_SQL + "," + UNDER_SQL + "," + focal_sql()))
def q_io_history(spark, sf):
    """The history of a training run as tab-separated text, read back."""
    model = N.fit_network(scaled_flows(spark, sf), STEP_COLS, "y", KEY, "held", hidden=(), objective=N.Objective(N.FOCAL_GAMMA, N.FOCAL_ALPHA),
                          epochs=2, rate=0.1)
    path = scratch_path(spark, "history")
    readers.write_history(N.history_table(spark, model.state), path)
    got = spark.read.option("header", True).option("sep", "\t").csv(path)
    return got.select(F.col("Epoch").cast("int").alias("epoch"), *[C.q(a).cast("double").alias(b) for a, b in zip(
        ["Loss", "Accuracy", "Val Loss", "Val Accuracy"], ["loss", "accuracy", "val_loss", "val_accuracy"])])


@query("io_sink_sizes", oracle(["packets"], f"SELECT {PORT_SQL} AS class, true AS written FROM packets WHERE proto = 'tcp' AND "
                               f"dst_ip = '127.0.0.1' AND {PORT_SQL} IS NOT NULL GROUP BY 1"))
def q_io_sink_sizes(spark, sf):
    """The classes whose sink holds bytes."""
    path = scratch_path(spark, "split")
    SP.split_packets(fx.packets(spark, sf)).write.partitionBy("class").parquet(path)
    sizes = readers.sink_sizes(spark, path).where("path LIKE '%.parquet'")
    return sizes.groupBy(F.regexp_extract("path", "class=([a-z]+)", 1).alias("class")).agg((F.sum("length") > 0).alias("written"))


@query("io_model", oracle(["flows"], "SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM sampled", FLOW_CLEAN_SQL + "," + UNDER_SQL))
def q_io_model(spark, sf):
    """A saved and loaded pipeline scores as the fitted one does."""
    d = scaled_flows(spark, sf)
    model = MD.flow_classifier(STEP_COLS, "y", kind="logistic", max_iter=10).fit(d)
    path = scratch_path(spark, "model")
    MD.save_model(model, path)
    a, b = (MD.score(m, d).select(*KEY, "p") for m in (model, MD.load_model(path)))
    return same_scores(a, b).drop("scored")


# ---------------------------------------------------------------- one object from raw flows to scores

RAW_IDENTIFIERS, RAW_REDUNDANT = ["flow_ts"], ["rare_zero"]


@query("flow_pipeline_prepare", ORACLE["flow_score_prepare"])
def q_flow_pipeline_prepare(spark, sf):
    """T7 + T8: the preparation as one saved and loaded pipeline."""
    fl = fx.flows(spark, sf)
    fitted = Pipeline(stages=stages.flow_stages("label", KEY, RAW_IDENTIFIERS, RAW_REDUNDANT)).fit(fl)
    path = scratch_path(spark, "pipeline")
    fitted.write().overwrite().save(path)
    out = PipelineModel.load(path).transform(fl)
    return out.select(*KEY, *[r6(c).alias(c) for c in QF], C.q("traffic type").alias("traffic_type"))


@query("flow_pipeline_scores", oracle(["flows"], "SELECT count(*) AS n, count(*) AS scored, CAST(0 AS BIGINT) AS different FROM flows"))
def q_flow_pipeline_scores(spark, sf):
    """T7 + M10: raw flows without a label through one loaded object, against the fitted one."""
    fl = fx.flows(spark, sf)
    tail = [MD.assembler(QF), LogisticRegression(featuresCol="features", labelCol="traffic type", maxIter=10)]
    fitted = stages.flow_pipeline(tail, label="label", keep=KEY, identifiers=RAW_IDENTIFIERS, redundant=RAW_REDUNDANT).fit(fl)
    path = scratch_path(spark, "scorer")
    MD.save_model(fitted, path)
    raw = fl.drop("label")
    a, b = (MD.score(m, raw).select(*KEY, "p") for m in (fitted, MD.load_model(path)))
    return same_scores(a, b)


# ---------------------------------------------------------------- streams


@query("stream_capture_split", oracle(["packets"], f"""
SELECT {PORT_SQL} AS class, count(*) AS n, count(DISTINCT packet_id) AS packets FROM packets
WHERE proto = 'tcp' AND dst_ip = '127.0.0.1' AND {PORT_SQL} IS NOT NULL GROUP BY 1"""))
def q_stream_capture_split(spark, sf):
    """Packets as capture files, read as a stream in two runs, split by class into two sinks."""
    capture.register(spark)
    base = scratch_path(spark, "capture")
    p = fx.packets(spark, sf).withColumn("dport", F.lit(80))
    for even in (True, False):
        part = p.where((F.col("packet_id") % 2 == 0) == F.lit(even))
        part.write.format("pcap").mode("append").save(f"{base}/in")
        stream = spark.readStream.format("pcap").option("rangeBytes", 1 << 20).load(f"{base}/in")
        SP.write_split_stream(SP.split_packets(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    return got.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file", "packet_id").alias("packets"))


@query("stream_totals", oracle(["packets"], f"""
SELECT {PORT_SQL} AS class, count(*) AS packets, round(sum(length), 4) AS bytes FROM packets
WHERE proto = 'tcp' AND dst_ip = '127.0.0.1' AND {PORT_SQL} IS NOT NULL GROUP BY 1"""))
def q_stream_totals(spark, sf):
    """R2: totals per class as keyed state, stopped after half of the packets and gone on from the checkpoint."""
    totals.use_state_store(spark)
    base = scratch_path(spark, "totals")
    p = fx.packets(spark, sf).withColumns({"src_ip": F.lit("10.0.0.1"), "dport": F.lit(80), "flags": F.lit("S")})
    for even in (True, False):
        p.where((F.col("packet_id") % 2 == 0) == F.lit(even)).write.mode("append").json(f"{base}/in")
        classed = SP.split_packets(SP.packet_stream(spark, f"{base}/in"))
        totals.start_totals(classed, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return totals.snapshot(spark, f"{base}/out").select("class", "packets", F.round("bytes", 4).alias("bytes"))


@query("stream_scoring", oracle(["flows"], "SELECT count(*) AS scored, count(DISTINCT flow_id * 10 + source_port) AS rows, "
                                "count(*) FILTER (source_port = 7) AS errors FROM flows"))
def q_stream_scoring(spark, sf):
    """Request files through the scoring stream; broken lines go to the error sink."""
    base = scratch_path(spark, "scoring")
    fl = fx.flows(spark, sf).select(*KEY, *QF, "label").withColumn("row_id", F.col("flow_id") * 10 + F.col("source_port"))
    qm = QuantileModel.fit(fl, QF, KEY, n_quantiles=100)
    train = qm.transform(fl).withColumn("y", (F.col("label") != "BENIGN").cast("double"))
    model = MD.flow_classifier(QF, "y", kind="logistic", max_iter=10).fit(train)
    lines = fl.select(F.to_json(F.struct("row_id", *QF, "label")).alias("value"))
    lines.union(fl.where("source_port = 7").select(F.lit("{broken").alias("value"))).write.text(f"{base}/in")
    schema = fl.select("row_id", *QF, "label").schema
    state = FL.FlowState(features=QF, quantiles=qm)
    scoring.run_scoring_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", schema, state, model).awaitTermination()
    good, bad = (spark.read.parquet(f"{base}/out/{n}") for n in ("scores", "errors"))
    both = good.select("p", "row_id", F.lit(0).alias("e")).unionByName(
        bad.select(F.lit(None).cast("double").alias("p"), F.lit(None).cast("long").alias("row_id"), F.lit(1).alias("e")))
    return both.agg(F.count("p").alias("scored"), F.countDistinct("row_id").alias("rows"), F.sum("e").alias("errors"))


# ---------------------------------------------------------------- columns

NAMED = {"fwd_packet_length_max": "Flow Duration", "flow_bytes_s": "Flow Bytes/s", "flow_iat_mean": "Idle Mean", "flow_iat_min": "Flow IAT Min"}


@query("flow_drop_redundant", oracle(["flows"], f"""
SELECT {KEY_SQL}, flow_bytes_s AS "Flow Bytes/s", flow_iat_min AS "Flow IAT Min" FROM flows"""))
def q_flow_drop_redundant(spark, sf):
    """P3 on columns of which two bear listed names."""
    d = fx.flows(spark, sf).select(*KEY, *[F.col(a).alias(b) for a, b in NAMED.items()])
    return C.drop_columns(d, C.REDUNDANT_FEATURES_TRAINING)


@query("flow_select_features", oracle(["flows"], """
SELECT flow_bytes_s AS "Flow Bytes/s", flow_iat_min AS "Flow IAT Min", flow_iat_mean AS "Idle Max" FROM flows"""))
def q_flow_select_features(spark, sf):
    """A list of names, in its order."""
    d = fx.flows(spark, sf).select(*KEY, F.col("flow_iat_mean").alias("Idle Max"), F.col("flow_iat_min").alias("Flow IAT Min"),
                                   F.col("flow_bytes_s").alias("Flow Bytes/s"))
    return C.select_features(d, [c for c in C.FLOW_FEATURES if c in d.columns])


@query("phish_normalize_columns", oracle(["phishing"], 'SELECT doc_id, lang, result AS "Result_1" FROM phishing'))
def q_phish_normalize_columns(spark, sf):
    """Names with blanks about them."""
    d = fx.phishing(spark, sf).select("doc_id", F.col("lang").alias("  lang "), F.col("result").alias("Result_1 "))
    return C.normalize_columns(d, required=["Result_1"])


@query("decode_texts", oracle([], "SELECT doc_id, text, lang FROM documents"))
def q_decode_texts(spark, sf):
    """Binary columns to text."""
    d = fx.table(spark, sf, "documents")
    return C.decode_bytes(d.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("lang").cast("binary").alias("lang")))


@query("flow_xy", oracle(["flows"], f"""
SELECT i AS place, round(sum(x), 6) AS total, count(*) AS n FROM (
  SELECT unnest([{', '.join(c for c in FLOW_FEATS if c != 'rare_zero')}]) AS x, unnest([0, 1, 2, 3]) AS i FROM flows) GROUP BY i"""))
def q_flow_xy(spark, sf):
    """P25: a feature vector and the label, each place of the vector summed."""
    feats = [c for c in FLOW_FEATS if c != "rare_zero"]
    d = C.to_xy(fx.flows(spark, sf).select(*feats, "label"), "label")
    x = d.select(F.posexplode(vector_to_array("features")).alias("place", "x"))
    return x.groupBy("place").agg(r6(F.sum("x")).alias("total"), F.count(F.lit(1)).alias("n"))
