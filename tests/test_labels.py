from pyspark.sql import functions as F

from threatspark.functions import labels as L


def test_binary_label_null_is_attack(spark):
    df = spark.createDataFrame([("BENIGN",), ("DDoS",), (None,)], "Label string")
    out = [r[1] for r in L.binary_label(df).collect()]
    assert out == ["Normal", "Attack", "Attack"]


def test_binary_label_int(spark):
    df = spark.createDataFrame([("BENIGN", 1.0), ("PortScan", 2.0)], "Label string, x double")
    out = L.binary_label_int(df)
    assert out.columns == ["x", "traffic type"]
    assert [r[1] for r in out.collect()] == [0, 1]
    nolabel = spark.createDataFrame([(1.0,)], "x double")
    assert L.binary_label_int(nolabel).columns == ["x"]


def test_map_values_unmapped_is_null(spark):
    df = spark.createDataFrame([("Normal",), ("Attack",), ("Other",)], "t string")
    assert [r[0] for r in L.map_values(df, "t", L.TRAFFIC_CODES).collect()] == [0, 1, None]
    df2 = spark.createDataFrame([(-1,), (1,), (0,)], "r int")
    assert [r[0] for r in L.map_values(df2, "r", L.PHISHING_TARGET_CODES).collect()] == [0, 1, None]


def test_port_rule_bounds(spark):
    ports = [999, 1000, 5000, 5001, 10000, 10001]
    df = spark.createDataFrame([(p,) for p in ports], "sport int")
    got = {r[0]: r[1] for r in L.classify_port(df).collect()}
    assert got == {1000: "benign", 5000: "benign", 5001: "attack", 10000: "attack"}


def test_filter_tcp_host(spark):
    df = spark.createDataFrame(
        [("tcp", "127.0.0.1", "1.2.3.4"), ("udp", "127.0.0.1", "1.2.3.4"),
         ("tcp", "1.2.3.4", "127.0.0.1"), ("tcp", "1.2.3.4", "5.6.7.8")],
        "proto string, src_ip string, dst_ip string")
    assert L.filter_tcp_host(df).count() == 2


def test_indicators_on_reference_rows(spark):
    # the two sample flows of the reference's inference check (FIXTURES A6)
    rows = [(1, 0, 800.0, 0.001), (7659, 7659, 12022.688875459973, 7.867813110351562e-06)]
    df = spark.createDataFrame(rows, "`SYN Flag Count` long, `RST Flag Count` long, "
                                     "`Flow Bytes/s` double, `Flow IAT Min` double")
    out = [r[0] for r in L.indicators(df).select("indicators").collect()]
    assert out[0] == []
    assert out[1] == ["High SYN Count: 7659 (Possible SYN Flood)",
                      "High RST Count: 7659 (Possible RST Flood)",
                      "High Flow Rate: 12022.69 bytes/s",
                      "Very small Inter-Arrival Time: 7.867813110351562E-6"]


def test_decide_and_pct(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.12345,)], "p double")
    out = df.select(L.decide_expr(F.col("p")), L.verdict_expr(F.col("p")),
                    L.pct_expr(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [(0, "Benign", "50.00%"), (1, "Malicious", "50.00%"),
                                       (0, "Benign", "12.35%")]
