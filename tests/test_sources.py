"""ARFF and capture data sources: ranges, odd lines, growing files, restarts; running totals as state."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from threatspark.sources import arff, capture
from threatspark.streaming import packets as P
from threatspark.streaming import totals

HEAD = """% a comment
@RELATION sites
@attribute 'page rank' {-1, 0,1}
@ATTRIBUTE having_IP NUMERIC
@attribute "it's" string
@attribute when date "yyyy-MM-dd"
@data
"""


def written(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_arff_rows(spark, scratch):
    body = """-1, 2.5, 'a, b', 2020-01-01
% another
0,?,"it's \\"so\\"",?

{1 7, 2 'x y'}
{}
? , 1e3 , 'don\\'t' , 2021-02-03
"""
    p = written(f"{scratch}/one.arff", HEAD + body)
    df = arff.read_arff(spark, p)
    assert df.dtypes == [("page rank", "string"), ("having_IP", "double"), ("it's", "string"), ("when", "string")]
    want = [("-1", 2.5, "a, b", "2020-01-01"), ("0", None, 'it\'s "so"', None), ("-1", 7.0, "x y", ""), ("-1", 0.0, "", ""),
            (None, 1000.0, "don't", "2021-02-03")]
    assert [tuple(r) for r in df.collect()] == want
    for n in (1, 3, 10, 40):
        assert [tuple(r) for r in arff.read_arff(spark, p, rangeBytes=n).collect()] == want
    assert df.select("having_IP").filter("having_IP > 5").count() == 2


def test_arff_many_files_and_ranges(spark, scratch):
    rng = random.Random(1)
    want = []
    for k in range(3):
        rows = [(rng.choice(["-1", "0", "1"]), rng.randint(-9, 9) / 2, rng.choice(["x", "y z", ""]), "2020-01-01") for _ in range(400)]
        want += rows
        written(f"{scratch}/in/part{k}.arff", HEAD + "".join(f"{a},{b},'{c}',{d}\n" for a, b, c, d in rows))
    written(f"{scratch}/in/_hidden", "no")
    for n in (1 << 20, 777, 64):
        got = arff.read_arff(spark, f"{scratch}/in", rangeBytes=n)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() > 30
    written(f"{scratch}/in/other.arff", "@attribute a numeric\n@data\n1\n")
    with pytest.raises(Exception, match="other attributes"):
        arff.read_arff(spark, f"{scratch}/in").count()


def test_arff_bad_input(spark, scratch):
    p = written(f"{scratch}/bad.arff", HEAD + "0,1,x,y\n0,1\n1,zz,x,y\n1,2,x,y\n")
    with pytest.raises(Exception, match="values for 4 attributes|could not convert"):
        arff.read_arff(spark, p).count()
    assert arff.read_arff(spark, p, mode="DROPMALFORMED").count() == 2
    assert arff.read_arff(spark, written(f"{scratch}/empty.arff", HEAD)).count() == 0
    for text in ("@relation x\n", "@attribute a relational\n@data\n", "@data\n1\n"):
        with pytest.raises(Exception):
            arff.read_arff(spark, written(f"{scratch}/x.arff", text)).count()
    with pytest.raises(Exception):
        arff.read_arff(spark, f"{scratch}/nothing").count()


def test_arff_round_trip(spark, scratch):
    df = spark.createDataFrame([(1, "a,b", None), (None, "it's \\ %{x}", 2.5), (3, None, 0.0), (4, "ü?", -1.0), (5, "?", 1.0)],
                               "n int, `two words` string, x double")
    arff.write_arff(df, f"{scratch}/out", files=2)
    got = sorted((tuple(r) for r in arff.read_arff(spark, f"{scratch}/out").collect()), key=str)
    assert got == sorted(((None if n is None else float(n), t, x) for n, t, x in map(tuple, df.collect())), key=str)


# ---------------------------------------------------------------- captures


def frame(sport, dport=80, src="10.0.0.1", dst="127.0.0.1", proto="tcp", flags="S", pad=0):
    return capture.frame_of({"sport": sport, "dport": dport, "src_ip": src, "dst_ip": dst, "proto": proto, "flags": flags}) + bytes(pad)


def capture_bytes(frames, order="<", nano=False, first=1_600_000_000):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 1 << 18, 1)
    for k, f in enumerate(frames):
        out += struct.pack(f"{order}IIII", first + k, 500_000_000 if nano else 500_000, len(f), len(f) + 3) + f
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("nano", [False, True])
def test_capture_fields(spark, scratch, order, nano):
    frames = [frame(4000), frame(53, proto="udp"), b"\0" * 60, frame(6000, flags="SA"), frame(0, proto="icmp"), frame(1, pad=300)]
    with open(f"{scratch}/a.pcap", "wb") as f:
        f.write(capture_bytes(frames, order, nano))
    capture.register(spark)
    got = spark.read.format("pcap").load(f"{scratch}/a.pcap").orderBy("packet_id").collect()
    assert [(r.proto, r.sport, r.flags) for r in got] == [("tcp", 4000, "S"), ("udp", 53, None), (None, None, None), ("tcp", 6000, "SA"),
                                                         ("icmp", None, None), ("tcp", 1, "S")]
    assert [r.length for r in got] == [len(f) + 3 for f in frames] and got[0].dst_ip == "127.0.0.1"
    assert got[1].ts.timestamp() == 1_600_000_001.5


def test_capture_ranges_find_records(spark, scratch):
    rng = random.Random(2)
    frames = [frame(rng.randint(1, 60_000), pad=rng.randint(0, 1_200)) for _ in range(900)]
    data = capture_bytes(frames)
    with open(f"{scratch}/a.pcap", "wb") as f:
        f.write(data + struct.pack("<IIII", 1_600_000_900, 1, 500, 500) + b"half")      # still being written
    capture.register(spark)
    want = [struct.unpack(">H", x[34:36])[0] for x in frames]
    for n in (1 << 20, 50_000, 3_001, 40):
        if n == 40:          # shorter than a record: many ranges without one
            small = capture_bytes(frames[:40])
            with open(f"{scratch}/b.pcap", "wb") as f:
                f.write(small)
            got = spark.read.format("pcap").option("rangeBytes", n).load(f"{scratch}/b.pcap").orderBy("packet_id").collect()
            assert [r.sport for r in got] == want[:40]
        else:
            got = spark.read.format("pcap").option("rangeBytes", n).load(f"{scratch}/a.pcap").orderBy("packet_id").collect()
            assert [r.sport for r in got] == want


def test_capture_stream_restarts_without_loss_or_repeat(spark, scratch):
    capture.register(spark)
    os.mkdir(f"{scratch}/in")
    rng = random.Random(3)
    frames = [frame(rng.choice([2000, 7000, 20_000]), pad=rng.randint(0, 200)) for _ in range(300)]
    data, half = capture_bytes(frames), capture_bytes(frames[:140])

    def run():
        q = P.write_split_stream(P.split_packets(spark.readStream.format("pcap").option("rangeBytes", 4_000).load(f"{scratch}/in")),
                                 f"{scratch}/out", f"{scratch}/ckpt")
        q.awaitTermination()
    with open(f"{scratch}/in/a.pcap", "wb") as f:
        f.write(half + data[len(half):len(half) + 20])       # ends within a record
    run()
    read = spark.read.parquet(f"{scratch}/out")
    assert read.count() == sum(struct.unpack(">H", x[34:36])[0] < 10_000 for x in frames[:140])
    run()                                                    # nothing new
    with open(f"{scratch}/in/a.pcap", "ab") as f:
        f.write(data[len(half) + 20:])
    with open(f"{scratch}/in/b.pcap", "wb") as f:
        f.write(capture_bytes([frame(3000)] * 5))
    run()
    got = spark.read.parquet(f"{scratch}/out")
    assert got.select("file", "packet_id").distinct().count() == got.count()
    want = [struct.unpack(">H", x[34:36])[0] for x in frames] + [3000] * 5
    assert {r["class"]: r["count"] for r in got.groupBy("class").count().collect()} == {
        "benign": sum(1000 <= s <= 5000 for s in want), "attack": sum(5001 <= s <= 10_000 for s in want)}


def test_capture_writer_round_trip(spark, scratch):
    rows = [("10.0.0.1", "127.0.0.1", "tcp", 2000, 80, "SA", 100), ("1.2.3.4", "5.6.7.8", "udp", 53, 5353, None, 60), (None, None, "icmp", None, None, None, None)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, proto string, sport int, dport int, flags string, length bigint")
    df = df.withColumn("ts", F.timestamp_micros(F.lit(1_600_000_000_123_456)))
    capture.register(spark)
    df.repartition(2).write.format("pcap").mode("append").save(f"{scratch}/out")
    got = spark.read.format("pcap").load(f"{scratch}/out").collect()
    assert sorted((r.proto, r.sport, r.dport, r.flags) for r in got if r.proto != "icmp") == [("tcp", 2000, 80, "SA"), ("udp", 53, 5353, None)]
    assert len(got) == 3 and {r.ts.microsecond for r in got} == {123_456} and max(r.length for r in got) == 100


def test_not_a_capture(spark, scratch):
    with open(f"{scratch}/x.pcap", "wb") as f:
        f.write(b"nothing of the kind, but long enough")
    capture.register(spark)
    with pytest.raises(Exception, match="not a packet capture"):
        spark.read.format("pcap").load(f"{scratch}/x.pcap").count()


# ---------------------------------------------------------------- totals


def test_totals_go_on_after_a_restart(spark, scratch):
    totals.use_state_store(spark)
    schema = "packet_id long, ts timestamp, length double, class string"

    def feed(rows, name):
        df = spark.createDataFrame(rows, "packet_id long, length double, class string")
        df.withColumn("ts", F.timestamp_seconds(F.col("packet_id") + 1_600_000_000)).write.mode("append").json(f"{scratch}/in")

    def run():
        totals.start_totals(spark.readStream.schema(schema).json(f"{scratch}/in"), f"{scratch}/out", f"{scratch}/ckpt").awaitTermination()
    one = [(i, float(i), "benign" if i % 3 else "attack") for i in range(100)] + [(500, 1.0, None)]
    two = [(i, None if i == 105 else 2.0, "benign") for i in range(100, 130)] + [(700, 3.0, "new")]
    feed(one, "one")
    run()
    first = {r["class"]: r.packets for r in totals.snapshot(spark, f"{scratch}/out").collect()}
    assert first == {"benign": 66, "attack": 34}
    feed(two, "two")
    run()
    got = {r["class"]: r for r in totals.snapshot(spark, f"{scratch}/out").collect()}
    every = [r for r in one + two if r[2]]
    assert {k: (r.packets, r.bytes, r.last.timestamp() - 1_600_000_000) for k, r in got.items()} == {
        k: (sum(r[2] == k for r in every), sum(r[1] or 0 for r in every if r[2] == k), max(r[0] for r in every if r[2] == k))
        for k in ("benign", "attack", "new")}


def test_totals_of_older_versions():
    assert totals.upgraded(None) == (0, 0.0, None)
    assert totals.upgraded((1, 5, None, None)) == (5, 0.0, None)
    assert totals.upgraded((2, 5, 7.0, None)) == (5, 7.0, None)
