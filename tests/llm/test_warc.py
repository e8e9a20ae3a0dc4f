import base64
import gzip
import hashlib
import json
import zlib

from threatspark.llm import warc

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(rows):
    """rows (page_id, html) -> sorted (page_id, bytes, digest, type, refers_to)"""
    best, n = {}, {}
    for k, h in rows:
        b = (h or "").encode()
        n[b] = n.get(b, 0) + 1
        if k is not None:
            best[b] = max(k, best.get(b, k))
    out = []
    for k, h in rows:
        b = (h or "").encode()
        revisit = n[b] > 1 and best.get(b) is not None and k != best[b]
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                    best[b] if revisit else None))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    for sf in (SF001, SF01):
        rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
        assert sorted((tuple(r) for r in warc.query(spark, sf).collect()), key=str) == brute(rows)


def test_edges_and_files(spark, scratch):
    rows = [(1, "u1", None), (2, None, ""), (3, "http://a/\r\nWARC-Type: x ü", "<p>é</p>"), (4, "u", "<p>é</p>"),
            (4, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "u", "only"), (None, "v", "only"), (5, "u", "WARC/1.1\r\n\r\n" * 3),
            (6, "u", "x\r\n\r\n" * 300_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, refers_to int")
    mono = warc.write_archives(df.repartition(2), f"file://{scratch}/mono")
    norm = warc.normalise(mono, f"file://{scratch}/members")
    out = warc.read_records(norm)
    got = out.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(
        [(k, h) for k, _, h in rows])
    assert sorted((r.url or "" for r in got)) == sorted(u or "" for _, u, _ in rows)
    assert {bytes(r.payload) for r in got if r.page_id == 6} == {rows[-1][2].encode()}
    assert sum(r.n for r in norm.collect()) == len(rows)
    for r in mono.collect():  # one gzip stream per source file
        z = zlib.decompressobj(31)
        z.decompress(open(r.path.removeprefix("file://"), "rb").read())
        assert z.eof and not z.unused_data
    for r in norm.collect():  # every record is a member; the index has each
        path = r.path.removeprefix("file://")
        data, index = open(path, "rb").read(), [json.loads(x) for x in open(f"{path}.idx")]
        assert sum(x["length"] for x in index) == len(data)
        for x in index:
            assert gzip.decompress(data[x["offset"]:x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")
    again = warc.normalise(norm, f"file://{scratch}/again")  # members are accepted as input, too
    assert warc.read_records(again).count() == len(rows)
    assert warc.read_records(warc.normalise(warc.write_archives(df.limit(0), f"file://{scratch}/none"), scratch)).count() == 0


def test_least_bytes(spark, scratch):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")],
                               "page_id long, url string, html string")
    norm = warc.normalise(warc.write_archives(df, f"{scratch}/m", least_bytes=3), f"{scratch}/n")
    assert {r.page_id: r.refers_to for r in warc.read_records(norm).collect()} == {1: None, 2: None, 3: 4, 4: None}
