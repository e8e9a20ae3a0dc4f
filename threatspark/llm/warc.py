"""WARC archives: monolithic gzip files, normalised to one member per record (operator 7).

``write_archives`` turns each partition of pages into one ``.warc.gz`` that is a
single gzip stream, as many crawlers leave them. Pages with equal payloads have
one response, the others are revisits of it. ``normalise`` inflates each such
stream once, chunk by chunk, writes every record as a gzip member of its own and
a sidecar index (JSON lines: offset, length, type, id). ``read_records`` then opens
records by the index alone and checks payload digests.

Files lie below a folder that all executors share, under names that no two
attempts of a task use; only files whose rows were committed are read on.

Defined results: null html is the empty payload; a null url is left out of the record;
a null page_id is written as such and revisits the page with the largest id (all are
responses if every id of the payload is null); repeated rows that hold the largest id
are all responses; other columns are ignored; no rows give no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, new_path, read_table, stored, sub_batches

DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL namespace
FILES = "path string, n bigint"
RECORDS = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
           "refers_to bigint, payload binary, archive string, offset bigint, length bigint")


def _fs(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-X-Page: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
        head.append(f"WARC-X-URL: {json.dumps(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def inflated(stream):
    """Chunks of a gzip file, whether it is one stream or many members."""
    z = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            yield z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            else:
                break
    yield z.flush()


def records(chunks):
    """(headers, whole record) of an inflated archive; holds one record and one chunk."""
    held = bytearray()
    chunks = iter(chunks)
    need, head = None, None
    while True:
        if need is None:
            at = held.find(b"\r\n\r\n")
            if at >= 0:
                head = parse_head(bytes(held[:at]))
                need = at + 4 + int(head["Content-Length"]) + 4
        if need is not None and len(held) >= need:
            yield head, bytes(held[:need])
            del held[:need]
            need = None
            continue
        more = next(chunks, None)
        if more is None:
            if held:
                raise ValueError("the archive ends inside a record")
            return
        held += more


def _write(folder: str, level: int):
    def run(batches):
        out, z, n = None, None, 0
        for whole in batches:
            for b in sub_batches(whole, "html"):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, inner = _fs(path)
                    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out, z = system.open_output_stream(inner, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                for r in b.to_pylist():
                    out.write(z.compress(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"),
                                                r["refers_to"], r["revisit"])))
                    n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})
    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write ``pages`` (page_id, url, html); one row (path, n) per archive."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn(
        "digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    # the digest table is narrow, and only payloads that occur again matter
    same = (p.filter(F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes).groupBy("digest")
            .agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    flagged = (p.join(same, "digest", "left")
               .withColumn("revisit", F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")))
               .select("page_id", "url", "html", F.when(F.col("revisit"), F.col("best")).alias("refers_to"), "revisit"))
    return stored(map_arrow(flagged, _write(folder, level), FILES), "archives")


def _normalise(folder: str, level: int):
    def run(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                system, inner = _fs(path)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                from_system, from_inner = _fs(source)
                at = n = 0
                with (from_system.open_input_stream(from_inner, compression=None) as stream,
                      system.open_output_stream(inner, compression=None) as out,
                      system.open_output_stream(f"{inner}.idx", compression=None) as index):
                    for head, whole in records(inflated(stream)):
                        member = zlib.compress(whole, level, 31)
                        out.write(member)
                        line = {"offset": at, "length": len(member), "type": head["WARC-Type"],
                                "id": head["WARC-Record-ID"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})
    return run


def normalise(archives: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite each archive of (path, n) with a member per record and a sidecar index ``path``.idx."""
    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return stored(map_arrow(spread, _normalise(folder, level), FILES), "normalised")


def _read(with_payload: bool):
    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                system, inner = _fs(path)
                with (system.open_input_stream(f"{inner}.idx", compression=None) as index,
                      system.open_input_file(inner) as archive):
                    rows, held = [], 0
                    for line in _lines(index):
                        at = json.loads(line)
                        archive.seek(at["offset"])
                        whole = zlib.decompress(archive.read(at["length"]), 31)
                        end = whole.index(b"\r\n\r\n")
                        head = parse_head(whole[:end])
                        block = whole[end + 4:end + 4 + int(head["Content-Length"])]
                        kind, payload = head["WARC-Type"], None
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4:]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{path} at {at['offset']}: the payload does not match its digest")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        rows.append({"page_id": number("WARC-X-Page"),
                                     "url": json.loads(head["WARC-X-URL"]) if "WARC-X-URL" in head else None,
                                     "payload_bytes": number("WARC-X-Payload-Length"), "payload_digest": digest,
                                     "record_type": kind, "refers_to": number("WARC-X-Refers-To-Page"),
                                     "payload": payload if with_payload else None, "archive": path,
                                     "offset": at["offset"], "length": at["length"]})
                        held += len(whole)
                        if held >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
    return run


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _lines(stream):
    held = b""
    while chunk := stream.read(CHUNK):
        *whole, held = (held + chunk).split(b"\n")
        yield from whole
    if held:
        yield held


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of normalised archives, opened by their indexes."""
    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return map_arrow(spread, _read(with_payload), RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    mono = write_archives(read_table(spark, sf_dir, "pages"), f"{folder}/monolithic")
    return read_records(normalise(mono, f"{folder}/members"), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
