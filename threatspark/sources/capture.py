"""Packet captures as a data source (S10, S11, R1): ``spark.read`` and ``spark.readStream`` of format "pcap".

A capture file has a 24-byte header and records of a 16-byte header (seconds, fraction, bytes
kept, bytes sent) and the bytes of a frame. Tasks read byte ranges; a record belongs to the
range that its header begins in, and a range that begins inside a record looks for the next place from which ``CHAIN``
records follow one another plausibly. Fields come from the raw bytes: Ethernet, IPv4,
and TCP or UDP ports and TCP flags.

As a stream, the offset is the end of the last whole record of every file. A record that is still
being written waits for the next batch; files may grow and new ones appear. Spark keeps the offsets in its
checkpoint, so after a restart nothing is lost or read twice.

Written by ``df.write.format("pcap")``: a capture file per task, by the fields of ``SCHEMA`` that are there.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition,
                                    WriterCommitMessage)

from ..session import workers_import
from .files import listed, opened, ranges

SCHEMA = ("file string, packet_id bigint, ts timestamp, src_ip string, dst_ip string, proto string, sport int, dport int, "
          "flags string, length bigint")
# Fixed values of the file format: magic numbers and their byte order and fractions of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
         b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}
FILE_HEADER, RECORD_HEADER = 24, 16
ETHERNET, IPV4 = 1, 0x0800
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp"}
FLAGS = "FSRPAUEC"
RANGE_BYTES = 32 << 20
READ_BYTES = 4 << 20
#: A record's most bytes, records that must follow one another, and seconds that they may lie apart, for a place to be a record's start.
MOST_BYTES, CHAIN, APART = 1 << 18, 4, 7 * 86_400
BATCH_ROWS = 10_000


@dataclass(frozen=True)
class Kind:
    order: str
    fraction: int

    @property
    def record(self) -> struct.Struct:
        return struct.Struct(f"{self.order}IIII")


def kind_of(head: bytes) -> Kind:
    if len(head) < FILE_HEADER or head[:4] not in MAGIC:
        raise ValueError("not a packet capture")
    kind = Kind(*MAGIC[head[:4]])
    if struct.unpack(f"{kind.order}I", head[20:24])[0] & 0xFFFF != ETHERNET:
        raise ValueError("only Ethernet captures are read")
    return kind


def plausible(data: bytes, at: int, kind: Kind, whole: bool) -> bool:
    """Whether records follow one another from ``at``: ``CHAIN`` of them, or all to the end of the data if that is the file's."""
    seconds = None
    for _ in range(CHAIN):
        if at == len(data):
            return whole
        if at + RECORD_HEADER > len(data):
            return whole and seconds is not None and len(data) - at < RECORD_HEADER
        sec, fraction, kept, sent = kind.record.unpack_from(data, at)
        if fraction >= kind.fraction or not 0 < kept <= sent <= MOST_BYTES:
            return False
        if seconds is not None and abs(sec - seconds) > APART:
            return False
        seconds = sec
        at += RECORD_HEADER + kept
        if at > len(data):
            return whole        # the last record, still being written
    return True


def first_record(f, start: int, size: int, kind: Kind) -> int:
    """Where the first record at or after ``start`` begins; ``size`` if none does."""
    window = CHAIN * (MOST_BYTES + RECORD_HEADER)
    f.seek(start)
    data = f.read(min(2 * window, size - start))
    whole = start + len(data) >= size
    for at in range(min(len(data), window)):
        if plausible(data, at, kind, whole):
            return start + at
    return size


def whole_end(f, start: int, size: int, kind: Kind) -> int:
    """Where the last whole record ends, from a record's start; far ends are looked up from near the file's end."""
    near = size - 4 * CHAIN * (MOST_BYTES + RECORD_HEADER)
    at = first_record(f, near, size, kind) if near > start else start
    if at >= size and near > start:
        at = start
    while at + RECORD_HEADER <= size:
        f.seek(at)
        _, _, kept, _ = kind.record.unpack(f.read(RECORD_HEADER))
        if at + RECORD_HEADER + kept > size:
            break
        at += RECORD_HEADER + kept
    return at


def packet(frame: bytes) -> tuple:
    """(source, destination, protocol, source port, destination port, flags); None what a frame does not have."""
    if len(frame) < 34 or struct.unpack(">H", frame[12:14])[0] != IPV4:
        return None, None, None, None, None, None
    size, number = (frame[14] & 15) * 4, frame[23]
    src, dst = (".".join(map(str, frame[k:k + 4])) for k in (26, 30))
    proto, sport, dport, flags = PROTOCOLS.get(number, str(number)), None, None, None
    at = 14 + size
    if number in (6, 17) and len(frame) >= at + 4:
        sport, dport = struct.unpack(">HH", frame[at:at + 4])
        if number == 6 and len(frame) > at + 13:
            flags = "".join(c for k, c in enumerate(FLAGS) if frame[at + 13] >> k & 1)
    return src, dst, proto, sport, dport, flags


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(),
             pa.string(), pa.int64())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    exact: bool      # start is a record's

    def __init__(self, path: str, start: int, end: int, exact: bool):
        self.path, self.start, self.end, self.exact = path, start, end, exact


def records(piece: Piece | None) -> Iterator[pa.RecordBatch]:
    """The packets whose records begin in a piece and end within the file."""
    if piece is None:           # no records at all
        return
    store, path = opened(piece.path)
    with store.open_input_file(path) as f:
        size = f.size()
        kind = kind_of(f.read(FILE_HEADER))
        at = piece.start if piece.exact else first_record(f, piece.start, size, kind)
        rows, held, base = [], b"", at
        while at < piece.end:
            k = at - base
            need = RECORD_HEADER if len(held) - k < RECORD_HEADER else RECORD_HEADER + kind.record.unpack_from(held, k)[2]
            if len(held) - k < need:
                f.seek(base + len(held))
                new = f.read(max(READ_BYTES, need))
                if not new:
                    break       # still being written
                held, base = held[k:] + new, at
                continue
            sec, fraction, kept, sent = kind.record.unpack_from(held, k)
            frame = held[k + RECORD_HEADER:k + RECORD_HEADER + kept]
            rows.append((piece.path, at, sec * 1_000_000 + fraction * 1_000_000 // kind.fraction, *packet(frame), sent))
            at += RECORD_HEADER + kept
            if len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def pieces(path: str, start: int, end: int, most: int) -> list[Piece]:
    """A file's pieces; ``start`` is a record's."""
    return [Piece(p, start + a, start + b, a == 0) for p, a, b in ranges([(path, end - start)], most)]


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[InputPartition]:
        return [x for p, n in listed(self.path) if n > FILE_HEADER for x in pieces(p, FILE_HEADER, n, self.bytes)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return records(piece)


class CaptureStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.most = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 1 << 40)))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        out = dict(self.seen)
        for path, size in listed(self.path):
            start = out.get(path, FILE_HEADER)
            if size <= FILE_HEADER:
                continue
            store, at = opened(path)
            with store.open_input_file(at) as f:
                kind = kind_of(f.read(FILE_HEADER))
                out[path] = max(start, whole_end(f, start, min(size, start + self.most), kind))
        self.seen = out
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        for p, b in new.items():             # after a restart: what the checkpoint has seen
            self.seen[p] = max(self.seen.get(p, FILE_HEADER), b)
        return [x for p, b in sorted(new.items()) if b > old.get(p, FILE_HEADER) for x in pieces(p, old.get(p, FILE_HEADER), b, self.bytes)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return records(piece)


@dataclass
class Written(WriterCommitMessage):
    path: str

    def __init__(self, path: str):
        self.path = path


def frame_of(r: dict) -> bytes:
    """An Ethernet frame with the row's addresses, ports and flags; the rest is zero."""
    number = {v: k for k, v in PROTOCOLS.items()}.get(r.get("proto") or "tcp", 255)
    ips = [bytes(int(x) for x in (r.get(c) or "0.0.0.0").split(".")) for c in ("src_ip", "dst_ip")]
    body = b""
    if number == 6:
        flags = sum(1 << FLAGS.index(c) for c in set(r.get("flags") or "") if c in FLAGS)
        body = struct.pack(">HHIIBBHHH", r.get("sport") or 0, r.get("dport") or 0, 0, 0, 5 << 4, flags, 0, 0, 0)
    elif number == 17:
        body = struct.pack(">HHHH", r.get("sport") or 0, r.get("dport") or 0, 8, 0)
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0) + ips[0] + ips[1]
    return bytes(12) + struct.pack(">H", IPV4) + ip + body


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        path = f"{root}/part-{uuid.uuid4().hex}.pcap"
        with store.open_output_stream(path) as f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, MOST_BYTES, ETHERNET))
            for b in batches:
                for r in b.to_pylist():
                    frame = frame_of(r)
                    us = round(r["ts"].timestamp() * 1_000_000) if r.get("ts") else 0
                    sent = max(len(frame), min(int(r.get("length") or 0), MOST_BYTES))
                    f.write(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), sent) + frame)
        return Written(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CaptureWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    workers_import(spark)
    spark.dataSource.register(CaptureSource)
