"""ARFF as a data source (S5): ``spark.read.format("arff").load(path)``.

A file is a text header (``@attribute name type``) and, after ``@data``, a row per line.
The driver reads the first file's header for the schema; tasks read byte ranges
of the files, each line by the range it begins in, and every file by the header of its own, which must
name the same attributes. Plain lines are parsed in blocks by Arrow's CSV
reader; blocks with sparse rows, comments or both kinds of quotes line by line.

Numeric, real and integer attributes become double; nominal (``{a,b}``), string and
date attributes become text (decode and cast later, P14 and P15). ``?`` is a missing value. A sparse row ``{i v, ...}``
leaves out zeros: 0 in numeric attributes, the first value in nominal ones, the empty text in strings. Names and values may
stand in single or double quotes, with backslash escapes. A line that does not fit fails the read,
or is left out with ``option("mode", "DROPMALFORMED")``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import workers_import
from .files import listed, opened, ranges

RANGE_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
HEADER_BYTES = 1 << 20
_ATTRIBUTE = re.compile(r"""^@attribute\s+('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S+)\s+(.+?)\s*$""", re.I)
_NUMERIC = ("numeric", "real", "integer")


@dataclass(frozen=True)
class Attribute:
    name: str
    numeric: bool
    values: tuple[str, ...] | None = None      # of a nominal attribute

    @property
    def zero(self):
        """What a sparse row leaves out."""
        return 0.0 if self.numeric else self.values[0] if self.values else ""


def unquoted(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text


def fields(line: str, cut: str = ",") -> list[str]:
    """A line's fields; quotes and escapes stay for ``unquoted``."""
    out, start, quote, k = [], 0, "", 0
    while k < len(line):
        c = line[k]
        if c == "\\" and quote:
            k += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and not line[start:k].strip():
            quote = c
        elif c == cut:
            out.append(line[start:k])
            start = k + 1
        k += 1
    if quote:
        raise ValueError("a quote is not closed")
    return [*out, line[start:]]


def attribute(line: str) -> Attribute:
    m = _ATTRIBUTE.match(line)
    if not m:
        raise ValueError(f"not an attribute: {line!r}")
    name, kind = unquoted(m[1]), m[2]
    if kind.startswith("{"):
        return Attribute(name, False, tuple(unquoted(v) for v in fields(kind.strip().strip("{}"))))
    word = kind.split()[0].lower()
    if word not in (*_NUMERIC, "string", "date"):
        raise ValueError(f"attributes of type {word} are not read")
    return Attribute(name, word in _NUMERIC)


def header(path: str) -> tuple[list[Attribute], int]:
    """(attributes, where the data begins)."""
    store, at = opened(path)
    out, pos = [], 0
    with store.open_input_stream(at) as f:
        held = b""
        while True:
            new = f.read(HEADER_BYTES)
            held += new
            lines = held.split(b"\n")
            held = lines.pop()
            if not new and held:
                lines, held = [*lines, held], b""
            for raw in lines:
                pos += len(raw) + 1
                line = raw.decode("utf-8", "replace").strip()
                if line.lower().startswith("@attribute"):
                    out.append(attribute(line))
                elif line.lower().startswith("@data"):
                    if not out:
                        raise ValueError(f"no attributes in {path}")
                    return out, pos
            if not new:
                raise ValueError(f"no data section in {path}")


def row(line: str, attributes: list[Attribute]) -> list:
    """The values of one line."""
    line = line.strip()
    if line.startswith("{"):
        body = line[1:line.rindex("}")].strip()
        out = [a.zero for a in attributes]
        for part in fields(body) if body else []:
            i, _, v = part.strip().partition(" ")
            out[int(i)] = _value(v, attributes[int(i)])
        return out
    parts = fields(line)
    if len(parts) != len(attributes):
        raise ValueError(f"{len(parts)} values for {len(attributes)} attributes")
    return [_value(v, a) for v, a in zip(parts, attributes, strict=True)]


def _value(text: str, a: Attribute):
    if text.strip() == "?":
        return None
    return float(unquoted(text)) if a.numeric else unquoted(text)


def _arrow(attributes: list[Attribute]) -> pa.Schema:
    return pa.schema([(a.name, pa.float64() if a.numeric else pa.string()) for a in attributes])


def block(text: bytes, attributes: list[Attribute], drop: bool) -> pa.RecordBatch | None:
    """The rows of whole lines."""
    schema = _arrow(attributes)
    if b"{" not in text and b"%" not in text and b"\\" not in text and not (b"'" in text and b'"' in text) and not drop:
        quote = "'" if b"'" in text else '"' if b'"' in text else False
        try:
            t = csv.read_csv(pa.BufferReader(text), read_options=csv.ReadOptions(column_names=schema.names, block_size=2 * len(text) + 1024),
                             parse_options=csv.ParseOptions(quote_char=quote, double_quote=False, ignore_empty_lines=True),
                             convert_options=csv.ConvertOptions(column_types=schema, null_values=["?"], strings_can_be_null=True,
                                                                quoted_strings_can_be_null=False))
            cols = [pc.utf8_trim_whitespace(c) if not quote and pa.types.is_string(c.type) else c for c in t.columns]
            got = pa.table(cols, schema=schema).combine_chunks().to_batches()
            return got[0] if got else None
        except pa.ArrowInvalid:
            pass                # blanks about numbers and the like: line by line
    rows = []
    for line in text.decode("utf-8", "replace").splitlines():
        if not line.strip() or line.lstrip().startswith("%"):
            continue
        try:
            rows.append(row(line, attributes))
        except (ValueError, IndexError) as e:
            if not drop:
                raise ValueError(f"{e}: {line[:200]!r}") from None
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    data: int

    def __init__(self, path: str, start: int, end: int, data: int):
        self.path, self.start, self.end, self.data = path, start, end, data


class ArffReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.drop = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"
        self.attributes, _ = header(listed(path)[0][0])

    def partitions(self) -> list[InputPartition]:
        out = []
        files = listed(self.path)
        for path, _ in files:
            own, data = header(path)
            if [(a.name, a.numeric) for a in own] != [(a.name, a.numeric) for a in self.attributes]:
                raise ValueError(f"{path} has other attributes than {files[0][0]}")
            out += [Piece(p, max(a, data), b, data) for p, a, b in ranges([x for x in files if x[0] == path], self.bytes) if b > data]
        return out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:       # no rows at all
            return
        attributes, _ = header(piece.path)
        store, at = opened(piece.path)
        with store.open_input_file(at) as f:
            pos, held = piece.start, b""
            if pos > piece.data:              # the line that began before belongs to the piece before
                f.seek(pos - 1)
                pos, held = _next_line(f, pos - 1)
            f.seek(pos + len(held))
            while pos < piece.end:
                new = f.read(min(BLOCK_BYTES, max(piece.end - pos - len(held), 0)) or HEADER_BYTES)
                held += new
                last = not new
                cut = len(held) if last else held.rfind(b"\n") + 1
                if pos + cut > piece.end:     # up to the end of the last line that begins here
                    inner = held.find(b"\n", max(piece.end - pos - 1, 0))
                    cut = inner + 1 if inner >= 0 else (len(held) if last else 0)
                if cut:
                    got = block(held[:cut], attributes, self.drop)
                    if got is not None:
                        yield got
                    pos, held = pos + cut, held[cut:]
                if last:
                    return


def _next_line(f, pos: int) -> tuple[int, bytes]:
    """(where the first line that begins after ``pos`` starts, what was read of it)."""
    while True:
        new = f.read(1 << 16)
        at = new.find(b"\n")
        if at >= 0:
            return pos + at + 1, new[at + 1:]
        if not new:
            return pos, b""
        pos += len(new)


class ArffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arff"

    def schema(self) -> T.StructType:
        attributes, _ = header(listed(self.options["path"])[0][0])
        return T.StructType([T.StructField(a.name, T.DoubleType() if a.numeric else T.StringType()) for a in attributes])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArffReader(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    workers_import(spark)
    spark.dataSource.register(ArffSource)


def read_arff(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of an ARFF file, or of all files of a folder."""
    register(spark)
    return spark.read.format("arff").options(**options).load(path)


def write_arff(df: DataFrame, path: str, relation: str = "data", files: int = 1) -> None:
    """ARFF files below ``path`` (numbers numeric, all else string), each with the header; for copies and tests."""
    kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

    def quoted(name: str) -> str:
        return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
    head = [f"@relation {quoted(relation)}", *[
        f"@attribute {quoted(f.name)} {'numeric' if isinstance(f.dataType, kinds) else 'string'}" for f in df.schema.fields], "@data"]
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`").cast("string")
        if not isinstance(f.dataType, kinds):
            c = F.concat(F.lit("'"), F.regexp_replace(c, r"(['\\])", r"\\$1"), F.lit("'"))
        cells.append(F.coalesce(c, F.lit("?")))
    rows = df.select(F.pmod(F.xxhash64(*cells), F.lit(files)).alias("file"), F.lit(1).alias("o"), F.concat_ws(",", *cells).alias("value"))
    first = df.sparkSession.range(files).select(F.col("id").alias("file"), F.lit(0).alias("o"), F.lit("\n".join(head)).alias("value"))
    (rows.union(first).repartition("file").sortWithinPartitions("file", "o").select("file", "value")
     .write.mode("overwrite").partitionBy("file").text(path))
