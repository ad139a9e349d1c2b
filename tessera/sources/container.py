"""The binary container: read from and written to binary columns, for exchange with files at rest in that form.

At scale the engine's own form is Parquet; this is import and export, a document at a time in Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from typing import Any
from uuid import UUID

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.canonical import value_hash
from ..functions.model import StateError, Tagged
from ..functions.pieces import pieces
from .jsonio import dumps, loads
from .text import mapped, parse, write_value

# Fixed values of the format: magic, version, flags, segment kinds, column kinds, value tags, element codes, markers.
MAGIC = b"SX\0"
VERSION = 1
SCHEMA_HASH, LOGICAL_HASH = 1, 2
SEGMENTS = ("envelope", "hot_index", "shape_table", "dictionary", "value_data", "column_data", "tensor_data", "blob_data", "delta_data", "extension", "presence_map")
VALUE_DATA, SHAPE_TABLE, DICTIONARY, HOT_INDEX, PRESENCE_MAP, COLUMN_DATA = 1, 2, 3, 4, 5, 6
DICT, I64, BOOL, F64 = 1, 2, 3, 4
ELEMENT = {"u8": (1, "<B"), "i32": (2, "<i"), "f32": (3, "<f"), "f64": (4, "<d"), "bool": (5, "<?")}
COLUMNAR_ROWS = 64
EVENTS_CODEC, TABLE_CODEC = 1, 2
MARKERS = {EVENTS_CODEC: "$sx.columnar_event_batch.v1", TABLE_CODEC: "$sx.columnar_table.v1"}
DEPTH = 200


def checksum(data: bytes) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:4], "little")


# -- primitives -----------------------------------------------------------------------------------------------------------


_BYTES = [bytes([n]) for n in range(128)]


def put_varint(n: int) -> bytes:
    if 0 <= n < 128:
        return _BYTES[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def put_text(s: str) -> bytes:
    raw = s.encode()
    return put_varint(len(raw)) + raw


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise StateError("unexpected_eof", f"{n} bytes at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> Any:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def varint(self) -> int:
        if self.at < len(self.data) and (b := self.data[self.at]) < 128:
            self.at += 1
            return b
        out = 0
        for shift in range(0, 70, 7):
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                if out >> 64:
                    break
                return out
        raise StateError("invalid_number", "varint")

    def count(self) -> int:
        """A count of things of a byte at least."""
        n = self.varint()
        if n > len(self.data) - self.at:
            raise StateError("unexpected_eof", f"{n} items at {self.at}")
        return n

    def text(self) -> str:
        try:
            return self.take(self.varint()).decode()
        except UnicodeDecodeError:
            raise StateError("invalid_utf8", str(self.at)) from None

    def end(self) -> None:
        if self.at != len(self.data):
            raise StateError("invalid_length", "bytes left over")


def put_bits(flags: list[bool]) -> bytes:
    return bytes(sum(bool(f) << k for k, f in enumerate(flags[i : i + 8])) for i in range(0, len(flags), 8))


# -- values, row by row -----------------------------------------------------------------------------------------------------


def put(v: Any) -> bytes:
    if v is None:
        return b"\x00"
    if isinstance(v, bool):
        return b"\x02" if v else b"\x01"
    if isinstance(v, int):
        return b"\x11" + put_varint((v << 1) ^ (v >> 63))
    if isinstance(v, float):
        return b"\x12" + struct.pack("<d", v)
    if isinstance(v, str):
        return b"\x20" + put_text(v)
    if isinstance(v, list):
        return b"\x30" + put_varint(len(v)) + b"".join(map(put, v))
    if isinstance(v, dict):
        return b"\x40" + put_varint(len(v)) + b"".join(put_text(k) + put(v[k]) for k in sorted(v))
    x = v.value
    if v.kind == "unsigned":
        return b"\x10" + put_varint(x)
    if v.kind == "decimal":
        return b"\x13\x00" + x[0].to_bytes(16, "little", signed=True) + struct.pack("<I", x[1])
    if v.kind == "money":
        return b"\x13\x01" + x[1].to_bytes(16, "little", signed=True) + struct.pack("<I", x[2]) + put_text(x[0])
    if v.kind in ("enum", "url", "email"):
        return b"\x20" + put_text(x)
    if v.kind == "bytes":
        return b"\x22" + put_varint(len(x)) + x
    if v.kind == "typed_array":
        return b"\x31" + _typed(*x)
    if v.kind == "table":
        return b"\x32" + put_varint(len(x)) + b"".join(put_text(k) + (b"\x01" if isinstance(c, Tagged) else b"\x02") + put(c) for k, c in sorted(x.items()))
    if v.kind == "tensor":
        return b"\x33" + put_varint(len(x[0])) + b"".join(map(put_varint, x[0])) + _maybe(x[2], put_text) + put(x[1])
    if v.kind in ("timestamp", "date", "duration"):
        return {"timestamp": b"\x50", "date": b"\x51", "duration": b"\x52"}[v.kind] + put_text(x)
    if v.kind == "uuid":
        return b"\x53" + UUID(x).bytes
    if v.kind == "delta":
        return b"\x60" + put_text(write_value(v))
    if v.kind == "ref":
        return b"\x70" + put_text(x)
    if v.kind == "blob_ref":
        return b"\x71" + put_text(x["uri"]) + _maybe(x.get("media_type"), put_text) + _maybe(x.get("size"), put_varint) + _maybe(x.get("hash"), lambda h: put_varint(len(h)) + h)
    if v.kind == "map":
        return put({write_value(a): b for a, b in x})
    if v.kind == "message":
        return put(x.get("fields") or {})
    raise StateError("unsupported_feature", v.kind)


def _maybe(x: Any, f) -> bytes:
    return b"\x00" if x is None else b"\x01" + f(x)


def _typed(kind: str, items: list) -> bytes:
    code, form = ELEMENT[kind]
    if kind == "bool":
        return bytes([code]) + put_varint(len(items)) + put_bits(items)
    return bytes([code]) + put_varint(len(items)) + b"".join(struct.pack(form, x) for x in items)


def _take_typed(c: Cursor) -> Tagged:
    code = c.take(1)[0]
    kind = next((k for k, (x, _) in ELEMENT.items() if x == code), None)
    if kind is None:
        raise StateError("type_mismatch", f"element {code}")
    if kind == "bool":
        n = c.varint()
        bits = c.take((n + 7) // 8)
        return Tagged("typed_array", (kind, [bool(bits[i >> 3] >> (i & 7) & 1) for i in range(n)]))
    return Tagged("typed_array", (kind, [c.unpack(ELEMENT[kind][1]) for _ in range(c.count())]))


def take(c: Cursor, depth: int = 0) -> Any:
    if depth > DEPTH:
        raise StateError("invalid_length", "too deep")
    tag = c.take(1)[0]
    inner = lambda: take(c, depth + 1)
    if tag in (0x00, 0x01, 0x02):
        return (None, False, True)[tag]
    if tag == 0x10:
        return Tagged("unsigned", c.varint())
    if tag == 0x11:
        n = c.varint()
        return (n >> 1) ^ -(n & 1)
    if tag == 0x12:
        return c.unpack("<d")
    if tag == 0x13:
        flavour, scaled, scale = c.take(1)[0], int.from_bytes(c.take(16), "little", signed=True), c.unpack("<I")
        return Tagged("money", (c.text(), scaled, scale)) if flavour else Tagged("decimal", (scaled, scale))
    if tag == 0x20:
        return c.text()
    if tag == 0x22:
        return Tagged("bytes", c.take(c.varint()))
    if tag == 0x30:
        return [inner() for _ in range(c.count())]
    if tag == 0x31:
        return _take_typed(c)
    if tag == 0x32:
        out = {}
        for _ in range(c.count()):
            name = c.text()
            c.take(1)
            out[name] = inner()
        return Tagged("table", out)
    if tag == 0x33:
        shape = [c.varint() for _ in range(c.count())]
        layout = c.text() if c.take(1)[0] else None
        return Tagged("tensor", (shape, inner(), layout))
    if tag == 0x40:
        out = {}
        for _ in range(c.count()):
            if (key := c.text()) in out:
                raise StateError("duplicate_key", key)
            out[key] = inner()
        return out
    if tag in (0x50, 0x51, 0x52):
        return Tagged(("timestamp", "date", "duration")[tag - 0x50], c.text())
    if tag == 0x53:
        return Tagged("uuid", str(UUID(bytes=c.take(16))))
    if tag == 0x60:
        return parse(c.text())
    if tag == 0x70:
        return Tagged("ref", c.text())
    if tag == 0x71:
        uri = c.text()
        media = c.text() if c.take(1)[0] else None
        size = c.varint() if c.take(1)[0] else None
        return Tagged("blob_ref", {"uri": uri, "media_type": media, "size": size, "hash": c.take(c.varint()) if c.take(1)[0] else None})
    raise StateError("validation_error", f"tag {tag:#x}")


# -- columns --------------------------------------------------------------------------------------------------------------


def _column(values: list) -> tuple[int, bytes] | None:
    """Kind and data of a column that has one of the four forms."""
    n = put_varint(len(values))
    kinds = {type(v) for v in values}
    if kinds == {str}:
        ids: dict[str, int] = {}
        rows = [ids.setdefault(v, len(ids)) for v in values]
        return DICT, put_varint(len(ids)) + b"".join(map(put_text, ids)) + n + b"".join(map(put_varint, rows))
    if kinds == {bool}:
        bits = put_bits(values)
        return BOOL, n + put_varint(len(bits)) + bits
    if kinds == {int}:
        return I64, n + struct.pack(f"<{len(values)}q", *values)
    if kinds == {float}:
        return F64, n + struct.pack(f"<{len(values)}d", *values)
    return None


def columnar(v: Any) -> tuple[int, bytes] | None:
    """Codec and payload of an event batch or table of 64 rows or more with uniform columns, else None."""
    if isinstance(v, list) and len(v) >= COLUMNAR_ROWS and all(isinstance(x, dict) and x.keys() == v[0].keys() for x in v) and v[0]:
        codec, rows, columns = EVENTS_CODEC, len(v), {k: [x[k] for x in v] for k in sorted(v[0])}
    elif isinstance(v, Tagged) and v.kind == "table" and v.value:
        columns = {k: c.value[1] if isinstance(c, Tagged) else c for k, c in sorted(v.value.items())}
        codec, rows = TABLE_CODEC, len(next(iter(columns.values())))
        if rows < COLUMNAR_ROWS or any(len(c) != rows for c in columns.values()):
            return None
    else:
        return None
    parts = {k: _column(c) for k, c in columns.items()}
    if not all(parts.values()):
        return None
    head = bytes([1]) + put_varint(rows) + put_varint(len(parts))
    return codec, head + b"".join(put_varint(i) + put_text(k) + bytes([kind]) + data for i, (k, (kind, data)) in enumerate(parts.items(), 1))


def take_columns(payload: bytes, only: str | None = None) -> tuple[int, dict[str, list]]:
    """Rows and columns; with only, that column alone is decoded, and what stands before it is skipped."""
    c = Cursor(payload)
    if c.take(1)[0] != 1:
        raise StateError("unsupported_version", "columns")
    rows, out = c.varint(), {}
    for _ in range(c.varint()):
        c.varint()
        name, kind = c.text(), c.take(1)[0]
        wanted = only is None or name == only
        if kind == DICT:
            words = [c.text() for _ in range(c.count())]
            ids = [c.varint() for _ in range(c.count())]
            n = len(ids)
            if wanted:
                if any(i >= len(words) for i in ids):
                    raise StateError("invalid_dictionary_ref", name)
                out[name] = [words[i] for i in ids]
        elif kind in (I64, F64):
            n = c.varint()
            raw = c.take(8 * n)
            if wanted:
                out[name] = list(struct.unpack(f"<{n}{'q' if kind == I64 else 'd'}", raw))
        elif kind == BOOL:
            n = c.varint()
            bits = c.take(c.varint())
            if len(bits) != (n + 7) // 8:
                raise StateError("invalid_length", name)
            if wanted:
                out[name] = [bool(bits[i >> 3] >> (i & 7) & 1) for i in range(n)]
        else:
            raise StateError("type_mismatch", f"column kind {kind}")
        if n != rows:
            raise StateError("invalid_length", name)
        if only is not None and wanted:
            return rows, out
    c.end()
    return rows, out


# -- the container ------------------------------------------------------------------------------------------------------------


def _strings(v: Any, keys: set, shapes: set) -> None:
    if isinstance(v, str):
        keys.add(v)
    elif isinstance(v, list):
        for x in v:
            _strings(x, keys, shapes)
    elif isinstance(v, Tagged) and v.kind == "table":
        shapes.add(tuple(sorted(v.value)))
    elif isinstance(v, dict):
        keys.update(v)
        shapes.add(tuple(sorted(v)))
        for x in v.values():
            _strings(x, keys, shapes)


def encode(v: Any, schema_hash: bytes | None = None, logical_hash: bytes | None = None) -> bytes:
    words, shapes = set(), set()
    _strings(v, words, shapes)
    block = columnar(v)
    segments = [(VALUE_DATA, "value_data", 0, put(MARKERS[block[0]] if block else v))]
    segments.append((SHAPE_TABLE, "shape_table", 0, put_varint(len(shapes)) + b"".join(put_text(",".join(s)) for s in sorted(shapes))))
    segments.append((DICTIONARY, "dictionary", 0, put_varint(len(words)) + b"".join(map(put_text, sorted(words)))))
    if isinstance(v, dict):
        segments.append((HOT_INDEX, "hot_index", 0, put_varint(len(v)) + b"".join(put_text(k) + put_varint(i) + put_varint(0) for i, k in enumerate(sorted(v)))))
    if isinstance(v, Tagged) and v.kind == "table":
        maps = [(k, [x is not None for x in (c.value[1] if isinstance(c, Tagged) else c)]) for k, c in sorted(v.value.items())]
        segments.append((PRESENCE_MAP, "presence_map", 0, put_varint(len(maps)) + b"".join(put_text(k) + put_varint(len(m)) + put_varint(len(put_bits(m))) + put_bits(m) for k, m in maps)))
    if block:
        segments.append((COLUMN_DATA, "column_data", block[0], block[1]))
    flags = SCHEMA_HASH * (schema_hash is not None) | LOGICAL_HASH * (logical_hash is not None)
    extra = (schema_hash or b"") + (logical_hash or b"")
    at = 11 + len(extra) + 16 * len(segments)
    total = at + sum(len(s[3]) for s in segments)
    if total >= 1 << 32:
        raise StateError("message_too_large", str(total))
    out = MAGIC + struct.pack("<BBIH", VERSION, flags, total, len(segments)) + extra
    for number, kind, codec, body in segments:
        out += struct.pack("<HBBIII", number, SEGMENTS.index(kind) + 1, codec, at, len(body), checksum(body))
        at += len(body)
    return out + b"".join(s[3] for s in segments)


def segments_of(data: bytes) -> list[tuple[int, str, int, bytes]]:
    """Number, kind, codec and body of each segment, all checked."""
    c = Cursor(data)
    if data[:3] != MAGIC:
        raise StateError("invalid_magic")
    c.take(3)
    if (version := c.take(1)[0]) != VERSION:
        raise StateError("unsupported_version", str(version))
    flags, total, n = c.take(1)[0], c.unpack("<I"), c.unpack("<H")
    if total != len(data):
        raise StateError("invalid_length", f"{total} of {len(data)} bytes")
    c.take(32 * ((flags & 1) + (flags >> 1 & 1)))
    out: list[tuple[int, str, int, bytes]] = []
    for _ in range(n):
        number, kind, codec, at, size, told = struct.unpack("<HBBIII", c.take(16))
        if at + size > total or at < 11:
            raise StateError("segment_out_of_bounds", str(number))
        name = SEGMENTS[kind - 1] if 1 <= kind <= len(SEGMENTS) else None
        if name in (None, "extension"):
            if codec & 128:
                raise StateError("unsupported_feature", f"extension {number}")
            continue
        body = data[at : at + size]
        if checksum(body) != told:
            raise StateError("checksum_failed", str(number))
        if name in _LISTS:
            _check_texts(body, _LISTS[name], number)
        out.append((number, name, codec, body))
    return out


#: Segments that are lists of texts, and the error of a bad one.
_LISTS = {"dictionary": "invalid_dictionary_ref", "shape_table": "invalid_shape_ref"}


def _check_texts(body: bytes, error: str, number: int) -> None:
    c = Cursor(body)
    try:
        for _ in range(c.count()):
            c.text()
        c.end()
    except StateError as e:
        raise StateError(error, f"segment {number}: {e.message}") from None


def hashes_of(data: bytes) -> tuple[bytes | None, bytes | None]:
    """The schema hash and the logical hash that the header tells."""
    flags, at = data[4], 11
    out: list[bytes | None] = []
    for flag in (SCHEMA_HASH, LOGICAL_HASH):
        out.append(data[at : at + 32] if flags & flag else None)
        at += 32 * bool(flags & flag)
    return out[0], out[1]


def decode(data: bytes, check_hash: bool = False) -> Any:
    """check_hash: the logical hash that the header tells, if any, must be that of the value."""
    value = _decode(data)
    if check_hash and (told := hashes_of(data)[1]) is not None and told.hex() != value_hash(value):
        raise StateError("validation_error", "logical hash")
    return value


def _decode(data: bytes) -> Any:
    parts = segments_of(data)
    for _, kind, codec, body in parts:
        if kind == "column_data" and codec in MARKERS:
            rows, columns = take_columns(body)
            return [dict(zip(columns, x, strict=True)) for x in zip(*columns.values(), strict=True)] if codec == EVENTS_CODEC else Tagged("table", columns)
    body = next((b for _, kind, _, b in parts if kind == "value_data"), None)
    if body is None:
        raise StateError("unexpected_eof", "no value")
    c = Cursor(body)
    out = take(c)
    c.end()
    return out


def field_values(data: bytes, name: str) -> list:
    """One field of an event batch: the other columns are skipped; rows that lack it are left out."""
    for _, kind, codec, body in segments_of(data):
        if kind == "column_data" and codec == EVENTS_CODEC:
            return take_columns(body, name)[1].get(name, [])
    whole = decode(data)
    return [x[name] for x in whole if isinstance(x, dict) and name in x] if isinstance(whole, list) else []


def count_greater(data: bytes, name: str, value: float) -> int:
    """How many values of a table's numeric column are greater, from that column alone."""
    columns = next((take_columns(b, name)[1] for _, k, codec, b in segments_of(data) if k == "column_data" and codec == TABLE_CODEC), None)
    if columns is None:
        whole = decode(data)
        columns = {k: c.value[1] if isinstance(c, Tagged) else c for k, c in whole.value.items()} if isinstance(whole, Tagged) and whole.kind == "table" else {}
    if name not in columns:
        raise StateError("invalid_path", "no such column", name)
    if any(isinstance(x, (str, bool)) for x in columns[name]):
        raise StateError("type_mismatch", "not numeric", name)
    return sum(isinstance(x, (int, float)) and not math.isnan(x) and x > value for x in columns[name])


# -- columns of containers ----------------------------------------------------------------------------------------------------


def is_container(path, content):
    """Of the columns of the binaryFile source."""
    return path.endswith(".sxb") | (F.substr(content, F.lit(1), F.lit(3)) == F.lit(MAGIC))


def _mapped(df: DataFrame, key: str, column: str, kind: str, f) -> DataFrame:
    own = df.schema[key].dataType.simpleString()
    arrow = {"string": pa.string(), "binary": pa.binary()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for x in batch.column(1).to_pylist():
                try:
                    rows.append((None if x is None else f(x), None))
                except StateError as e:
                    rows.append((None, e.code))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], arrow), pa.array([r[1] for r in rows], pa.int32())], [key, "value", "error_code"])

    return df.select(key, column).mapInArrow(run, f"{key} {own}, value {kind}, error_code int")


def read(df: DataFrame, key: str, column: str, check_hash: bool = False) -> DataFrame:
    """key, value (tagged JSON), error_code of a binary column."""
    return _mapped(df, key, column, "string", lambda x: dumps(decode(bytes(x), check_hash)))


#: Rows of containers that are handed on at once, or those of one container, if it has more.
_LISTED = 8192


def _listed(df: DataFrame, key: str, column: str, schema: str, f) -> DataFrame:
    """key, the columns of schema, error_code: the rows that f makes of each container, or one with its error."""
    kind = df.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]
    own = df.select(key, column).limit(0).selectExpr(*[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in schema.split(", ")]).schema
    arrow = [to_arrow_type(t.dataType) for t in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            places, rows, codes = [], [], []
            for i, x in enumerate(batch.column(1)):
                try:
                    new, code = ([] if not x.is_valid else f(x.as_py())), None
                except StateError as e:
                    new, code = [(None,) * len(names)], e.code
                places += [i] * len(new)
                rows += new
                codes += [code] * len(new)
                if len(rows) >= _LISTED:
                    yield told(batch, places, rows, codes)
                    places, rows, codes = [], [], []
            yield told(batch, places, rows, codes)

    def told(batch: pa.RecordBatch, places: list, rows: list, codes: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], pa.array(codes, pa.int32())], [key, *names, "error_code"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, {schema}, error_code int")


def segments(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, number, kind, codec, size, error_code: the checked segments of the containers of a binary column."""
    return _listed(df, key, column, "number int, kind string, codec int, size long", lambda x: [(a, b, c, len(d)) for a, b, c, d in segments_of(x)])


def hot_values(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """key, row_no, value (JSON), error_code: one field of the event batches of a binary column; other columns are skipped."""
    return _listed(df, key, column, "row_no int, value string", lambda x: [(i, dumps(v)) for i, v in enumerate(field_values(x, name))])


def counts_above(df: DataFrame, key: str, column: str, name: str, value: float) -> DataFrame:
    """key, n, error_code: how many values of a numeric column are greater, in each of the tables of a binary column."""
    return _listed(df, key, column, "n long", lambda x: [(count_greater(x, name, value),)])


def write(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, value (container), error_code of a column of tagged JSON."""
    return _mapped(df, key, column, "binary", lambda x: encode(loads(x)))


def there_and_back(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, value, error_code, error_path: tagged JSON to a container, to text, and back; the first error is told.

    As read() and write() do one after the other, but in one pass: each pass has a Python worker of its own in every task.
    """
    return mapped(df, key, column, lambda x: dumps(parse(write_value(loads(dumps(decode(encode(loads(x)))))))))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, value (tagged JSON), error_code of the container files under a path."""
    return read(spark.read.format("binaryFile").load(path), "path", "content")


def load(spark: SparkSession, path: str) -> DataFrame:
    """path, value (tagged JSON), error_code of all files under a path, text or binary."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", is_container(F.col("path"), F.col("content")).alias("_b"))
    from . import text

    a = read(files.where("_b"), "path", "content")
    b = text.read(files.where("not _b").select("path", F.decode("content", "UTF-8").alias("content")), "path", "content").drop("error_path")
    return a.unionByName(b)
