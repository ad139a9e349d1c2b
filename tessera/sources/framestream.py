"""Frame files: a source and sink of framed streams, in batch and Structured Streaming, by the Python Data Source API.

Paths are those of any file system that Arrow opens: a plain path or file:, hdfs:, s3: and so on. Files are read a frame at a
time. A task writes its frames to files of bounded size in a staging folder; only the commit of the whole job moves them to
their place, so that a task that is tried again, or a job that fails, leaves nothing behind.
"""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..functions.model import StateError
from ..operators.frames import FRAME_KINDS
from .container import Cursor, checksum

# Fixed value of the format.
MAGIC = b"SXS1"
SCHEMA = "kind string, message_id string, chunk_index long, chunk_count long, segment_id long, offset long, length long, checksum long, payload binary"


def pack(frames: list[dict]) -> bytes:
    out = [MAGIC, struct.pack("<I", len(frames))]
    for f in frames:
        if f["kind"] not in FRAME_KINDS:
            raise StateError("type_mismatch", f"frame {f['kind']}")
        has = f.get("message_id") is not None
        out.append(struct.pack("<BB", FRAME_KINDS.index(f["kind"]) + 1, has))
        payload = bytes(f["payload"])
        if has:
            raw = f["message_id"].encode()
            out.append(struct.pack("<I", len(raw)) + raw + struct.pack("<IIIQII", f["chunk_index"], f["chunk_count"], f["segment_id"], f["offset"], len(payload), checksum(payload)))
        out.append(struct.pack("<II", len(payload), checksum(payload)) + payload)
    return b"".join(out)


class _Source:
    """Exact reads of a file, or an error of the format."""

    def __init__(self, file: BinaryIO):
        self.file = file

    def take(self, n: int) -> bytes:
        out = self.file.read(n)
        if len(out) < n:
            raise StateError("unexpected_eof", f"{n} bytes")
        return out

    def unpack(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]


def unpack(data: bytes | BinaryIO) -> Iterator[dict]:
    """Frames up to the declared count, one at a time; what follows is ignored."""
    c = Cursor(data) if isinstance(data, (bytes, bytearray)) else _Source(data)
    try:
        magic = c.take(4)
    except StateError:
        magic = b""
    if magic != MAGIC:
        raise StateError("invalid_magic")
    for _ in range(c.unpack("<I")):
        kind, has = c.take(1)[0], c.take(1)[0]
        if not 1 <= kind <= len(FRAME_KINDS):
            raise StateError("type_mismatch", f"frame {kind}")
        f = dict.fromkeys(("message_id", "chunk_index", "chunk_count", "segment_id", "offset", "length", "checksum"))
        if has:
            f["message_id"] = c.take(c.unpack("<I")).decode()
            f |= {k: c.unpack(form) for k, form in (("chunk_index", "<I"), ("chunk_count", "<I"), ("segment_id", "<I"), ("offset", "<Q"), ("length", "<I"), ("checksum", "<I"))}
        size, told = c.unpack("<I"), c.unpack("<I")
        payload = c.take(size)
        if checksum(payload) != told or (has and f["checksum"] != told):
            raise StateError("checksum_failed", str(f["message_id"]))
        if has and f["length"] != size:
            raise StateError("invalid_length", str(f["message_id"]))
        yield {"kind": FRAME_KINDS[kind - 1], **f, "payload": payload}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.rstrip("/")


def _names(path: str) -> list[str]:
    """The frame files of a folder in the order of their names, which is that of their commits; or the file itself."""
    system, base = _opened(path)
    told = system.get_file_info(base)
    if told.type == fs.FileType.File:
        return [base]
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _frames(path: str, name: str) -> Iterator[tuple]:
    system, _ = _opened(path)
    with system.open_input_stream(name) as f:
        for frame in unpack(f):
            yield tuple(frame.values())


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(n) for n in _names(self.path)] or [_File(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(()) if partition.value is None else _frames(self.path, partition.value)


class _StreamReader(DataSourceStreamReader):
    """The offset is the name of the last file seen; files of this sink are named in the order of their commits."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(_names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(n) for n in _names(self.path) if start["after"] < n <= end["after"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _frames(self.path, partition.value)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """most: payload bytes of a file, beyond the last frame."""

    def __init__(self, path: str, overwrite: bool = False, most: int = 64 << 20):
        self.path, self.overwrite, self.most, self.job = path, overwrite, most, uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        system, base = _opened(self.path)
        return system, base, f"{base}/_staging-{self.job}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, _, staging = self._staging()
        system.create_dir(staging, recursive=True)
        files, held, size = [], [], 0

        def flush() -> None:
            nonlocal held, size
            files.append(f"{staging}/{uuid.uuid4().hex}")
            with system.open_output_stream(files[-1]) as f:
                f.write(pack(held))
            held, size = [], 0

        for row in rows:
            held.append(row.asDict())
            size += len(row["payload"])
            if size >= self.most:
                flush()
        if held:
            flush()
        return _Written(files)

    def _publish(self, messages: list[WriterCommitMessage | None], order: str) -> None:
        system, base, staging = self._staging()
        system.create_dir(base, recursive=True)
        old = _names(self.path) if self.overwrite else []
        for k, name in enumerate(n for m in messages if m is not None for n in m.files):
            system.move(name, f"{base}/part-{order}-{k:06d}")
        for name in old:
            system.delete_file(name)
        self._drop(system, staging)

    def _drop(self, system: fs.FileSystem, staging: str) -> None:
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._publish(messages, f"{time.time_ns():020d}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, staging = self._staging()
        self._drop(system, staging)


class _StreamWriter(_Writer, DataSourceStreamWriter):
    """A batch that was committed before is not written twice."""

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        done = [n for n in _names(self.path) if n.rpartition("/")[2].startswith(f"part-{batchId:020d}-")]
        if done:
            _Writer.abort(self, messages)
        else:
            self._publish(messages, f"{batchId:020d}")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        _Writer.abort(self, messages)


class FrameSource(DataSource):
    """format("frames"): a folder (or file) that all executors see. Option most: payload bytes of a written file."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite, int(self.options.get("most", 64 << 20)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"], False, int(self.options.get("most", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
