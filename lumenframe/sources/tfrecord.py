"""Record files of framed messages, as a batch source and sink: `spark.read.format("tfrecord")`.

A record is its length (8 bytes, little-endian), a masked CRC-32C of those, the message, and a masked CRC-32C of it. A message holds named
features, each a list of bytes, floats or 64-bit integers. A column takes the feature of its name: a scalar column one value, an array
column all of them. Types: bigint and int (integers), float and double (floats), string and binary (bytes), and arrays of these.

A file is one partition and is read record by record, whatever its size. Tasks write files under names that readers skip, and the driver
gives them their names once all have ended, so a lost or repeated task leaves nothing behind. Paths go through pyarrow's file systems
(local, hdfs and object stores, by their scheme).

Defined results: a missing feature is null in a scalar column and empty in an array; more than one value in a scalar column, a feature of
another kind, a wrong checksum and a cut file are errors that name the file. Nulls are written as missing features. Features without a
column are skipped. Names that begin with a dot or underscore are skipped. No files: no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

#: The reversed polynomial of CRC-32C, and what masks a checksum.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
_ROWS = 1024


@lru_cache(maxsize=1)
def _remainders() -> np.ndarray:
    """CRC-32C of each byte."""
    found = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        found = np.where(found & 1, (found >> 1) ^ np.uint32(POLYNOMIAL), found >> 1)
    return found


def checksums(messages: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each message; all are worked on together, a byte of each at a time."""
    size = np.array([len(m) for m in messages], np.int64)
    order = np.argsort(-size, kind="stable")
    data, start = np.frombuffer(b"".join(messages), np.uint8), np.r_[0, np.cumsum(size)[:-1]][order]
    size, table, crc = size[order], _remainders(), np.full(len(messages), 0xFFFFFFFF, np.uint32)
    live, longest = len(messages), int(size[0]) if len(size) else 0
    for k in range(longest):
        while size[live - 1] <= k:
            live -= 1
        now = crc[:live]
        crc[:live] = table[(now ^ data[start[:live] + k]) & 255] ^ (now >> 8)
    crc = ~crc
    out = np.empty_like(crc)
    out[order] = ((crc >> 15) | (crc << 17)) + np.uint32(MASK)
    return out


# ---------------------------------------------------------------- messages


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def _varints(data: bytes) -> np.ndarray:
    """All integers of a packed list."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    value = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        here = np.flatnonzero(ends - starts >= k)
        value[here] |= (raw[starts[here] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return value.view(np.int64)


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of each field of a message."""
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        elif kind == 2:
            size, at = _read_varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("a message ends within a field")
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, kind, value


def _field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


#: Field numbers of the three kinds of lists within a feature.
_BYTES, _FLOATS, _INTEGERS = 1, 2, 3


def decode(message: bytes) -> dict[str, tuple[int, list]]:
    """Name -> (kind, values) of a message; of a name given twice the last."""
    out = {}
    for number, _, features in _fields(message):
        if number != 1:
            continue
        for number, _, entry in _fields(features):
            if number != 1:
                continue
            parts = {n: v for n, _, v in _fields(entry)}
            kind, values = 0, []
            for kind, _, held in _fields(parts.get(2, b"")):
                for number, wire, value in _fields(held):
                    if number != 1:
                        continue
                    if kind == _BYTES:
                        values.append(value)
                    elif kind == _FLOATS:
                        values += np.frombuffer(value, "<f4").tolist()
                    else:
                        values += _varints(value).tolist() if wire == 2 else [value - (1 << 64) if value >> 63 else value]
            out[parts.get(1, b"").decode()] = (kind, values)
    return out


def encode(row: dict[str, tuple[int, list]]) -> bytes:
    entries = []
    for name, (kind, values) in row.items():
        if kind == _BYTES:
            held = b"".join(_field(1, v) for v in values)
        else:
            held = _field(1, np.asarray(values, "<f4").tobytes() if kind == _FLOATS else b"".join(map(_varint, values)))
        entries.append(_field(1, _field(1, name.encode()) + _field(2, _field(kind, held))))
    return _field(1, b"".join(entries))


def _kind(t: DataType) -> tuple[int, bool]:
    """(kind of list, whether the column takes all values) of a column's type."""
    many = isinstance(t, ArrayType)
    one = t.elementType if many else t
    for kind, types in ((_BYTES, (StringType, BinaryType)), (_FLOATS, (FloatType, DoubleType)), (_INTEGERS, (LongType, IntegerType))):
        if isinstance(one, types):
            return kind, many
    raise ValueError(f"no feature is a {t.simpleString()}")


# ---------------------------------------------------------------- source and sink


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def records(stream, name: str) -> Iterator[list[bytes]]:
    """The messages of an open file, in lists of up to _ROWS; checksums are verified."""
    held: list[tuple[bytes, bytes, bytes, bytes]] = []

    def told() -> list[bytes]:
        for part in ((0, 1), (2, 3)):
            want = np.array([struct.unpack("<I", r[part[1]])[0] for r in held], np.uint32)
            if (checksums([r[part[0]] for r in held]) != want).any():
                raise ValueError(f"a checksum of {name} is wrong")
        found = [r[2] for r in held]
        held.clear()
        return found

    while head := stream.read(12):
        if len(head) == 12 and checksums([head[:8]])[0] != struct.unpack("<I", head[8:])[0]:
            raise ValueError(f"a checksum of {name} is wrong")  # before a wrong length is read
        size = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else 0
        rest = stream.read(size + 4) if len(head) == 12 else b""
        if len(head) < 12 or len(rest) < size + 4:
            raise ValueError(f"{name} ends within a record")
        held.append((head[:8], head[8:], rest[:size], rest[size:]))
        if len(held) == _ROWS:
            yield told()
    if held:
        yield told()


@dataclass
class File(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.kinds = path, schema, [(f.name, *_kind(f.dataType)) for f in schema.fields]

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, at = _at(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.File:
            return [File(at)]
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        schema = to_arrow_schema(self.schema)
        with _at(self.path)[0].open_input_stream(partition.path) as stream:
            for messages in records(stream, partition.path):
                columns: list[list] = [[] for _ in self.kinds]
                for message in messages:
                    found = decode(message)
                    for column, (name, kind, many) in zip(columns, self.kinds, strict=True):
                        had, values = found.get(name, (0, []))
                        if had not in (0, kind):
                            raise ValueError(f"feature {name} of {partition.path} is of another kind than its column")
                        if not many and len(values) > 1:
                            raise ValueError(f"feature {name} of {partition.path} has {len(values)} values")
                        column.append(values if many else values[0] if values else None)
                yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_string(kind):
        return pa.array(values, pa.binary()).cast(kind)
    if pa.types.is_list(kind) and pa.types.is_string(kind.value_type):
        return pa.array(values, pa.list_(pa.binary())).cast(kind)
    return pa.array(values, kind)


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        self.kinds = [(f.name, *_kind(f.dataType)) for f in schema.fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        path = f"{at}/.writing-{self.run}-{uuid.uuid4().hex}"
        with system.open_output_stream(path) as out:
            for batch in iterator:
                messages = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch.num_columns else ():
                    features = {}
                    for (name, kind, many), value in zip(self.kinds, row, strict=True):
                        if value is not None:
                            values = [v for v in value if v is not None] if many else [value]
                            features[name] = (kind, [v.encode() if isinstance(v, str) else v for v in values])
                    messages.append(encode(features))
                lengths = [struct.pack("<Q", len(m)) for m in messages]
                for size, a, message, b in zip(lengths, checksums(lengths).tolist(), messages, checksums(messages).tolist(), strict=True):
                    out.write(size + struct.pack("<I", a) + message + struct.pack("<I", b))
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(at)):
                if old.type == fs.FileType.File and not old.base_name.startswith("."):
                    system.delete_file(old.path)
        for k, message in enumerate(m for m in messages if m is not None):
            system.move(message.path, f"{at}/part-{k:05d}-{self.run}.tfrecord")

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message is not None:
                _at(self.path)[0].delete_file(message.path)


class TfRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return "label bigint, index array<bigint>, value array<float>"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TfRecords)
