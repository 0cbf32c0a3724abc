"""Record files of ``tf.train.Example`` messages, written and read in Python on any file system that Arrow knows.

``spark.dataSource.register(RecordSource)``; then ``df.write.format("examples").save(dir)`` writes a file for each
partition and ``spark.read.format("examples").schema(...).load(dir)`` reads one partition for each file, decoding only
the columns of the schema. A record is length, masked CRC32C of the length, message, masked CRC32C of the message.
Whole numbers and booleans are int64 lists, floats are float lists (doubles lose precision, as the format has none),
strings UTF-8 byte lists; arrays are the list itself; nulls are absent.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0x82F63B78), t >> 1)
    return t.astype(np.uint32)


_TABLE = _table()
_STEPS = _TABLE.tolist()
#: records that are framed or checked together
LOT = 512


def checksums(messages: list[bytes]) -> np.ndarray:
    """The Castagnoli checksums of all messages, a byte of each at a time."""
    n = np.array([len(m) for m in messages], np.int64)
    order = np.argsort(-n, kind="stable")
    start = (np.cumsum(n) - n)[order]
    data = np.frombuffer(b"".join(messages), np.uint8)
    c = np.full(len(n), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")  # messages with more than j bytes
    for j, k in enumerate(live.tolist()):
        c[:k] = c[:k] >> np.uint32(8) ^ _TABLE[(c[:k] ^ data[start[:k] + j]) & np.uint32(255)]
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum."""
    return int(checksums([data])[0])


def masked(messages: list[bytes]) -> list[int]:
    c = checksums(messages).astype(np.uint64)
    return (((c >> np.uint64(15) | c << np.uint64(17)) + np.uint64(0xA282EAD8)) & np.uint64(0xFFFFFFFF)).tolist()


def _masked_one(data: bytes) -> int:
    """:func:`masked` of a few bytes."""
    c = 0xFFFFFFFF
    for x in data:
        c = c >> 8 ^ _STEPS[(c ^ x) & 255]
    c ^= 0xFFFFFFFF
    return (c >> 15 | c << 17 & 0xFFFFFFFF) + 0xA282EAD8 & 0xFFFFFFFF


def frames(messages: list[bytes]) -> bytes:
    """Messages as records."""
    heads = [struct.pack("<Q", len(m)) for m in messages]
    return b"".join([x for h, a, m, z in zip(heads, masked(heads), messages, masked(messages)) for x in (h, struct.pack("<I", a), m, struct.pack("<I", z))])


def unframe(stream: BinaryIO, verify: bool = True) -> Iterator[bytes]:
    """The messages of a stream of records; no more than ``LOT`` of them are in memory."""
    at, lot = 0, []

    def checked() -> Iterator[bytes]:
        if verify and lot:
            for (where, _, z), b in zip(lot, masked([x[1] for x in lot])):
                if z != b:
                    raise ValueError(f"a damaged record at byte {where}")
        yield from (x[1] for x in lot)

    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError(f"a damaged record at byte {at}")
        n, a = struct.unpack("<QI", head)
        if verify and a != _masked_one(head[:8]):  # before so many bytes are asked for
            raise ValueError(f"a damaged record at byte {at}")
        body = stream.read(n + 4)
        if len(body) < n + 4:
            raise ValueError(f"a damaged record at byte {at}")
        lot.append((at, body[:n], struct.unpack_from("<I", body, n)[0]))
        at += 16 + n
        if len(lot) == LOT:
            yield from checked()
            lot = []
    yield from checked()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


_SMALL = [bytes([n]) for n in range(128)]


#: the tags of fields of bytes, by number
_TAGS = [bytes([k << 3 | 2]) for k in range(4)]


def _varint(n: int) -> bytes:
    if 0 <= n < 128:
        return _SMALL[n]
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _field(number: int, body: bytes) -> bytes:
    return _TAGS[number] + _varint(len(body)) + body


def _kind(t: DataType) -> int:
    t = t.elementType if isinstance(t, ArrayType) else t
    if isinstance(t, (StringType, BinaryType)):
        return 1
    if isinstance(t, (FloatType, DoubleType)):
        return 2
    if isinstance(t, (BooleanType, ByteType, ShortType, IntegerType, LongType)):
        return 3
    raise TypeError(f"only numbers, booleans, strings and arrays of them can be stored, not {t.simpleString()}")


def encoder(schema: StructType) -> Callable[[Sequence[Any]], bytes]:
    """The message of a row, its values in the order of the schema."""
    plan = [(_field(1, f.name.encode()), _kind(f.dataType), isinstance(f.dataType, ArrayType)) for f in schema.fields]

    def encode(row: Sequence[Any]) -> bytes:
        out = []
        for v, (name, kind, many) in zip(row, plan, strict=True):
            if v is None:
                continue
            vs = v if many else (v,)
            if kind == 1:
                body = b"".join([_field(1, x.encode() if isinstance(x, str) else bytes(x)) for x in vs])
            elif kind == 2:
                body = _field(1, struct.pack(f"<{len(vs)}f", *vs)) if len(vs) else b""
            else:
                body = _field(1, b"".join([_varint(int(x)) for x in vs])) if len(vs) else b""
            body = _TAGS[kind] + _varint(len(body)) + body
            body = _TAGS[2] + _varint(len(body)) + body
            out.append(_TAGS[1] + _varint(len(name) + len(body)) + name + body)
        return _field(1, b"".join(out))

    return encode


def encode_example(row: dict[str, Any], schema: StructType) -> bytes:
    return encoder(schema)([row[f.name] for f in schema.fields])


def _fields(b: bytes) -> list[tuple[int, Any]]:
    at, end, out = 0, len(b), []
    while at < end:
        tag = b[at]
        at += 1
        if tag > 127:
            tag, at = _read_varint(b, at - 1)
        wire = tag & 7
        if wire == 2:
            n = b[at]
            at += 1
            if n > 127:
                n, at = _read_varint(b, at - 1)
            out.append((tag >> 3, b[at : at + n]))
            at += n
        elif wire == 0:
            v, at = _read_varint(b, at)
            out.append((tag >> 3, v))
        elif wire == 5:
            out.append((tag >> 3, b[at : at + 4]))
            at += 4
        else:
            raise ValueError("a field of an unknown wire type")
    return out


def _numbers(body: bytes) -> list[int]:
    vs: list[int] = []
    for _, v in _fields(body):
        if isinstance(v, int):
            vs.append(v)
            continue
        at, end = 0, len(v)
        while at < end:
            x = v[at]
            at += 1
            if x > 127:
                x, at = _read_varint(v, at - 1)
            vs.append(x)
    return [x - (1 << 64) if x >> 63 else x for x in vs]


def decoder(schema: StructType) -> Callable[[bytes], tuple]:
    """The values of a message in the order of the schema; absent ones are null."""
    plan = {}
    for i, f in enumerate(schema.fields):
        many = isinstance(f.dataType, ArrayType)
        t = f.dataType.elementType if many else f.dataType
        plan[f.name.encode()] = (i, many, bytes.decode if isinstance(t, StringType) else bool if isinstance(t, BooleanType) else None)
    width = len(schema.fields)

    def decode(message: bytes) -> tuple:
        out: list[Any] = [None] * width
        for _, features in _fields(message):
            for _, entry in _fields(features):
                parts = dict(_fields(entry))
                if (at := plan.get(parts[1])) is None:
                    continue
                i, many, convert = at
                kind, body = next(iter(_fields(parts[2])), (0, b""))
                if kind == 1:
                    vs: list[Any] = [v for _, v in _fields(body)]
                elif kind == 2:
                    vs = [x for _, v in _fields(body) for x in struct.unpack(f"<{len(v) // 4}f", v)]
                else:
                    vs = _numbers(body)
                if convert:
                    vs = [convert(v) for v in vs]
                out[i] = vs if many else vs[0] if vs else None
        return tuple(out)

    return decode


def decode_example(message: bytes, schema: StructType) -> dict[str, Any]:
    """The columns of ``schema``; absent ones are null."""
    return dict(zip([f.name for f in schema.fields], decoder(schema)(message)))


@dataclass
class _Done(WriterCommitMessage):
    tmp: str
    final: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, skip_fails: bool):
        self.path, self.schema, self.overwrite, self.skip = path, schema, overwrite, skip_fails
        for f in schema.fields:
            _kind(f.dataType)
        self.run = uuid.uuid4().hex[:8]

    def write(self, rows):
        from pyspark import TaskContext

        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.run}.tfrecord"
        tmp, n, lot, encode = f"{root}/_{name}.{uuid.uuid4().hex[:6]}", 0, [], encoder(self.schema)
        with where.open_output_stream(tmp) as out:
            for row in rows:
                try:
                    lot.append(encode(row))
                except (ValueError, OverflowError, struct.error):
                    if not self.skip:
                        raise
                    continue
                n += 1
                if len(lot) == LOT:
                    out.write(frames(lot))
                    lot = []
            out.write(frames(lot))
        return _Done(tmp, f"{root}/{name}", n)

    def commit(self, messages):
        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        if self.overwrite:
            for old in _parts(where, root):
                where.delete_file(old)
        for m in messages:
            if m is not None:
                where.move(m.tmp, m.final)
        with where.open_output_stream(f"{root}/_schema.json") as f:
            f.write(self.schema.json().encode())

    def abort(self, messages):
        where, _ = filesystem(self.path)
        for m in messages:
            if m is not None and where.get_file_info(m.tmp).type == fs.FileType.File:
                where.delete_file(m.tmp)


def _parts(where: fs.FileSystem, root: str) -> list[str]:
    """The record files of a folder, or the file itself."""
    info = where.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".tfrecord") and not x.base_name.startswith("_"))


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool):
        self.path, self.schema, self.verify = path, schema, verify

    def partitions(self):
        return [_File(p) for p in _parts(*filesystem(self.path))]

    def read(self, partition):
        where, _ = filesystem(self.path)
        with where.open_input_stream(partition.path, buffer_size=1 << 20) as f:
            yield from map(decoder(self.schema), unframe(f, self.verify))


class RecordSource(DataSource):
    """Options: path, verify (true), skip_fails (false). The written schema is kept beside the files."""

    @classmethod
    def name(cls):
        return "examples"

    def schema(self):
        where, root = filesystem(self.options["path"])
        with where.open_input_stream(f"{root}/_schema.json") as f:
            return StructType.fromJson(json.loads(f.read()))

    def reader(self, schema):
        return _Reader(self.options["path"], schema, self.options.get("verify", "true") == "true")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema, overwrite, self.options.get("skip_fails", "false") == "true")
