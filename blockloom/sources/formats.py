"""Binary device formats as Spark data sources.

``device_raw`` (a device file), ``device_sparse`` (records of block number and block), ``device_log`` (timed packets), ``block_hashes``
(32 bytes a block), ``block_state`` (32-bit block numbers), ``object_blocks`` (one object ``prefix-offset`` a block) and ``packet_frames``.
Readers split files by byte ranges where records have a fixed size, skip blocks outside a pushed ``block_no`` range and
leave payloads out with option ``payload=false``.
"""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from blockloom.files import list_files, move, open_read, open_write, remove
from blockloom.functions.packets import InvalidPacket, decode, frames

SPLIT = 32 << 20


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _FixedReader(DataSourceReader):
    """Files of records of one size; ``record`` bytes each, the last may be short where ``short`` allows it."""

    short = False

    def __init__(self, options: dict[str, str], schema: pa.Schema):
        self.path, self.schema = options["path"], schema
        self.block = int(options.get("block", 4096))
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split", SPLIT))
        self.low, self.high = 0, None

    def record(self) -> int:
        raise NotImplementedError

    def rows(self, path: str, first: int, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def partitions(self):
        size, plan = self.record(), []
        for path, n in list_files(self.path):
            records = -(-n // size) if self.short else n // size
            step = max(1, self.split // size)
            low, high = self.span(records)
            plan += [Range(path, at, min(step, high - at)) for at in range(low, high, step)]
        return plan

    def span(self, records: int) -> tuple[int, int]:
        return 0, records

    def read(self, partition):
        size = self.record()
        per = max(1, (4 << 20) // size)
        with open_read(partition.path) as f:
            for at in range(partition.first, partition.first + partition.count, per):
                f.seek(at * size)
                rows = list(self.rows(partition.path, at, f.read(min(per, partition.first + partition.count - at) * size)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), self.schema)], schema=self.schema)


class _ByNumber(_FixedReader):
    """Records whose number is the block's: a pushed range of ``block_no`` limits what is read."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("block_no",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def span(self, records):
        return min(self.low, records), records if self.high is None else max(0, min(self.high, records))


_BLOCKS = pa.schema([("path", pa.string()), ("block_no", pa.int64()), ("data", pa.binary())])


class RawReader(_ByNumber):
    short = True

    def record(self):
        return self.block

    def rows(self, path, first, data):
        for k in range(0, len(data), self.block):
            yield path, first + k // self.block, data[k : k + self.block] if self.payload else None


class SparseReader(_FixedReader):
    """``pos`` is the record's place in its file: of two records of a block the later counts."""

    def record(self):
        return 8 + self.block

    def rows(self, path, first, data):
        size = self.record()
        for k in range(len(data) // size):
            at = k * size
            yield path, struct.unpack_from("<Q", data, at)[0], first + k, data[at + 8 : at + size] if self.payload else None


class HashReader(_ByNumber):
    def record(self):
        return 32

    def rows(self, path, first, data):
        for k in range(len(data) // 32):
            yield path, first + k, data[32 * k : 32 * k + 32].hex()


class StateReader(_FixedReader):
    def record(self):
        return 4

    def rows(self, path, first, data):
        for (n,) in struct.iter_unpack("<I", data[: len(data) // 4 * 4]):
            yield path, n


class _WholeReader(DataSourceReader):
    """Files of records of their own length: one task a file, read as a stream."""

    def __init__(self, options: dict[str, str], schema: pa.Schema):
        self.path, self.schema = options["path"], schema

    def partitions(self):
        return [Range(path, 0, size) for path, size in list_files(self.path)]

    def rows(self, path: str, read) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition):
        with open_read(partition.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            rows = []
            for row in self.rows(partition.path, stream.read):
                rows.append(row)
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), self.schema)], schema=self.schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), self.schema)], schema=self.schema)


class LogReader(_WholeReader):
    def rows(self, path, read):
        seq = 0
        while head := read(12):
            if len(head) < 12:
                raise InvalidPacket(f"truncated record in {path}")
            dt, size = struct.unpack("<QI", head)
            payload = read(size)
            if len(payload) < size:
                raise InvalidPacket(f"truncated packet in {path}")
            kind, fields = decode(payload)
            if kind not in ("ReadAt", "WriteAt"):
                raise InvalidPacket(f"unknown packet in {path}")
            data = fields.get("data")
            yield path, seq, dt, "W" if kind == "WriteAt" else "R", fields["offset"], len(data) if data is not None else fields["length"], data
            seq += 1


class FrameReader(_WholeReader):
    def rows(self, path, read):
        for device, transaction, payload in frames(read()):
            yield path, device, transaction, payload


class ObjectReader(DataSourceReader):
    """One object for each block, ``prefix-offset``; absent objects are absent rows, which read as zeroes."""

    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.prefix, self.block = options.get("prefix", "device"), int(options.get("block", 4096))

    def partitions(self):
        plan = [x for x in list_files(self.path) if x[0].rpartition("/")[2].startswith(self.prefix + "-")]
        return [Many([p for p, _ in plan[k : k + 256]]) for k in range(0, len(plan), 256)]

    def read(self, partition):
        rows = []
        for path in partition.paths:
            with open_read(path) as f:
                rows.append((path, int(path.rpartition("-")[2]) // self.block, f.read()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), self.schema)], schema=self.schema)


class Many(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class Files(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class RecordWriter(DataSourceWriter):
    """Rows as records of one file a task, in their order; files count once the driver has named them."""

    def __init__(self, options, pack):
        self.path, self.pack = options["path"].rstrip("/"), pack
        self.name = options.get("name", "")

    def write(self, iterator):
        token = self.name or uuid.uuid4().hex
        hidden = f"{self.path}/.{uuid.uuid4().hex}"
        n = 0
        with open_write(hidden) as out:
            for row in iterator:
                out.write(self.pack(row))
                n += 1
        if not n:
            remove(hidden)
            return Files([])
        return Files([(hidden, f"{self.path}/{token}.bin")])

    def commit(self, messages):
        for m in messages:
            for hidden, name in m.names if m else ():
                move(hidden, name)

    def abort(self, messages):
        for m in messages:
            for hidden, _ in m.names if m else ():
                remove(hidden)


def log_record(row) -> bytes:
    from blockloom.functions.packets import encode

    packet = encode("WriteAt", offset=row["offset"], data=bytes(row["data"])) if row["op"] == "W" else encode("ReadAt", offset=row["offset"], length=row["length"])
    return struct.pack("<QI", row["dt_ns"], len(packet)) + packet


def _source(title: str, fields: list[tuple[str, pa.DataType, str]], read: type, pack=None) -> type[DataSource]:
    arrow = pa.schema([(n, t) for n, t, _ in fields])

    class Source(DataSource):
        @classmethod
        def name(cls):
            return title

        def schema(self):
            return ", ".join(f"`{n}` {s}" for n, _, s in fields)

        def reader(self, schema):
            return read(self.options, arrow)

        def writer(self, schema, overwrite):
            if pack is None:
                raise NotImplementedError(f"{title} can't be written")
            block = int(self.options.get("block", 4096))
            return RecordWriter(self.options, pack(block))

    return Source


_L, _S, _B = pa.int64(), pa.string(), pa.binary()
_PATH = ("path", _S, "string")
_NO, _DATA = ("block_no", _L, "long"), ("data", _B, "binary")

SOURCES = (
    _source("device_raw", [_PATH, _NO, _DATA], RawReader, lambda block: lambda r: bytes(r["data"])),
    _source("device_sparse", [_PATH, _NO, ("pos", _L, "long"), _DATA], SparseReader, lambda block: lambda r: struct.pack("<Q", r["block_no"]) + bytes(r["data"]).ljust(block, b"\0")),
    _source("device_log", [_PATH, ("seq", _L, "long"), ("dt_ns", _L, "long"), ("op", _S, "string"), ("offset", _L, "long"), ("length", _L, "long"), _DATA], LogReader, lambda block: log_record),
    _source("block_hashes", [_PATH, _NO, ("hash", _S, "string")], HashReader, lambda block: lambda r: bytes.fromhex(r["hash"])),
    _source("block_state", [_PATH, _NO], StateReader, lambda block: lambda r: struct.pack("<I", r["block_no"])),
    _source("object_blocks", [_PATH, _NO, _DATA], ObjectReader),
    _source("packet_frames", [_PATH, ("dev", _L, "long"), ("id", _L, "long"), ("payload", _B, "binary")], FrameReader, lambda block: lambda r: struct.pack("<III", r["dev"], r["id"], len(r["payload"])) + bytes(r["payload"])),
)


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    for source in SOURCES:
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
