"""WARC archives as a Spark data source, and pages written to them with copies as revisits."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from blockloom.files import list_files, move, open_read, open_write, remove
from blockloom.scratch import fresh_path, materialize

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, content_length long, http_length long, headers map<string,string>, payload binary, error string"
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")]
    + [("content_length", pa.int64()), ("http_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string())]
)
#: Columns whose equality predicates are decided from a record's headers, before its payload is decoded.
PUSHED = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
EPOCH = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
HEAD, STEP, LONGEST_HEAD = 1 << 16, 1 << 22, 1 << 24
GZIP, MARK = b"\x1f\x8b\x08", b"\r\n\r\nWARC/1."


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``sl`` has its compressed and its full length, so that readers can step over it."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """A header value: control characters, which would end it, become percent signs with their code. Others stay as they are."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_type: str, record_id: str, url: str | None, digest: str, payload: bytes | None, length: int, refers_to: str | None = None) -> bytes:
    """A WARC record of an HTTP response, or of a revisit that has its HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {EPOCH}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (names in lower case, folded lines joined) and where the block begins; None if the end isn't in ``data``."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    name = ""
    for line in data[:end].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            raw, _, value = line.partition(b":")
            name = raw.strip().lower().decode("utf-8", "replace")
            fields[name] = value.strip().decode("utf-8", "replace")
    return fields, end + 4


def _bare(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if name in ("warc-record-id", "warc-refers-to"):
        return value.strip("<>")
    if name == "warc-payload-digest":
        return value.rpartition(":")[2]
    return value


class _Plain:
    """Bytes of a file from a position on."""

    def __init__(self, f, size: int):
        self.f, self.size, self.damage = f, size, None

    def read(self, at: int, n: int) -> bytes:
        if at >= self.size:
            return b""
        self.f.seek(at)
        return self.f.read(min(n, self.size - at))


class _Inflated:
    """Bytes of the gzip member that starts at ``at``, decoded as far as they are asked for; ``damage`` names what ended them early."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.size, self.damage = f, at, size, None
        self._restart()

    def _restart(self) -> None:
        self.inflate, self.fed, self.begin, self.held = zlib.decompressobj(31), self.at, 0, b""

    def _more(self) -> bool:
        if self.inflate.eof or self.damage:
            return False
        raw = self.inflate.unconsumed_tail
        if not raw and self.fed < self.size:
            self.f.seek(self.fed)
            raw = self.f.read(min(HEAD, self.size - self.fed))
            self.fed += len(raw)
        if not raw:
            self.damage = "gzip member ends early"
            return False
        try:
            self.held += self.inflate.decompress(raw, STEP)
        except zlib.error:
            self.damage = "gzip member is damaged"
            return False
        return True

    def read(self, at: int, n: int) -> bytes:
        if at < self.begin:
            damage, self.damage = self.damage, None
            self._restart()
            got = self.read(at, n)
            self.damage = self.damage or damage
            return got
        parts, want = [], n
        while want:
            if at > self.begin:  # what lies before isn't asked for any more
                drop = min(at - self.begin, len(self.held))
                self.held, self.begin = self.held[drop:], self.begin + drop
            if at == self.begin and self.held:
                parts.append(self.held[:want])
                want, at = want - len(parts[-1]), at + len(parts[-1])
            elif not self._more():
                break
        return b"".join(parts)

    def after(self) -> int:
        """Where the next member starts."""
        while not self.inflate.eof and not self.damage:
            self.held, self.begin = b"", self.begin + len(self.held)
            self._more()
        return self.fed - len(self.inflate.unused_data) if self.inflate.eof else self.size


class _Records:
    """Records of one archive, plain or in gzip members of one record or more: headers first, the rest only if they are wanted.

    Damage is a row with ``error``: a block that ends early, at the next record or the end of its member, gives what there is
    of it; bytes that are no record are passed over up to the next record or member. With pushed predicates, damage
    shows only where the headers that could be read satisfy them.
    """

    def __init__(self, path: str, wanted: dict[str, set], payload: bool):
        self.path, self.wanted, self.payload = path, wanted, payload

    def _passes(self, fields: dict[str, str]) -> bool:
        return all(_bare(PUSHED[c], fields.get(PUSHED[c])) in values for c, values in self.wanted.items())

    def __iter__(self) -> Iterator[tuple]:
        with open_read(self.path) as f:
            size, at = f.size(), 0
            while at < size:
                f.seek(at)
                start = f.read(min(24, size - at))
                if start[:2] != b"\x1f\x8b":
                    if at:  # between members: look for the next
                        at = yield from self._lost(f, at, size)
                        continue
                    yield from self._walk(_Plain(f, size), None)
                    return
                jump = struct.unpack_from("<HII", start, 14)[1:] if len(start) == 24 and start[3] & 4 and start[12:14] == b"sl" else None
                source = _Inflated(f, at, size)
                yield from self._walk(source, jump)
                if jump and not source.damage:
                    at += max(18, jump[0])
                    continue
                end = source.after()
                at = (yield from self._lost(f, at + 2, size, source.damage)) if source.damage else end

    def _lost(self, f, at: int, size: int, why: str = "bytes between gzip members"):
        """The next place where a gzip member with a record starts, after a row that tells of the damage."""
        if not self.wanted:
            yield self._row(({}, 0), b"", why)
        held, base = b"", at
        while True:
            found = held.find(GZIP)
            if found >= 0:
                if _Inflated(f, base + found, size).read(0, 5) == b"WARC/":
                    return base + found
                held, base = held[found + 1 :], base + found + 1
                continue
            keep = held[-2:]
            f.seek(base + len(held))
            more = f.read(HEAD) if base + len(held) < size else b""
            if not more:
                return size
            base, held = base + len(held) - len(keep), keep + more

    def _head(self, source, at: int) -> tuple[dict[str, str], int] | None:
        data = source.read(at, 4096)
        while (head := parse_head(data)) is None and len(data) < LONGEST_HEAD:
            more = source.read(at + len(data), max(4096, len(data)))
            if not more:
                return None
            data += more
        return head

    def _next(self, source, at: int) -> int | None:
        """Where the next record starts at ``at`` or later."""
        held, base = source.read(at, len(MARK)), at
        while True:
            found = held.find(MARK)
            if found >= 0:
                return base + found + 4
            more = source.read(base + len(held), HEAD)
            if not more:
                return None
            keep = held[1 - len(MARK) :]
            base, held = base + len(held) - len(keep), keep + more

    def _walk(self, source, jump: tuple[int, int] | None) -> Iterator[tuple]:
        at = 0
        while True:
            while (gap := source.read(at, 2)) in (b"\r\n", b"\n", b"\n\r", b"\n\n"):
                at += 2 if gap == b"\r\n" else 1
            if not gap:
                return
            head = self._head(source, at) if source.read(at, 5) == b"WARC/" else None
            if head is None or not (declared := head[0].get("content-length", "")).isdigit():
                if not self.wanted:
                    yield self._row((head[0] if head else {}, 0), b"", source.damage or "no record")
                at = self._next(source, at)
                if at is None:
                    return
                continue
            block, length = at + head[1], int(declared)
            passes = self._passes(head[0])
            lone = jump is not None and head[1] + length + 4 == jump[1]
            data = source.read(block, length if self.payload else min(length, HEAD)) if passes else b""
            if lone and (not passes or not self.payload):
                if passes:
                    yield self._row(head, data, None)
                return
            end = block + length
            tail = source.read(end, 9)
            error = None
            if tail[:4] != b"\r\n\r\n" or (tail[4:] and not b"WARC/".startswith(tail[4:9])):
                later = self._next(source, block)
                if later is not None and later < end + 4:
                    error, end = "block ends early, at the next record", later - 4
                elif not tail:
                    error, end = None if length == 0 or source.read(end - 1, 1) else source.damage or "block ends early", None
                elif later is None and source.damage:
                    error = source.damage
            if passes:
                yield self._row(head, data if end is None else data[: end - block], error)
            if end is None:
                return
            at = end

    def _row(self, head: tuple[dict[str, str], int], block: bytes, error: str | None = None) -> tuple:
        fields = head[0]
        declared = fields.get("content-length", "")
        length = int(declared) if declared.isdigit() else None
        body, http = 0, None
        if "application/http" in fields.get("content-type", ""):
            body = max(0, block.find(b"\r\n\r\n") + 4) if b"\r\n\r\n" in block else len(block)
            found = _LENGTH.search(block, 0, body)
            http = int(found[1]) if found else (length or 0) - body
        keep = self.payload and fields and fields.get("warc-type") != "revisit"
        named = tuple(_bare(w, fields.get(w)) for w in PUSHED.values())
        return (*named, length, http, list(fields.items()), block[body:] if keep else None, error)


class _File(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    """One task for each archive, or for several small ones up to ``target`` bytes."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("target", 32 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else None
            if column in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        plan, size = [[]], 0
        for path, n in list_files(self.path, (".warc", ".warc.gz")):
            if plan[-1] and size + n > self.target:
                plan.append([])
                size = 0
            plan[-1].append(path)
            size += n
        return [_File(p) for p in plan]

    def read(self, partition):
        rows, size = [], 0
        for path in partition.paths:
            for row in _Records(path, self.wanted, self.payload):
                rows.append(row)
                size += len(row[-2] or b"") + 500
                if size > 8 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows ``record_type, record_id, target_uri, payload_digest, payload, http_length, refers_to`` -> ``.warc.gz`` files.

    Tasks write under hidden names; the driver gives the files of the tasks that count their names, so tries that
    were lost or repeated leave nothing that is read.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.target = options["path"].rstrip("/"), int(options.get("target", 64 << 20))

    def write(self, iterator):
        files: list[tuple[str, str]] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for r in batch.select(["record_type", "record_id", "target_uri", "payload_digest", "payload", "http_length", "refers_to"]).to_pylist():
                    if out is None or size > self.target:
                        if out:
                            out.close()
                        name = uuid.uuid4().hex
                        files.append((f"{self.path}/.{name}", f"{self.path}/{name}.warc.gz"))
                        out, size = open_write(files[-1][0]), 0
                    data = gzip_member(record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["payload"], r["http_length"], r["refers_to"]), 4)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages):
        for m in messages:
            for hidden, name in m.files if m else ():
                move(hidden, name)

    def abort(self, messages):
        for m in messages:
            for hidden, _ in m.files if m else ():
                remove(hidden)


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options ``payload`` (false: headers only), ``target`` (bytes a task).

    Fields that a record lacks are null, repeated records are rows like others, blocks are read whole whatever their length, a
    folder without archives gives no row, and damage is a row with ``error`` (see ``_Records``).
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column(batch.schema.get_field_index("payload_digest")).to_pylist()]
        arrays = [pa.array(digests, pa.string()) if n == "payload_digest" else batch.column(k) for k, n in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive every row of ``pages(page_id, url, html)``; null html is an empty payload.

    Of pages with equal payloads of ``least`` bytes or more, that with the largest page_id is written as response and the
    others as revisits of it. Rows that share this page_id are all responses; rows without page_id are
    responses only where no copy has one, named by a digest of their url and payload. Largest ids are found on digests
    alone, pre-aggregated.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), body.alias("payload")).withColumn("payload_digest", F.sha1("payload")).withColumn("http_length", F.octet_length("payload").cast("long"))
    last = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("d"), F.octet_length(body).alias("n")).where(F.col("n") >= least).groupBy("d").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select("d", "last")
    rows = rows.join(last, F.col("payload_digest") == F.col("d"), "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    nameless = F.concat(F.lit("urn:md5:"), F.md5(F.concat_ws(" ", "payload_digest", "target_uri").cast("binary")))
    name = lambda c: F.when(F.col(c).isNull(), nameless).otherwise(F.concat(F.lit("urn:page:"), F.col(c).cast("string")))
    rows = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        "target_uri",
        "payload_digest",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.col("http_length"),
        F.when(revisit, name("last")).alias("refers_to"),
    )
    rows.mapInArrow(_base32, rows.schema).write.format("warc").mode("append").save(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [x.as_py() or b"" for x in batch.column(1)]
        digests = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in payloads]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, payloads), pa.int64(), size=len(payloads)), pa.array(digests, pa.string())], ["record_id", "payload_bytes", "payload_digest"])


def read_copies(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, payload_bytes, payload_digest, record_type, refers_to`` of the responses and revisits in archives.

    Payloads are decoded and digested for responses alone, which the pushed record type selects. Revisits are read by
    their headers, and have the size and digest of the response they refer to (null if the archives lack it).
    """
    archive = spark.read.format("warc")
    responses = archive.load(path).where("record_type = 'response'").select("record_id", "payload")
    responses = materialize(responses.mapInArrow(_digests, "record_id string, payload_bytes long, payload_digest string"), "responses")
    revisits = archive.option("payload", "false").load(path).where("record_type = 'revisit'").select("record_id", "refers_to")
    known = responses.groupBy(F.col("record_id").alias("id")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = revisits.join(known, F.col("refers_to") == F.col("id"), "left").select("record_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to")).union(revisits)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null urls leave their header out, null html is an empty payload, repeated rows give repeated records, null ids stay null,
    other columns are ignored, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    register(spark)
    path = fresh_path(spark, "warc")
    write_pages(pages, path, least)
    try:
        list_files(path)
    except FileNotFoundError:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long").alias({"record_id": "page_id"}.get(c, c))
    return read_copies(spark, path).select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))
