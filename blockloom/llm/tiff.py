"""TIFF media columns: images in binary columns, one row per page."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, type sizes and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: A payload is stored in rows of this many samples, 0xFF up to a full row, in pages of at most PAGE_ROWS rows.
ROW, FILL, PAGE_ROWS, STRIP_ROWS = 576, 255, 4096, 64


#: Compression, predictor and tile edge (0: strips) of the images that are written where none is asked for, as mixed archives have
#: them. A payload's checksum picks one, so equal payloads are stored alike.
LAYOUTS = ((DEFLATE, 1, 0), (DEFLATE, 2, 0), (DEFLATE, 1, 192), (DEFLATE, 2, 64), (PACKBITS, 1, 0), (PACKBITS, 2, 192), (NONE, 1, 0), (LZW, 2, 0))


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
                at += 1
            at += 1
    return bytes(out[:size])


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more equal bytes as a count and a byte, what is between as literal packets."""
    out, at = bytearray(), 0

    def literal(start: int, stop: int) -> None:
        for k in range(start, stop, 128):
            part = data[k : min(k + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(at, run.start())
        at = run.end()
        out += bytes((257 - (at - run.start()), data[at - 1]))
    literal(at, len(data))
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Most significant bit first; codes widen one entry early, 256 clears and 257 ends."""
    first = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, width, last = list(first), bytearray(), 9, None
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits & (1 << width) - 1
            if code == 257 or len(out) >= size:
                return bytes(out[:size])
            if code == 256:
                table, width, last = list(first), 9, None
                continue
            if last is None:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code out of range")
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out += entry
            last = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:size])


def pack_lzw(data: bytes) -> bytes:
    table, out, held, bits, width, now = {}, bytearray(), 0, 0, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    table, size = {bytes((k,)): k for k in range(256)}, 258
    for k in range(len(data)):
        byte = data[k : k + 1]
        if now + byte in table:
            now += byte
            continue
        put(table[now])
        table[now + byte] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4095:
            put(256)
            table, size, width = {bytes((j,)): j for j in range(256)}, 258, 9
        now = byte
    if now:
        put(table[now])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _squeeze(data: bytes, how: int) -> bytes:
    if how == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw}[how](data)


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how == PACKBITS:
        return unpack_bits(data, size)
    if how == LZW:
        return unpack_lzw(data, size)
    if how == NONE:
        return data[:size]
    raise ValueError(f"compression {how}")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<", strip_rows: int = STRIP_ROWS) -> bytes:
    """A TIFF file of 8-bit grey ``(rows, columns)`` or ``(rows, columns, samples)`` pages, in strips or square tiles."""
    out = bytearray(b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    link = 4
    for page in pages:
        grid = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = grid.shape
        if tile:
            full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, samples), np.uint8)
            full[:height, :width] = grid
            parts = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        else:
            parts = [grid[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            data = _squeeze(part.tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        tags = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8] * samples), (COMPRESSION, [compression]), (PHOTOMETRIC, [1 if samples < 3 else 2])]
        if not tile:
            tags += [(STRIPS, offsets)]
        tags += [(SAMPLES, [samples])]
        if not tile:
            tags += [(ROWS_PER_STRIP, [strip_rows]), (STRIP_BYTES, sizes)]
        tags += [(PREDICTOR, [predictor])]
        if tile:
            tags += [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILES, offsets), (TILE_BYTES, sizes)]
        entries = b""
        for tag, values in tags:
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack(order + "I", len(out))
                out += data
            else:
                place = data
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries + bytes(4)
        link = len(out) - 4
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a TIFF file as ``(rows, columns, samples)`` arrays of 8-bit samples."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags: dict[int, tuple] = {}
        count = struct.unpack_from(order + "H", data, at)[0]
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPE_CODE:
                place = at + 10 + 12 * k
                if TYPE_SIZE[kind] * n > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{TYPE_CODE[kind]}", data, place)
        yield _page(data, tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    get = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, how = get(WIDTH, 0), get(HEIGHT, 0), get(SAMPLES, 1), get(COMPRESSION, NONE)
    if any(b != 8 for b in tags.get(BITS, (1,))) or get(PLANAR, 1) != 1:
        raise ValueError("only interleaved 8-bit samples are supported")
    tiled = TILES in tags
    high, wide = (get(TILE_HEIGHT, 0), get(TILE_WIDTH, 0)) if tiled else (min(get(ROWS_PER_STRIP, height), height), width)
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    page, across = np.zeros((height, width, samples), np.uint8), -(-width // wide)
    for k, (at, n) in enumerate(zip(offsets, sizes)):
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        size = rows * wide * samples
        part = np.frombuffer(_expand(data[at : at + n], how, size).ljust(size, b"\0"), np.uint8).reshape(rows, wide, samples)
        if get(PREDICTOR, 1) == 2:
            part = np.add.accumulate(part, axis=1, dtype=np.uint8)
        page[y : y + rows, x : x + wide] = part[: height - y, : width - x]
    return page


def _payload(text: bytes | None) -> bytes:
    text = text or b""
    size = max(ROW, -(-len(text) // ROW) * ROW)
    return text.ljust(size, bytes((FILL,)))


def _encoder(compression: int | None, predictor: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for value in batch.column(1).cast(pa.binary()):
                text = value.as_py()
                payload = _payload(text)
                grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
                layout = (compression, predictor, tile) if compression else LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
                media.append(write_tiff([grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)], *layout))
                sizes.append(len(text or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def media_column(docs: DataFrame, compression: int | None = None, predictor: int = 1, tile: int = 0) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes (null: empty) as the samples of a TIFF file.

    Without ``compression`` the layout is one of LAYOUTS. Very long texts have several pages; null ids, ties and repeated rows
    are rows like others; other columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoder(compression, predictor, tile), "doc_id long, n_bytes long, media binary")


PAGES = "doc_id long, n_bytes long, page int, pages int, width int, height int, channels int, samples binary, media_bytes long, media_sha256 string, error string"
_PAGES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("page", pa.int32()), ("pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("samples", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for doc_id, n_bytes, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            media = value.as_py()
            digest = None if media is None else hashlib.sha256(media).hexdigest()
            size, count, error = None if media is None else len(media), 0, "no media" if media is None else None
            first = len(rows)
            try:
                for page in read_tiff(media) if media is not None else ():
                    rows.append([doc_id, n_bytes, count, None, page.shape[1], page.shape[0], page.shape[2], page.tobytes(), size, digest, None])
                    held += page.size
                    count += 1
                error = error or (None if count else "no pages")
            except (ValueError, struct.error, zlib.error, IndexError, KeyError, ZeroDivisionError, MemoryError) as e:
                error = f"{type(e).__name__}: {e}"
            for row in rows[first:]:
                row[3] = count
            if error:
                rows.append([doc_id, n_bytes, None, count, None, None, None, None, size, digest, error])
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGES)], schema=_PAGES)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGES)], schema=_PAGES)


def tiff_pages(media: DataFrame) -> DataFrame:
    """One row per page of every ``doc_id, n_bytes, media``, pages of a file in order and next to each other.

    Null media, and what can't be decoded (damage; 16-bit, planar and 64-bit files), give a row with ``error`` and no page after the
    pages that could be read. Null ids, ties and repeated rows are rows like others; an image is decoded in one task
    whatever its size; other columns are ignored; an empty table gives an empty result.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, PAGES)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _feature(sums: np.ndarray, rows: int) -> str:
    """Sixteen hex digits: which of 64 equal column bands are brighter than the mean of all."""
    return f"{int.from_bytes(np.packbits(sums * 64 > sums.sum()).tobytes(), 'big'):016x}-{int(sums.sum() * 1000 // (rows * ROW))}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, names = None, [x.split()[0] for x in DIGESTS.split(", ")]
    for batch in batches:
        out = []
        for doc_id, n_bytes, page, pages, value, size, digest in zip(*(batch.column(k).to_pylist() if k != 7 else batch.column(k) for k in (0, 1, 2, 3, 7, 8, 9))):
            samples = value.as_py()
            if page is None:
                out.append((doc_id, n_bytes, None, None, None, size, digest, None))
                continue
            if page == 0:
                state = [hashlib.sha256(), 0, np.zeros(64, np.int64)]
            state[0].update(samples)
            state[1] += len(samples)
            state[2] += np.frombuffer(samples, np.uint8).reshape(-1, 64, ROW // 64).sum(axis=(0, 2), dtype=np.int64)
            if page == pages - 1:
                out.append((doc_id, n_bytes, state[1], state[0].hexdigest(), zlib.crc32(samples[-32:]), size, digest, _feature(state[2], state[1] // ROW)))
        columns = list(zip(*out)) if out else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (3, 6, 7) else pa.int64()) for k, c in enumerate(columns)], names)


def media_digests(docs: DataFrame, compression: int | None = None, predictor: int = 1, tile: int = 0) -> DataFrame:
    """Payload, media and feature digests of every document, computed from its decoded TIFF pages.

    Null and empty texts give one row of fill; long texts give several pages; null ids, ties and repeated rows are rows like
    others and equal texts have equal values; other columns are ignored; an empty table gives an empty result. Nothing
    is shuffled: bytes, pages and digests stream through one stage.
    """
    return tiff_pages(media_column(docs, compression, predictor, tile)).mapInArrow(_digest, DIGESTS)
