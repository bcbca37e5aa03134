"""Payload codecs of writes: run lengths, zero gaps and gzip, as Arrow functions."""

from __future__ import annotations

import gzip
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from blockloom.functions.packets import InvalidPacket, decode, encode

#: Shortest run inside the data and at its end, and shortest zero gap between literals.
RUN, LAST_RUN, GAP = 4, 5, 12


def put_uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_uvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise InvalidPacket("truncated number")
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return n, at


def put_varint(n: int) -> bytes:
    return put_uvarint(n << 1 if n >= 0 else -n * 2 - 1)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n, at = get_uvarint(data, at)
    return (-(n + 1) // 2 if n & 1 else n >> 1), at


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    starts = np.concatenate([[0], edges]) if len(values) else edges
    return starts, np.diff(np.concatenate([starts, [len(values)]]))


def encode_rle(offset: int, data: bytes) -> bytes:
    starts, sizes = _runs(np.frombuffer(data, np.uint8))
    long = sizes >= RUN
    if len(sizes):
        long[-1] = sizes[-1] >= LAST_RUN
    out, done = [], 0
    for start, size in zip(starts[long].tolist(), sizes[long].tolist()):
        if start > done:
            out += [put_uvarint((start - done) << 1), data[done:start]]
        out += [put_uvarint(size << 1 | 1), data[start : start + 1]]
        done = start + size
    if done < len(data):
        out += [put_uvarint((len(data) - done) << 1), data[done:]]
    return encode("WriteAtCompRLE", offset=offset, data=b"".join(out))


def encode_zeroes(offset: int, data: bytes) -> bytes:
    zero = np.frombuffer(data, np.uint8) == 0
    starts, sizes = _runs(zero)
    gap = zero[starts] & ((sizes >= GAP) | (starts + sizes == len(data))) if len(starts) else np.zeros(0, bool)
    bounds = [0, *(x for s, n in zip(starts[gap].tolist(), sizes[gap].tolist()) for x in (s, s + n)), len(data)]
    out = []
    for a, b in zip(bounds[::2], bounds[1::2]):
        # Zeroes before a literal are a gap too, however short.
        while a < b and data[a] == 0:
            a += 1
        if a < b:
            out += [put_varint(a), put_varint(b - a), data[a:b]]
    return encode("WriteAtCompZeroes", offset=offset, length=len(data), data=b"".join(out))


def encode_gzip(offset: int, data: bytes) -> bytes:
    return encode("WriteAtCompGzip", offset=offset, data=gzip.compress(data, 1, mtime=0))


ENCODERS = {"rle": encode_rle, "zeroes": encode_zeroes, "gzip": encode_gzip}


def decode_compressed(packet: bytes) -> tuple[int, bytes]:
    """Offset and bytes of a compressed write."""
    kind, fields = decode(packet)
    raw = fields.get("data", b"")
    if kind == "WriteAtCompRLE":
        out, at = [], 0
        while at < len(raw):
            n, at = get_uvarint(raw, at)
            size, step = n >> 1, 1 if n & 1 else n >> 1
            if at + step > len(raw):
                raise InvalidPacket("truncated run")
            out.append(raw[at : at + 1] * size if n & 1 else raw[at : at + size])
            at += step
        return fields["offset"], b"".join(out)
    if kind == "WriteAtCompZeroes":
        out, at = bytearray(fields["length"]), 0
        while at < len(raw):
            start, at = get_varint(raw, at)
            size, at = get_varint(raw, at)
            if start < 0 or size < 0 or start + size > len(out) or at + size > len(raw):
                raise InvalidPacket("range outside the data")
            out[start : start + size] = raw[at : at + size]
            at += size
        return fields["offset"], bytes(out)
    if kind == "WriteAtCompGzip":
        try:
            return fields["offset"], gzip.decompress(raw)
        except (OSError, EOFError, zlib.error) as e:
            raise InvalidPacket(str(e)) from e
    raise InvalidPacket("not a compressed write")


def encoder(codec: str):
    """Arrow function ``(offset, data) -> packet``."""
    one = ENCODERS[codec]

    @F.pandas_udf("binary")
    def run(offset: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else one(int(o), bytes(d)) for o, d in zip(offset, data)], dtype=object)

    return run


def decoded():
    """Arrow function ``packet -> data`` for any codec."""

    @F.pandas_udf("binary")
    def run(packet: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else decode_compressed(bytes(p))[1] for p in packet], dtype=object)

    return run


def changed_runs(old: bytes, new: bytes, allowance: int) -> list[tuple[int, bytes]]:
    """Least writes that turn ``old`` into ``new``: changed bytes, joined over gaps of up to ``allowance`` equal ones."""
    n = min(len(old), len(new))
    changed = np.flatnonzero(np.frombuffer(old[:n], np.uint8) != np.frombuffer(new[:n], np.uint8))
    if len(new) > n:
        changed = np.concatenate([changed, np.arange(n, len(new))])
    if not len(changed):
        return []
    split = np.flatnonzero(np.diff(changed) > allowance + 1) + 1
    return [(int(g[0]), new[g[0] : g[-1] + 1]) for g in np.split(changed, split)]


def redundant_filter(allowance: int):
    """Arrow function ``(old, new) -> array<struct<offset, data>>``; without an old block everything is written."""

    @F.pandas_udf("array<struct<offset:int,data:binary>>")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        def one(a, b):
            return [{"offset": o, "data": d} for o, d in ([(0, bytes(b))] if a is None else changed_runs(bytes(a), bytes(b), allowance))]

        return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)

    return run
