"""Removal of repeated 200-byte strings: blockwise suffix sorting with a difference cover's sample ranks.

A suffix counts by its first ``LENGTH`` bytes here. Which of them repeat is found in three distributed steps:

1. Cover sample. Positions whose residue modulo V is in the difference cover D are samples, 9 % of all. Any two suffixes reach
   samples at one shift under V, so of two equal strings some sample lies at the same place in both, and the GRAM bytes from it
   on, which the strings hold, are equal. Strings with no sample whose gram occurs twice can't repeat and are done.
2. Suffix buckets. The other suffixes are bucketed by their samples' grams, as blocks of bytes around each sample. Buckets meet
   one at a time in a task. A bucket of more than LIMIT samples is split by further bytes, all LENGTH of each
   string, so that it never meets anywhere.
3. Within a bucket the samples' right and left contexts are sorted once, which gives ranks for every depth. The suffix
   that starts d bytes before its sample is then ordered by its first d bytes and, where these tie, by the
   sample's precomputed rank at depth 200 - d: long ties never compare bytes again.

Every comparison in step 3 is of real bytes, so hash collisions cost time only; strings of split buckets are told apart by
128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm.columns import seal, tidied
from blockloom.scratch import discard, materialize, partitions, release

LENGTH = 200
# A perfect difference set modulo 133, whose differences are all residues.
V, D = 133, (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110)
GRAM = LENGTH - V + 1
CHUNK = 1 << 20  # bytes of text in a chunk, more for a longer text or with very many routes
ROUTE = 2_000_000  # sample hashes that meet in one place, roughly
LIMIT = 20_000  # samples of one gram that are sorted together
BLOCKS = 20_000  # samples sorted at a time in step 3, more only for a larger bucket
PART = 5_000  # blocks that leave step 2 at a time
LOW = 40  # bits of a sample's hash that are sent
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _chunker(size: int):
    """Distinct texts -> chunks ``chunk, bytes, keys, sizes, packed`` of about ``size`` bytes; texts too short to repeat are left out."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            keys = [hashlib.sha256(x).digest()[:16] for x in texts]
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            values = (int.from_bytes(keys[0][:8], "little", signed=True), held, b"".join(keys), np.array(list(map(len, texts)), "<i8").tobytes(), packed)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CHUNKS)], schema=CHUNKS)

        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                text = value.as_py() or b""
                if len(text) < LENGTH:
                    continue
                if texts and held + len(text) > size:
                    yield row()
                    texts, held = [], 0
                texts.append(text)
                held += len(text)
        if texts:
            yield row()

    return run


CHUNKS = pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("packed", pa.binary())])
CHUNKS_SQL = "chunk long, bytes long, keys binary, sizes binary, packed binary"


class _Chunk:
    """The texts of a chunk: bytes, where each text starts and ends, and the samples' places and hashes."""

    def __init__(self, row: dict, routes: int):
        self.raw = zstandard.ZstdDecompressor().decompress(row["packed"])
        self.keys = row["keys"]
        sizes = np.frombuffer(row["sizes"], "<i8")
        self.end = sizes.cumsum()
        self.start = self.end - sizes
        self.data = np.frombuffer(self.raw + bytes(8), np.uint8)
        self.words = np.ndarray((len(self.raw) + 1,), "<u8", self.data, 0, (1,))
        longest = int(sizes.max()) - GRAM + 1
        base = (np.arange(-(-longest // V))[:, None] * V + np.array(D)).ravel()
        counts = np.searchsorted(base, sizes - GRAM + 1)
        self.owner = np.repeat(np.arange(len(sizes)), counts)
        self.sample = np.concatenate([base[:k] for k in counts.tolist()]) + self.start[self.owner]
        self.code = _routed(self.hashes(self.sample, GRAM), routes)

    def hashes(self, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
        h = np.full(len(at), seed, np.uint64)
        for k in [*range(0, length - 8, 8), length - 8]:
            h = (h ^ self.words[at + k]) * _M[0]
            h ^= h >> np.uint64(29)
        h *= _M[1]
        h ^= h >> np.uint64(32)
        h *= _M[2]
        return h ^ (h >> np.uint64(29))

    def classes(self, flags: list[dict]) -> np.ndarray:
        """Of each sample: 0 for a gram that occurs once, 1 for a repeated one, 2 for one of more than LIMIT places."""
        grams, which = np.unique(self.code, return_inverse=True)
        return _answers(grams >> np.uint64(LOW), flags)[which]

    def windows(self, sample: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the strings that hold a sample's gram at a shift under V; none where last < first."""
        return np.maximum(self.start[owner], sample - (V - 1)), np.minimum(sample, self.end[owner] - LENGTH)

    def hot_strings(self, classes: np.ndarray) -> np.ndarray:
        """Starts of the strings around samples of class 2."""
        at = classes == 2
        first, last = self.windows(self.sample[at], self.owner[at])
        edge = np.zeros(len(self.raw) + 2, np.int64)
        ok = first <= last
        np.add.at(edge, first[ok], 1)
        np.add.at(edge, last[ok] + 1, -1)
        return np.flatnonzero(edge.cumsum() > 0)

    def string_codes(self, at: np.ndarray, routes: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 128-bit hashes of strings, ordered by route: structured array of route, a and b, and each string's place in it."""
        table = np.empty(len(at), CODE)
        table["a"], table["b"] = self.hashes(at, LENGTH), self.hashes(at, LENGTH, 0x5851F42D4C957F2D)
        table["route"] = (table["a"] >> np.uint64(LOW)) % np.uint64(routes)
        return np.unique(table, return_inverse=True)


CODE = np.dtype([("route", "<u8"), ("a", "<u8"), ("b", "<u8")])


def _routed(h: np.ndarray, routes: int) -> np.ndarray:
    low = np.uint64((1 << LOW) - 1)
    return ((h >> np.uint64(LOW)) % np.uint64(routes)) << np.uint64(LOW) | (h & low)


def _answers(route: np.ndarray, flags: list[dict]) -> np.ndarray:
    """Classes of codes that are sorted by route, from the rows of ``_judge`` for their chunk; 0 where there is none."""
    got = np.zeros(len(route), np.int8)
    for f in flags or ():
        low, high = np.searchsorted(route, np.uint64(f["route"])), np.searchsorted(route, np.uint64(f["route"]), "right")
        for bits in (f["bits"], f["hot"]):
            if bits is not None:
                got[low:high] += np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(np.int8)
    return got


ASKED = pa.schema([("route", pa.int64()), ("chunk", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])
ASKED_SQL = "route long, chunk long, codes binary, counts binary"


def _ask(chunk: int, route: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each route: the codes that a chunk has there, and the logarithm of their number of places in it."""
    head = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
    stop = [*head[1:].tolist(), len(route)]
    logs = np.floor(np.log2(counts)).astype(np.uint8)
    columns = [route[head].astype(np.int64), np.full(len(head), chunk, np.int64), [codes[a:b].tobytes() for a, b in zip(head.tolist(), stop)], [logs[a:b].tobytes() for a, b in zip(head.tolist(), stop)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ASKED)], schema=ASKED)


def _ask_samples(routes: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, routes)
                if len(chunk.code):
                    grams, counts = np.unique(chunk.code, return_counts=True)
                    low = np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, : LOW // 8]
                    yield _ask(row["chunk"], grams >> np.uint64(LOW), np.ascontiguousarray(low), counts)

    return run


def _ask_strings(routes: int):
    """Buckets that are split by all bytes of their strings."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, routes)
                codes, which = chunk.string_codes(chunk.hot_strings(chunk.classes(row["flags"])), routes)
                if len(codes):
                    yield _ask(row["chunk"], codes["route"], np.stack([codes["a"], codes["b"]], axis=1), np.bincount(which))

    return run


@tidied
def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which codes of each chunk occur in two places or more anywhere, and which in more than LIMIT: a bit for each."""
    for table in _groups(batches, 1):
        route = table.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(route[1:] != route[:-1]) + 1).tolist(), len(route)]
        for a, b in zip(cuts, cuts[1:]):  # one route at a time: a batch may have several, each with ROUTE codes
            rows = _judged(int(route[a]), table.slice(a, b - a))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), JUDGED)], schema=JUDGED)


def _judged(route: int, asked: pa.Table) -> list[tuple]:
    chunk = asked.column(1).to_numpy()
    size = pa.compute.binary_length(asked.column(3)).to_numpy().astype(np.int64)
    logs = np.frombuffer(b"".join(asked.column(3).to_pylist()), np.uint8)
    raw = np.frombuffer(b"".join(asked.column(2).to_pylist()), np.uint8).reshape(len(logs), -1)
    words = np.zeros((len(logs), -(-raw.shape[1] // 8) * 8), np.uint8)
    words[:, : raw.shape[1]] = raw
    words = words.view("<u8")
    order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
    ranked = words[order]
    head = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)]))
    del raw, words, ranked
    total = np.add.reduceat(np.left_shift(1, logs[order].astype(np.int64)), head)
    seen = np.empty(len(logs), np.int8)
    seen[order] = np.repeat((total > 1).astype(np.int8) + (total > LIMIT), np.diff(np.concatenate([head, [len(logs)]])))
    end = size.cumsum()
    rows = []
    for k, (a, b) in enumerate(zip((end - size).tolist(), end.tolist())):
        repeated, hot = seen[a:b] > 0, seen[a:b] > 1
        if repeated.any():
            rows.append((int(chunk[k]), route, np.packbits(repeated).tobytes(), np.packbits(hot).tobytes() if hot.any() else None))
    return rows


JUDGED = pa.schema([("chunk", pa.int64()), ("route", pa.int64()), ("bits", pa.binary()), ("hot", pa.binary())])
JUDGED_SQL = "chunk long, route long, bits binary, hot binary"


def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Runs of whole groups of equal ``route`` from sorted batches, at least ``least`` rows each but the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        route = batch.column(0).to_numpy()
        cut = int(np.searchsorted(route, route[-1]))
        if rows + cut >= least:
            starts_new = not held or held[-1].column(0)[-1].as_py() != int(route[0])
            if cut or starts_new:
                if cut:
                    held.append(batch.slice(0, cut))
                    batch = batch.slice(cut)
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


BLOCK = pa.schema([("route", pa.int64()), ("solved", pa.bool_()), ("key", pa.binary()), ("start", pa.int32()), ("strings", pa.int32()), ("anchor", pa.int32()), ("block", pa.binary())])
BLOCK_SQL = "route long, solved boolean, key binary, start int, strings int, anchor int, block binary"


def _block_batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    """In parts, so that no second copy of all blocks is made."""
    for at in range(0, len(rows), PART):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + PART]), BLOCK)], schema=BLOCK)


def _emit_blocks(routes: int):
    """Step 2: the bytes around each repeated sample; equal blocks of a batch are solved at home and leave it once."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            homes: dict[tuple[int, int, bytes], int] = {}
            for row in batch.to_pylist():
                chunk = _Chunk(row, routes)
                at = np.flatnonzero(chunk.classes(row["flags"]) == 1)
                first, last = chunk.windows(chunk.sample[at], chunk.owner[at])
                ok = first <= last
                at, first, last = at[ok], first[ok], last[ok]
                owner, code = chunk.owner[at], chunk.code[at].view(np.int64)
                raw, keys = chunk.raw, chunk.keys
                for p, route, a, b, who, begin in zip(chunk.sample[at].tolist(), code.tolist(), first.tolist(), last.tolist(), owner.tolist(), chunk.start[owner].tolist()):
                    block = raw[a : b + LENGTH]
                    key = keys[16 * who : 16 * who + 16]
                    home = homes.get(same := (route, p - a, block))
                    if home is None:
                        homes[same] = len(rows)
                        rows.append([route, False, key, a - begin, b - a + 1, p - a, block])
                    else:
                        if not rows[home][1]:
                            rows[home][1] = True
                            rows.append([rows[home][3] ^ route, True, *rows[home][2:5], None, None])
                        rows.append([(a - begin) ^ route ^ who, True, key, a - begin, b - a + 1, None, None])
                if len(rows) >= 40_000:
                    homes.clear()
                    yield from _block_batches(rows)
                    rows = []
            yield from _block_batches(rows)

    return run


def _split_runs(routes: int):
    """Runs ``key, start, strings`` of repeated strings around samples of class 2, from the answers in ``more``."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, routes)
                at = chunk.hot_strings(chunk.classes(row["flags"]))
                codes, which = chunk.string_codes(at, routes)
                at = at[(_answers(codes["route"], row["more"]) > 0)[which]]
                if not len(at):
                    continue
                owner = np.searchsorted(chunk.start, at, "right") - 1
                head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])]))
                strings = np.diff(np.concatenate([head, [len(at)]]))
                keys = [chunk.keys[16 * w : 16 * w + 16] for w in owner[head].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array((at[head] - chunk.start[owner[head]]).astype(np.int32)), pa.array(strings.astype(np.int32))], ["key", "start", "strings"])

    return run


def _windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rows of ``length`` bytes from each place on, zeros beyond the end; no matrix of places is made, which would be eight times as large."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(length, np.uint8)]), length)[at]


def _ranked(context: np.ndarray, route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of padded contexts within their buckets and common prefixes of neighbours (-1 across buckets)."""
    words = np.ascontiguousarray(context).view(">u8").astype(np.uint64)
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), route))
    c, r = context[order], route[order]
    unlike = c[1:] != c[:-1]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), context.shape[1])
    common[r[1:] != r[:-1]] = -1
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each context's first ``depth`` bytes: equal ranks, equal bytes of one bucket."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(common < depth)])
    return rank


@tidied
def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: ``key, start, strings`` of runs of repeated strings, bucket after bucket."""
    for table in _groups(batches, BLOCKS):
        table = table.combine_chunks()
        blocks = np.array([x is not None for x in table.column("anchor").to_pylist()], bool)
        at = np.flatnonzero(~blocks)
        if len(at):
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(pa.array(at)) for c in ("key", "start", "strings")], ["key", "start", "strings"])
        at = np.flatnonzero(blocks)
        if len(at) < 2:
            continue
        table = table.take(pa.array(at)).combine_chunks()
        route, solved = table.column("route").to_numpy(), table.column("solved").to_numpy(zero_copy_only=False)
        start, strings, anchor = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "strings", "anchor"))
        raw = table.column("block").to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.concatenate([[0], size.cumsum()[:-1]])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        n = len(raw)
        del raw
        right = np.arange(LENGTH)
        grid = _windows(flat, begin + anchor, LENGTH)
        grid[right >= (size - anchor)[:, None]] = 0
        r_order, r_common = _ranked(grid, route)
        left = np.arange(-(-V // 8) * 8)
        grid = _windows(flat[::-1], len(flat) - begin - anchor, len(left))
        grid[left >= anchor[:, None]] = 0
        l_order, l_common = _ranked(grid, route)
        del grid
        hit = np.zeros((n, V + 1), bool)  # by distance from the string's start to the sample, largest first
        for d in range(int(anchor.max()) + 1):
            own = np.flatnonzero((d <= anchor) & (d > anchor - strings))
            if len(own) < 2:
                continue
            rank = _classes(l_order, l_common, d)[own] * n + _classes(r_order, r_common, LENGTH - d)[own]
            by = rank.argsort(kind="stable")
            same = rank[by[1:]] == rank[by[:-1]]
            hit[own[by[1:][same]], V - 1 - d] = True
            hit[own[by[:-1][same]], V - 1 - d] = True
        hit[solved] = False
        edges = np.diff(np.pad(hit, ((0, 0), (1, 0))).astype(np.int8), axis=1)
        row, first = np.nonzero(edges == 1)
        _, end = np.nonzero(edges == -1)
        origin = start[row] + anchor[row] - (V - 1)
        yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(pa.array(row)), pa.array((origin + first).astype(np.int32)), pa.array((end - first).astype(np.int32))], ["key", "start", "strings"])


def _answered(asked: DataFrame, n: int, name: str) -> DataFrame:
    """``chunk, <name>``: what ``_judge`` answers each chunk."""
    judged = asked.repartition(n, "route").sortWithinPartitions("route").mapInArrow(_judge, JUDGED_SQL)
    return materialize(judged.groupBy("chunk").agg(F.collect_list(F.struct("route", "bits", "hot")).alias(name)), name)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``key, spans`` of each distinct text with repeated strings: byte ranges ``start, end``, unsorted, may overlap.

    A text that has copies goes wholly; one of them stays in the search, for what other texts share with it.
    """
    n = partitions(docs.sparkSession)
    keyed = docs.select("text", text_key(F.col("text")).alias("key"), F.octet_length("text").alias("n")).where(F.col("n") >= LENGTH)
    twins = materialize(keyed.groupBy("key").agg(F.count("*").alias("c"), F.first("n").alias("n")).where("c > 1").select("key", "n"), "twins")
    texts = keyed.join(twins.select("key"), "key", "left_anti").select("text")
    texts = texts.union(keyed.join(twins.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("text"))
    chunks = materialize(texts.mapInArrow(_chunker(max(CHUNK, min(CHUNK << 6, n << 10))), CHUNKS_SQL), "chunks")
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    routes = max(n, size * len(D) // V // ROUTE)
    flags = _answered(chunks.mapInArrow(_ask_samples(routes), ASKED_SQL), n, "flags")
    release(docs.sparkSession)  # the texts' and the samples' shuffles, before the blocks' larger one
    # A copy with its answers, so that the join's shuffle of all texts is gone as well when the blocks are dealt.
    flagged = materialize(chunks.join(flags, "chunk"), "flagged")
    for table in (chunks, flags):
        discard(table)
    blocks = flagged.mapInArrow(_emit_blocks(routes), BLOCK_SQL)
    runs = blocks.repartition(n, "route").sortWithinPartitions("route").mapInArrow(_sort_buckets, "key binary, start int, strings int")
    hot = flagged.where(F.exists("flags", lambda f: f["hot"].isNotNull()))
    if not hot.isEmpty():
        more = _answered(hot.mapInArrow(_ask_strings(routes), ASKED_SQL), n, "more")
        runs = runs.union(hot.join(more, "chunk").mapInArrow(_split_runs(routes), "key binary, start int, strings int"))
    spans = runs.select("key", F.struct(F.col("start"), (F.col("start") + F.col("strings") - 1 + LENGTH).alias("end")).alias("span"))
    whole = twins.select("key", F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")).alias("span"))
    found = materialize(spans.union(whole).groupBy("key").agg(F.collect_list("span").alias("spans")), "spans")
    discard(flagged)
    return found


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _rest(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    begins = [0, *(e for _, e in gone)]
    ends = [*(s for s, _ in gone), len(text)]
    return b"".join([text[a:b] for a, b in zip(begins, ends)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        rest, sizes, removed, runs = [], [], [], []
        for text, spans in zip(texts, batch.column(batch.schema.get_field_index("q_spans"))):
            text = text.as_py() or b""
            gone = _union(spans.as_py() or [])
            rest.append(_rest(text, gone))
            sizes.append(len(text))
            removed.append(len(text) - len(rest[-1]))
            runs.append(len(gone))
        names = [x for x in batch.schema.names if x != "q_spans"]
        arrays = [batch.column(batch.schema.get_field_index(x)) for x in names]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(rest, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], [*names, "q_rest", "q_bytes", "q_removed", "q_runs"])


@tidied
def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their repeats; rows of which nothing but white space stays are dropped."""
    for batch in batches:
        k = batch.schema.get_field_index("text")
        texts, stay = [], []
        for text, spans in zip(batch.column(k).cast(pa.binary()), batch.column(batch.schema.get_field_index("q_spans"))):
            text, gone = text.as_py(), _union(spans.as_py() or [])
            if gone:
                text = _rest(text, gone)
            texts.append(None if text is None else text.decode("utf-8", "ignore"))
            stay.append(not gone or bool(text.strip()))
        names = [x for x in batch.schema.names if x != "q_spans"]
        arrays = [pa.array(texts, pa.string()) if x == "text" else batch.column(batch.schema.get_field_index(x)) for x in names]
        yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(stay, pa.bool_()))


def _with_spans(docs: DataFrame) -> DataFrame:
    spans = repeated_spans(docs).select(F.col("key").alias("q_key"), F.col("spans").alias("q_spans"))
    release(docs.sparkSession)
    return docs.withColumn("q_k", text_key(F.col("text"))).join(spans, F.col("q_k") == F.col("q_key"), "left").select(*docs.columns, "q_spans")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``q_rest`` (remaining bytes), ``q_bytes``, ``q_removed`` and ``q_runs``.

    Each byte of ``text`` that a 200-byte string covers which also starts elsewhere, in any document or the same, is
    removed; strings are judged on the input and never cross documents. Null texts are empty; texts under 200
    bytes stay whole; of repeated rows and exact copies nothing stays (from 200 bytes on); ties don't matter, as all
    copies of a string go; other columns stay; an empty table gives an empty result.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("q_rest", T.BinaryType()), *(T.StructField(x, T.LongType()) for x in ("q_bytes", "q_removed", "q_runs"))])
    return _with_spans(docs).mapInArrow(_cut, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; a document of which nothing but white space stays is dropped.

    Cut ends may split a character; its stray bytes go too. Null and short texts stay; of repeated rows and exact copies from
    ``LENGTH`` bytes on nothing stays; very long texts are cut like others; null ids don't matter, other columns stay whatever
    their names and types, an empty table gives an empty result.
    """
    rows = seal(docs, "text")
    return _with_spans(rows).mapInArrow(_rewrite, rows.schema).toDF(*docs.columns)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document; see ``cut_repeats``."""
    cut = cut_repeats(docs.select("doc_id", "text"))
    return cut.select("doc_id", F.col("q_bytes").alias("n_bytes"), F.col("q_removed").alias("n_removed"), F.col("q_runs").alias("n_spans"), F.sha2("q_rest", 256).alias("kept_sha256"))
