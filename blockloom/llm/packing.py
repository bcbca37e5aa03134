"""Best-fit packing of tokenised documents by linear grouping."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.columns import tidied
from blockloom.llm.wordtok import default_vocabulary, word_ids
from blockloom.scratch import materialize

CAPACITY = 2048
#: Pieces longer than this part of a sequence are large: they are grouped and configured, the rest is best-fitted.
SMALL_PART = 5
GROUPS = 64
#: Farley's bound: the linear programme is solved to within this part of its optimum.
GAP = 1e-3
#: Parts of the configured sequences, and FEW more, that a repair may open, tried in turn until no plan can be shorter.
REPAIR = (0.01, 0.02, 0.04, 0.08)
#: Most placement rows that are broadcast.
PLAN_ROWS = 1 << 18
FEW = 4
END = (0).to_bytes(4, "little")
#: Pieces of one length that share a rank range, roughly.
RANK_ROWS = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(vocabulary: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary, special=True).ids
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = memoryview(encode(text.as_py()) + END)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(rows)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return tidied(cut, keeps_words=True)


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every ``doc_id, text``: ids, then the end id 0; only longer ones are cut."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cutter(vocabulary or default_vocabulary(), capacity), PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """``(how often, how many of each size)``: a near-optimal packing of few sizes, by column generation.

    The linear programme over configurations is solved by the revised simplex method; a knapsack over the
    duals prices new configurations. Its solution is rounded down, so at most one configuration a size is lost, and
    what stays unplaced is left to the caller.
    """
    n = len(sizes)
    if not n:
        return []
    size, want = np.array(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(basis)
    x = inverse @ want
    for _ in range(60 * n):
        duals = inverse.sum(axis=0)  # costs are all one
        column, value = _price(sizes, duals, capacity)
        if value <= 1 + GAP:
            break
        step = inverse @ column
        rising = step > 1e-9
        ratios = np.where(rising, x / np.where(rising, step, 1), np.inf)
        out = int(ratios.argmin())
        x = x - ratios[out] * step
        x[out] = ratios[out]
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
    got = []
    for k in range(n):
        times = int(x[k] + 1e-6)
        if times > 0:
            got.append((times, basis[:, k].round().astype(int).tolist()))
    return got


def _price(sizes: list[int], duals: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of the highest value: a knapsack, one layer for each item that a sequence can hold."""
    layers = [np.zeros(capacity + 1)]
    chosen: list[np.ndarray] = []
    for _ in range(capacity // min(sizes)):
        best, pick = layers[-1].copy(), np.full(capacity + 1, -1)
        for k, s in enumerate(sizes):
            value = layers[-1][: capacity + 1 - s] + duals[k]
            better = value > best[s:]
            best[s:][better] = value[better]
            pick[s:][better] = k
        layers.append(best)
        chosen.append(pick)
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(chosen):
        if (k := pick[room]) >= 0:
            column[k] += 1
            room -= sizes[k]
    return column, float(layers[-1][capacity])


class _Bins:
    """Sequences in runs of equal content: ``[count, used, parts]`` by free space. parts: ``(length, how many)``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[list]] = {}
        self.rooms: list[int] = []

    def add(self, count: int, used: int, parts: list[tuple[int, int]]) -> None:
        room = self.capacity - used
        if count and room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        if count:
            self.by_room[room].append([count, used, parts])

    def take(self, length: int) -> list | None:
        """The run with the least free space that takes ``length``."""
        k = bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(k)
        return run

    def best_fit(self, length: int, n: int) -> None:
        """Place ``n`` pieces of one length one after another, each where it leaves the least room; runs share a step."""
        while n:
            fresh = min(self.capacity // length, n)
            count, used, parts = self.take(length) or [n // fresh, 0, []]
            each = min((self.capacity - used) // length, n)
            full = min(count, n // each)
            self.add(count - full, used, parts)
            self.add(full, used + each * length, [*parts, (length, each)])
            n -= full * each

    def total(self) -> int:
        return sum(run[0] for run in self.runs())

    def runs(self) -> list[list]:
        return [run for room in self.rooms for run in self.by_room[room]]


class _Stock:
    """Pieces by length, of which the longest that fits is taken."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.lengths = dict(counts), sorted(counts)

    def longest(self, room: int, drawn: Counter) -> int | None:
        k = bisect_right(self.lengths, room) - 1
        while k >= 0 and self.counts[self.lengths[k]] <= drawn[self.lengths[k]]:
            if not self.counts[self.lengths[k]]:
                self.lengths.pop(k)
            k -= 1
        return self.lengths[k] if k >= 0 else None

    def fill(self, slots: list[int], capacity: int, times: int) -> tuple[int, list[int]]:
        """``(how many, lengths)`` of up to ``times`` equal sequences: each slot but the last takes the longest piece of
        its size or less, the last the longest that the real lengths of the others leave room for."""
        parts: list[int] = []
        drawn: Counter = Counter()
        for k, size in enumerate(slots):
            room = capacity - sum(parts)
            length = self.longest(room if k == len(slots) - 1 else min(size, room), drawn)
            if length is None:
                break
            parts.append(length)
            drawn[length] += 1
        step = min([times, *(self.counts[x] // n for x, n in drawn.items())])
        for length, n in drawn.items():
            self.counts[length] -= n * step
        return step, parts

    def rest(self) -> dict[int, int]:
        return {k: n for k, n in self.counts.items() if n}


def grouped_sizes(counts: dict[int, int], groups: int) -> tuple[list[int], list[int]]:
    """Linear grouping: ``sizes, demand`` of groups of equal cardinality in order of length, each as long as its longest;
    no more lengths than groups stay as they are."""
    if len(counts) <= groups:
        return sorted(counts), [counts[k] for k in sorted(counts)]
    demand: dict[int, int] = {}
    members, room, each = [], 0, -(-sum(counts.values()) // groups)
    for length in sorted(counts):
        n = counts[length]
        while n:
            if not room:
                members.append([length, 0])
                room = each
            part = min(n, room)
            members[-1] = [length, members[-1][1] + part]
            n, room = n - part, room - part
    for size, n in members:
        demand[size] = demand.get(size, 0) + n
    return list(demand), list(demand.values())


def solve(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PART) -> tuple[_Bins, int, int]:
    """``(sequences, configured, kept)`` for ``length -> how many``.

    Large lengths are grouped and rounded up, and the programme's configurations are filled with real pieces, those of
    few slots first; a filling that lacks a large piece's room, as its
    slots' own pieces have run out, is not used. Small pieces then go where they leave the least room. Where that needs more sequences than the total size asks
    for, the emptiest ones, up to a part of REPAIR, are opened and all their pieces best-fitted. ``kept`` counts each of them as configured.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v}
    least = -(-sum(k * n for k, n in left.items()) // capacity)
    full = left.pop(capacity, 0)
    large = {k: n for k, n in left.items() if k * small_part > capacity}
    sizes, demand = grouped_sizes(large, groups)
    stock, filled, spare, configured = _Stock(large), [], Counter(), 0
    for times, counts in sorted(configurations(sizes, demand, capacity), key=lambda c: sum(c[1])):
        slots = [s for s, c in zip(reversed(sizes), reversed(counts)) for _ in range(c)]
        while times:
            step, parts = stock.fill(slots, capacity, times)
            if not parts:
                break
            times, configured = times - step, configured + step
            if (sum(slots) - sum(parts)) * small_part <= capacity:
                filled.append((step, parts))
            else:
                spare.update({length: step * n for length, n in Counter(parts).items()})
    rest = Counter({k: n for k, n in left.items() if k not in large}) + Counter(stock.rest()) + spare
    first = _Bins(capacity)
    first.add(full, capacity, [(capacity, 1)])
    for step, parts in filled:
        first.add(step, sum(parts), sorted(Counter(parts).items()))
    for length in sorted(rest, reverse=True):
        first.best_fit(length, rest[length])
    used = sum(step for step, _ in filled)
    best, kept = first, used
    for share in REPAIR:
        if best.total() == least:
            break
        bins, loose, still = _Bins(capacity), Counter(), int(configured * share) + FEW
        for count, used, parts in reversed(first.runs()):
            n = min(count, still)
            still -= n
            bins.add(count - n, used, parts)
            for length, each in parts:
                loose[length] += n * each
        for length in sorted(loose, reverse=True):
            bins.best_fit(length, loose[length])
        if bins.total() < best.total():
            best, kept = bins, max(0, used - int(configured * share) - FEW)
    return best, configured, kept


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PART) -> list[tuple[int, int, int, int, int, int]]:
    """``length -> how many`` to placement rows ``(length, first_rank, end_rank, first_sequence, sequences, offset)``.

    Piece ``r`` of its length, first_rank <= r < end_rank, goes to sequence ``first_sequence + (r - first_rank) %
    sequences`` at ``offset + (r - first_rank) // sequences * length``. Both the input and the result are bounded by
    the capacity, whatever the number of documents.
    """
    bins, _, _ = solve(histogram, capacity, groups, small_part)
    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for count, _, parts in bins.runs():
        at = 0
        for length, each in parts:
            first = ranks[length]
            ranks[length] = first + count * each
            rows.append((length, first, ranks[length], sequence, count, at))
            at += each * length
        sequence += count
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id, offset`` to materialised ``pieces(doc_id, piece, length, ...)``.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, and only the placement plan,
    whose size depends on the capacity alone, is broadcast. A piece finds its place by its rank among the pieces of
    its length. Ranks are counted in ranges by a hash of doc_id, as many as a length's number of pieces asks for, so that a length
    that a third of all pieces have is spread over all tasks. Which of equal rows comes first doesn't matter.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in histogram.items()], "len long, ranges long")
    rows = pieces.join(ranges, F.col("length") == F.col("len")).withColumn("rank_range", F.expr("pmod(xxhash64(doc_id, piece), ranges)")).drop("len", "ranges")
    sums = rows.groupBy("length", "rank_range").agg(F.count("*").alias("n"))
    scan = Window.partitionBy("length").orderBy("rank_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "rank_range", F.coalesce(F.sum("n").over(scan), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "rank_range").orderBy("doc_id", "piece")
    rows = rows.withColumn("place", F.row_number().over(within)).join(sums, ["length", "rank_range"])
    rows = rows.withColumn("rank", F.col("before") + F.col("place") - 1).drop("rank_range", "before", "place")
    planned = plan(histogram, capacity, groups)
    table = spark.createDataFrame(planned, "len long, r0 long, r1 long, s0 long, n long, o0 long")
    rows = rows.join(F.broadcast(table) if len(planned) <= PLAN_ROWS else table, (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    k = F.col("rank") - F.col("r0")
    return rows.withColumn("sequence_id", F.col("s0") + k % F.col("n")).withColumn("offset", F.col("o0") + F.expr("(rank - r0) div n") * F.col("length")).drop("rank", "len", "r0", "r1", "s0", "n", "o0")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into few sequences of at most ``capacity`` tokens, one row per piece.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty text is the end id alone; null ids
    and repeated rows are packed like others; very long texts are cut into full pieces and a rest; other columns are
    ignored; an empty table gives an empty result.
    """
    placed = place(materialize(token_pieces(docs, vocabulary, capacity), "pieces"), capacity, groups)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
