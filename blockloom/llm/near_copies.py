"""Near copies of texts by SimHash, verified by the Jaccard similarity of their word shingles and completed exactly.

Fingerprints at a few bits of 64 find the closest copies; at a similarity of 0.8 they differ in about ten bits, beyond what
Hamming balls can list. Those copies are found by the prefixes of their sorted shingles instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.columns import row_hash, tidied
from blockloom.llm.components import connected_components
from blockloom.llm.simhash import BLOCK, grouped, keep_lowest, near_pairs
from blockloom.scratch import discard, materialize, release, shuffled

#: Words of a shingle, and the least similarity of a near copy as a fraction.
WORDS, TOP, BOTTOM = 5, 4, 5
#: Texts whose shingles are counted to tell common shingles from rare ones, the least count of a common one, and how many
#: are told apart. They choose the order of shingles and with it speed; any order finds the same pairs.
SAMPLE, COMMON, TOLD = 10_000, 4, 200_000
#: Sets that still meet at a shingle are paired in blocks of so many, where so many 64-bit words of parities allow it.
BLOCK_OF, WORDS_OF_BITS = 256, 8
#: A place names so many keys before it that its set meets others at: sets that share one of them have met there already.
EARLIER = 4


def shingle_hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    got = (text or b"").lower().split()
    if not got:
        return np.zeros(0, np.int64)
    shingles = [b" ".join(got)] if len(got) < words else map(b" ".join, zip(*(got[k:] for k in range(words))))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles)), np.int64))


def sketch(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of distinct shingle hashes; 0 for none."""
    ones, raw = np.zeros(64, np.int64), hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), BLOCK):
        ones += np.unpackbits(raw[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big", signed=True)


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of the distinct hashes ends in each value of some bits; two to four values for each hash, 512 at least.

    A hash that only one of two sets has flips one parity, so sets differ in at least as many hashes as their parities differ.
    """
    size = max(64 * WORDS_OF_BITS, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount(hashes & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def parities_apart(x: bytes, y: bytes) -> int:
    """In how many parities two sets differ; the longer ones are folded to those by one bit less until both are as long."""
    a, b = (np.frombuffer(z, np.uint8) for z in (x, y))
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


@tidied
def _all_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0).cast(pa.binary()):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(x.as_py()))], ["key"])


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and their counts, from a sample of texts."""
    part = max(1, docs.count() // SAMPLE)
    rows = docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text").mapInArrow(_all_hashes, "key long")
    got = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(TOLD).toArrow()
    keys, counts = (got.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which similar texts share one: all but so many as two texts must share, rare ones first."""
    size = len(hashes) - (TOP * len(hashes) + BOTTOM - 1) // BOTTOM + 1 if len(hashes) else 0
    keys, counts = common
    if len(keys) and len(hashes):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(keys[at] == hashes, counts[at], 0)))]
    return hashes[:size]


def _sets(docs: DataFrame) -> DataFrame:
    """``doc_id, row_hash, fp, sim, n, odd, prefix`` of every row; ``fp`` is equal for equal sets of shingles, ``sim`` their SimHash, ``n`` their size, ``odd`` their parities."""
    common = common_shingles(docs)

    @tidied
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x.as_py()) for x in batch.column(0).cast(pa.binary())]
            prints = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            columns = [pa.array(prints), pa.array([sketch(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            columns += [pa.array([parities(s) for s in sets], pa.binary()), pa.array([prefix(s, common) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], ["doc_id", "row_hash", "fp", "sim", "n", "odd", "prefix"])

    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash")).mapInArrow(each, "doc_id long, row_hash long, fp long, sim long, n int, odd binary, prefix array<long>")


def _may_be_similar(a: str, b: str) -> Column:
    """Whether sizes and the places of a shared shingle, of texts ``a`` and ``b``, leave room for enough shared ones."""
    most = f"least({a}.pos, {b}.pos) + 1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1"
    return F.expr(f"{TOP + BOTTOM} * ({most}) >= {TOP} * ({a}.n + {b}.n)")


def _may_be_close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n, x, y = batch.columns
        apart = np.fromiter((parities_apart(u.as_py(), v.as_py()) for u, v in zip(x, y)), np.int64, len(n))
        keep = (BOTTOM - TOP) * n.to_numpy().astype(np.int64) >= (TOP + BOTTOM) * apart
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parities of all sets as equally many numbers ``o0, o1, ...``; longer ones are folded, which keeps them parities."""
    for batch in batches:
        rows = np.zeros((batch.num_rows, WORDS_OF_BITS), np.int64)
        for k, odd in enumerate(batch.column(1)):
            rows[k] = np.bitwise_xor.reduce(np.frombuffer(odd.as_py(), np.int64).reshape(-1, WORDS_OF_BITS), axis=0)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(WORDS_OF_BITS))], ["fp", *(f"o{k}" for k in range(WORDS_OF_BITS))])


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose parities leave room for enough shared shingles; no similar pair is lost."""
    one, two = (sets.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in ("a", "b"))
    both = pairs.join(shuffled(one), "a").join(shuffled(two), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "odd_a", "odd_b")
    return both.mapInArrow(_may_be_close, "a long, b long")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [squeeze(x.as_py() or b"") for x in batch.column(0).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], ["fp", "packed"])


@tidied
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs of ``a, b, x, y`` whose packed texts x and y are similar enough."""
    expand = zstandard.ZstdDecompressor().decompress
    last, other = None, np.zeros(0, np.int64)
    for batch in batches:
        keep = []
        for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if b != last:
                last, other = b, shingle_hashes(expand(y.as_py()))
            mine = shingle_hashes(expand(x.as_py()))
            common = len(np.intersect1d(mine, other, assume_unique=True))
            keep.append((TOP + BOTTOM) * common >= TOP * (len(mine) + len(other)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts' shingles are similar enough; only texts in close pairs are read again, and travel packed."""
    pairs = materialize(_close(pairs, sets), "close")
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(shuffled(sets.select("fp", "row_hash")), "fp"), "asked")
    texts = docs.select("text", row_hash(docs).alias("row_hash")).join(asked, "row_hash").select("text", "fp")
    packed = materialize(texts.mapInArrow(_pack, "fp long, packed binary").dropDuplicates(["fp"]), "packed")
    both = pairs.join(shuffled(packed.select(F.col("fp").alias("a"), F.col("packed").alias("x"))), "a").join(shuffled(packed.select(F.col("fp").alias("b"), F.col("packed").alias("y"))), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long")


def sketch_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets by their SimHash: each with the least of its own, and the least of those two bits apart."""
    least = sets.groupBy("sim").agg(F.min("fp").alias("first"))
    same = sets.join(shuffled(least), "sim").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    near = near_pairs(least.select(F.col("sim").alias("fp")))
    one, two = (least.select(F.col("sim").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b"))
    near = near.join(shuffled(one), "a").join(shuffled(two), "b").select(F.greatest("first_a", "first_b").alias("a"), F.least("first_a", "first_b").alias("b"))
    return same.union(near)


def similar_pairs(sets: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between different shingle sets ``fp`` that connect all that are similar, and no others.

    Two sets of Jaccard similarity t share a shingle among the first n - ceil(t n) + 1 of each, in whatever order is common
    to all; with rare shingles first few others meet there. Sets that share one are verified on all their shingles. First
    each is compared with those near its SimHash and with one of those it meets, the one with the fewest rarer shingles, as
    a copy without changes of its own is near to most. That links most groups without pairs of all their members. Then sets that still
    meet unlinked ones are compared with each of them, so that no similar pair stays unlinked; only those whose parities
    leave room become pairs (``_unlinked_pairs``).
    """
    first = places.where("fp = first")
    pairs = places.alias("p").join(shuffled(first.alias("q")), "key").where(F.expr("p.fp <> q.fp") & _may_be_similar("p", "q"))
    pairs = materialize(pairs.selectExpr("greatest(p.fp, q.fp) as a", "least(p.fp, q.fp) as b").union(sketch_pairs(sets)).distinct(), "pairs")
    links = materialize(_verified(pairs, sets, docs), "links")
    release(docs.sparkSession)
    roots = materialize(connected_components(links), "roots")
    rooted = places.join(shuffled(roots), F.col("fp") == F.col("node"), "left").select("key", "fp", "n", "pos", F.coalesce("root", "fp").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    hubs = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum("size").alias("size"), F.max_by("root", F.struct("size", "root")).alias("hub")).where("groups > 1").select("key", "size", "hub")
    rooted = rooted.join(shuffled(hubs), "key")
    rest = _unlinked_pairs(rooted, sets, pairs)
    return links.union(_verified(rest, sets, docs))


def _unlinked_pairs(rooted: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs, but for ``known`` ones, of different roots at one key whose sizes, places and folded parities leave room for enough shared shingles.

    The parities are compared in the join, so pairs that can't be similar are never rows.
    """
    odd = sets.select("fp", "odd").mapInArrow(_folded, ", ".join(["fp long", *(f"o{k} long" for k in range(WORDS_OF_BITS))]))
    before = F.collect_list("key").over(Window.partitionBy("fp").orderBy("pos").rowsBetween(-EARLIER, -1))
    rows = materialize(rooted.withColumn("earlier", before).join(shuffled(odd), "fp").withColumn("blocks", F.ceil(F.col("size") / BLOCK_OF).cast("int")), "bits")
    pairs = materialize(_first_met(rows).distinct().join(shuffled(known), ["a", "b"], "left_anti"), "pairs")
    discard(rows)
    return pairs


def _first_met(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different roots at one key, few of them more than once; a pair that can be similar is one at the first key it shares.

    At that key all shared shingles are still to come, so what either set has left must be enough, and no key before it is in both. A key's
    sets outside its hub are dealt into blocks, each of which meets all of the key's sets in a task of its own.
    """
    one = rows.where("root <> hub").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).alias("p")
    two = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("q")
    left = F.expr(f"{TOP + BOTTOM} * least(p.n - p.pos, q.n - q.pos) >= {TOP} * (p.n + q.n)")
    apart = " + ".join(f"bit_count(p.o{k} ^ q.o{k})" for k in range(WORDS_OF_BITS))
    room = F.expr(f"{TOP + BOTTOM} * ({apart}) <= {BOTTOM - TOP} * (p.n + q.n)")
    pairs = one.join(shuffled(two), ["key", "block"]).where(F.expr("p.root <> q.root") & left & room & F.expr("not arrays_overlap(p.earlier, q.earlier)"))
    return pairs.selectExpr("greatest(p.fp, q.fp) as a", "least(p.fp, q.fp) as b")


def keep_dissimilar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, of which each group of near copies keeps one: that with the smallest doc_id.

    Near copies have at least TOP / BOTTOM of their distinct WORDS-word shingles in common (Jaccard similarity of lower-case
    words); groups are what such pairs connect. Texts without words are copies of each other. Ties, null ids and
    repeated rows are as in ``keep_one``.
    """
    prints = materialize(_sets(docs), "prints")
    sets = materialize(prints.groupBy("fp").agg(F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("odd").alias("odd"), F.min("row_hash").alias("row_hash"), F.count("*").alias("rows")), "sets")
    twins = materialize(sets.where("rows > 1").select("fp"), "twins")
    wide = prints.select("fp", "n", "prefix")
    wide = wide.join(twins, "fp", "left_anti").union(wide.join(twins, "fp", "left_semi").dropDuplicates(["fp"]))
    met = _meeting(wide.select("fp", "n", F.posexplode("prefix").alias("pos", "key")))
    narrow = materialize(prints.select("doc_id", "row_hash", "fp"), "rows")
    discard(prints)
    release(docs.sparkSession)
    return keep_lowest(docs, grouped(narrow, similar_pairs(sets, met, docs)))


def _meeting(places: DataFrame) -> DataFrame:
    """``key, fp, n, pos, first`` of the places whose key two sets or more have; ``first`` is the one where the fewest rarer shingles come before."""
    meeting = places.groupBy("key").agg(F.count("*").alias("size"), F.min_by("fp", F.struct("pos", "fp")).alias("first")).where("size > 1").select("key", "first")
    return materialize(places.join(shuffled(meeting), "key"), "places")
