"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.columns import row_hash, seal
from blockloom.llm.components import connected_components
from blockloom.scratch import materialize, shuffled

BLOCK = 1 << 16  # shingles hashed at a time: bounds memory for very long texts


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles (repeats count); 0 for a text without words."""
    got = (text or b"").lower().split()
    if not got:
        return 0
    digest = xxhash.xxh64_digest
    if len(got) < words:
        got = [b" ".join(got)]
        shingles = iter(got)
        total = 1
    else:
        shingles = map(b" ".join, zip(*(got[k:] for k in range(words))))
        total = len(got) - words + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, BLOCK):
        count = min(BLOCK, total - start)
        raw = b"".join([digest(next(shingles), seed) for _ in range(count)]) if count == BLOCK else b"".join([digest(s, seed) for s in shingles])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        prints = pa.array((fingerprint(x.as_py()) for x in texts), pa.int64(), size=len(texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], prints], [*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, row_hash, fp`` of every row; null texts count as empty (fingerprint 0). ``row_hash`` tells rows with one doc_id apart."""
    return docs.select("text", F.col("doc_id").cast("long"), row_hash(docs).alias("row_hash")).mapInArrow(_fingerprints, "doc_id long, row_hash long, fp long")


#: A 32-bit segment value shared by more fingerprints than this is looked up by a longer key.
CROWDED = 32


def _segment(k: int) -> Column:
    return F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def near_pairs(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that differ in one or two bits.

    Multi-index hashing: a fingerprint is two segments of 32 bits, each in its own table. Of two fingerprints at
    distance two or less, one segment agrees but for a single bit at most, so each segment is looked up with
    the Hamming ball of radius one around it; matches are then verified over all 64 bits. A ball needs only
    the neighbours with one more bit set, since of two values one bit apart either is the other's.

    A table entry shared by many fingerprints would be matched with all of them. Such crowded entries are
    looked up by a longer key instead, the segment plus one 16-bit quarter of the rest with its own ball; the
    budget of two bits leaves the rest at most 2 - r bits when the segment took r, so a quarter takes at
    most one (r = 0) or none (r = 1). No match is lost either way.
    """
    rows = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("seg"), _segment(k).alias("val"), _segment(1 - k).alias("rest")) for k in (0, 1)))).alias("s")).select("fp", "s.*")
    sizes = rows.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("seg", "val", F.lit(True).alias("crowded"))
    up = "filter(transform(sequence(0, {n}), b -> {v} | shiftleft(1L, b)), x -> x <> {v})"
    ball = F.expr("concat(array(struct(0 as r, val as key)), transform(" + up.format(n=31, v="val") + ", x -> struct(1 as r, x as key)))")
    quarter = "shiftrightunsigned(rest, 16 * {q}) & 65535"
    table = rows.join(sizes, ["seg", "val"], "left")
    probes = rows.withColumn("p", F.explode(ball)).select("fp", "seg", "rest", F.col("p.r").alias("r"), F.col("p.key").alias("val")).join(sizes, ["seg", "val"], "left")

    def spread(side: DataFrame, more: Column) -> DataFrame:
        """One row with quarter -1 for an ordinary entry, one a longer key for a crowded one."""
        plain = F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).cast("long").alias("sub"), F.lit(0).alias("r2")))
        return side.withColumn("k", F.explode(F.when(F.col("crowded"), more).otherwise(plain))).select("*", "k.*")

    exact = F.array(*(F.struct(F.lit(q).alias("q"), F.expr(quarter.format(q=q)).alias("sub"), F.lit(0).alias("r2")) for q in (0, 1)))
    near = F.concat(*(F.expr(f"transform(sequence(0, 15), b -> struct({q} as q, ({quarter.format(q=q)}) ^ shiftleft(1L, b) as sub, 1 as r2))") for q in (0, 1)))
    left = spread(probes, F.when(F.col("r") == 0, F.concat(exact, near)).otherwise(exact)).select(F.col("fp").alias("a"), "seg", "val", "q", "sub")
    right = spread(table, exact).select(F.col("fp").alias("b"), "seg", "val", "q", "sub")
    return (
        left.join(shuffled(right), ["seg", "val", "q", "sub"])
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    Documents whose fingerprints differ in at most two bits are linked; ``component_id`` is the smallest doc_id
    that can be reached. Copies share a fingerprint and never become pairs: links are found between distinct
    fingerprints only. Null and empty texts have fingerprint zero and link like any other; a null doc_id
    keeps its row and never becomes a component_id unless a component has no other; repeated rows stay
    repeated; other columns are ignored; an empty table gives an empty result.
    """
    return _grouped(materialize(fingerprints(docs), "prints")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(prints: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for materialised ``doc_id, fp``."""
    return grouped(prints, near_pairs(prints.select("fp").distinct()))


def grouped(prints: DataFrame, links: DataFrame) -> DataFrame:
    """The same for any links ``(a, b)`` between values of ``fp``."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = materialize(connected_components(links), "roots")
    named = distinct.join(shuffled(roots), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(shuffled(lowest), "root").select("fp", "component_id")
    return prints.join(shuffled(classes), "fp").select("doc_id", "row_hash", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, of which each group keeps one: that with the smallest doc_id.

    Between rows of one group that share this doc_id the smallest row hash decides, and of wholly equal rows one
    stays. Groups are found on fingerprints alone; texts are shuffled once, by keys that don't repeat.
    """
    return keep_lowest(docs, _grouped(materialize(fingerprints(docs), "prints")))


def keep_lowest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``keep_one`` for ``doc_id, row_hash, fp, component_id`` of all rows."""
    groups = materialize(groups, "grouped")
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("row_hash").alias("h"))
    # A group is its component's smallest id; components without any id keep their fingerprints apart.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    copies = groups.groupBy(group.alias("g"), ranked.alias("r")).agg(F.count("*").alias("n"))
    best = copies.groupBy("g").agg(F.min(F.struct("r", "n")).alias("b")).select(F.col("b.r.i").alias("q_id"), F.col("b.r.h").alias("q_hash"), F.col("b.n").alias("q_n"))
    rows = seal(docs, "doc_id")
    names = rows.columns
    kept = rows.withColumn("q_row", row_hash(rows)).join(shuffled(best), (F.col("q_row") == F.col("q_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("q_id")))
    return kept.where("q_n = 1").select(*names).union(kept.where("q_n > 1").groupBy("q_row").agg(*(F.first(c).alias(c) for c in names)).select(*names)).toDF(*docs.columns)
