"""Token counts from flat, unindexed token files by scanning for end-of-document identifiers."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.files import list_files, open_read, open_write
from blockloom.llm.wordtok import default_vocabulary, word_ids
from blockloom.scratch import fresh_path, materialize

#: Identifier that ends a document, the vocabulary's own, which no text yields; ids are little-endian and unsigned, two bytes each.
END, WIDTH = 49407, 2
BLOCK = 4 << 20  # bytes scanned at a time, whatever the file's size
FILE = 64 << 20  # bytes after which a writer starts a new file


def _writer(folder: str, vocabulary: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary).ids
        out, path, ordinal, size = None, "", 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if out is None or size >= FILE:
                    if out:
                        out.close()
                    path, ordinal, size = f"{folder}/{uuid.uuid4().hex}.tok", 0, 0
                    out = open_write(path)
                ids = np.frombuffer(encode(text.as_py()), "<u4")
                if len(ids) and (int(ids.max()) >= 1 << 8 * WIDTH or (ids == END).any()):
                    raise ValueError("an identifier is too large or ends documents")
                data = ids.astype("<u2").tobytes() + struct.pack("<H", END)
                out.write(data)
                rows.append((path, ordinal, doc_id))
                ordinal, size = ordinal + 1, size + len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], ["path", "ordinal", "doc_id"])
        if out:
            out.close()

    return write


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` into flat files below ``folder``; returns ``path, ordinal, doc_id`` of what they hold.

    A file is ids and end identifiers, nothing else. Names are random and only those in the result count, so the files
    of lost or repeated tasks are never read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_writer(folder, vocabulary or default_vocabulary()), "path string, ordinal long, doc_id long")
    return materialize(rows, "token-index")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: ends in it, the first and the last of them (ids from the file's start), its own end, and gaps between its ends."""
    for batch in batches:
        rows = []
        for path, block, at, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
            with open_read(path) as f:
                f.seek(at)
                ids = np.frombuffer(f.read(size), "<u2")
            ends = np.flatnonzero(ids == END) + at // WIDTH
            rows.append((path, block, len(ends), int(ends[0]) if len(ends) else None, int(ends[-1]) if len(ends) else None, (at + size) // WIDTH, np.diff(ends).astype(np.int64) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))], SCAN)


SCAN = ["path", "block", "n", "first_end", "last_end", "stop", "gaps"]


def scan_token_files(spark: SparkSession, files: list[tuple[str, int]] | DataFrame, block: int = BLOCK) -> DataFrame:
    """``path, ordinal, start, n_tokens, closed`` of every document in flat token files.

    Files (``path, size``) are cut into blocks of fixed size, which tasks search with vector instructions. Of a block only
    the ends it holds leave it. A prefix scan over the blocks of each file then carries the last end and the number of ends
    before each block, which stitches the documents that lie across blocks, however many blocks one covers. What
    follows a file's last end is a last document that isn't ``closed``, unless it is empty.
    """
    if not isinstance(files, DataFrame):
        files = spark.createDataFrame(files, "path string, size long")
    step = block // WIDTH * WIDTH
    size = F.expr(f"size div {WIDTH} * {WIDTH}")
    blocks = files.where(F.col("size") >= WIDTH).select("path", size.alias("size")).select("path", "size", F.posexplode(F.expr(f"sequence(0L, size - 1, {step}L)")).alias("block", "at"))
    blocks = blocks.select("path", F.col("block").cast("long"), "at", F.least(F.lit(step), F.col("size") - F.col("at")).alias("size"))
    schema = "path string, block long, n long, first_end long, last_end long, stop long, gaps array<long>"
    # One block a row: spread them, or one task would scan all blocks of a file.
    found = blocks.repartition("path", "block").mapInArrow(_scan, schema)
    found = materialize(found, "ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.drop("gaps").withColumn("carry", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0))).withColumn("ordinal0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.withColumn("last", F.max("block").over(Window.partitionBy("path")) == F.col("block")).select("path", "block", "carry", "ordinal0", "last")
    got = found.join(sums, ["path", "block"])
    across = got.where("n > 0").select("path", F.col("ordinal0").alias("ordinal"), F.col("carry").alias("start"), (F.col("first_end") - F.col("carry")).alias("n_tokens"), F.lit(True).alias("closed"))
    inner = got.where("n > 1").select("path", "ordinal0", "first_end", F.posexplode("gaps").alias("k", "n_tokens"))
    scan = Window.partitionBy("path", "ordinal0").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("n_tokens") + 1).over(scan), F.lit(0))
    inner = inner.withColumn("start", F.col("first_end") + 1 + passed).select("path", (F.col("ordinal0") + 1 + F.col("k")).alias("ordinal"), "start", "n_tokens", F.lit(True).alias("closed"))
    start = F.coalesce(F.col("last_end") + 1, F.col("carry"))
    tail = got.where(F.col("last") & (start < F.col("stop"))).select("path", (F.col("ordinal0") + F.col("n")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), F.lit(False).alias("closed"))
    return across.union(inner).union(tail)


def token_counts(docs: DataFrame, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs(doc_id, text)``, counted in flat token files written from them.

    Null and empty texts have no tokens; null ids and repeated rows are counted as rows; very long texts may cover many
    blocks; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    index = write_token_files(docs, folder, vocabulary)
    try:
        sizes = {p.rpartition("/")[2]: n for p, n in list_files(folder)}
    except FileNotFoundError:
        sizes = {}
    files = spark.createDataFrame([(f"{folder}/{name}", n) for name, n in sizes.items()], "path string, size long")
    files = files.join(index.select("path").distinct(), "path", "left_semi")
    found = scan_token_files(spark, files, block)
    return index.join(found, ["path", "ordinal"]).select("doc_id", "n_tokens")
