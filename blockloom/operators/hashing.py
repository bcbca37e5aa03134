"""Content hashes of blocks and devices, their checks and the inverted index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_hashes(blocks: DataFrame) -> DataFrame:
    """``device, block_no, hash, length``; a short block is hashed as it is."""
    return blocks.select("device", "block_no", F.sha2("data", 256).alias("hash"), F.octet_length("data").alias("length"))


def zero_marked_hashes(blocks: DataFrame, block: int) -> DataFrame:
    """Hashes of which a whole all-zero block has the all-zero mark; a short one keeps its own."""
    zero = (F.ltrim(F.hex("data"), F.lit("0")) == "") & (F.octet_length("data") == block)
    return blocks.select("device", "block_no", F.when(zero, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("data", 256)).alias("hash"))


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, rows = None, None, []
    for batch in batches:
        for device, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if state is None or device != now:
                if state is not None:
                    rows.append((now, state.hexdigest()))
                now, state = device, hashlib.sha256()
            state.update(data.as_py())
    if state is not None:
        rows.append((now, state.hexdigest()))
    columns = list(zip(*rows)) if rows else [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["device", "hash"])


def device_hashes(blocks: DataFrame) -> DataFrame:
    """sha256 of each device's content in block order. It can't be merged from parts, so a device streams through one task, block by block."""
    rows = blocks.repartition("device").sortWithinPartitions("device", "block_no").select(F.col("device").cast("long"), "data")
    return rows.mapInArrow(_digest_runs, "device long, hash string")


def hash_index(hashes: DataFrame) -> DataFrame:
    """``hash -> n_locations, first_device, first_block``, locations ordered by device and block.

    The full list stays a relation (``hashes`` itself, keyed by hash): a block that a third of all devices share would not
    fit a row.
    """
    where = F.struct("device", "block_no")
    return hashes.groupBy("hash").agg(F.count("*").alias("n_locations"), F.min(where).alias("w")).select("hash", "n_locations", F.col("w.device").alias("first_device"), F.col("w.block_no").alias("first_block"))


def index_metrics(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("hash").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_locations"))


def read_by_hash(requests: DataFrame, hashes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bytes of the first location of each requested hash: ``hash, device, block_no, data``, null where it is unknown."""
    first = hash_index(hashes.join(requests.select("hash").distinct(), "hash", "left_semi"))
    found = first.select("hash", F.col("first_device").alias("device"), F.col("first_block").alias("block_no")).join(blocks, ["device", "block_no"])
    return requests.join(found, "hash", "left")


def check(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """``device, n_missing, ok`` for each device: a block without an expected hash is missing, a wrong one isn't ok."""
    got = block_hashes(blocks).join(expected.select("device", "block_no", F.col("hash").alias("want")), ["device", "block_no"], "left")
    return got.groupBy("device").agg(F.count_if(F.col("want").isNull()).alias("n_missing"), F.every(F.coalesce(F.col("hash") == F.col("want"), F.lit(True))).alias("ok"))


def match_sources(writes: DataFrame, sources: DataFrame) -> DataFrame:
    """Outgoing writes ``device, offset, length, hash`` that an alternate source with equal range and hash replaces: adds ``sent``, HASH or DATA."""
    known = sources.select("device", "offset", "length", "hash").distinct().withColumn("_known", F.lit(True))
    return writes.join(known, ["device", "offset", "length", "hash"], "left").withColumn("sent", F.when(F.col("_known"), "HASH").otherwise("DATA")).drop("_known")


def pull_sources(sources: DataFrame, store: DataFrame) -> DataFrame:
    """Bytes of each source from ``store(location, data)``, with ``verified``: their hash is the source's."""
    return sources.join(store, "location").withColumn("verified", F.sha2("data", 256) == F.col("hash"))


def without_data(writes: DataFrame) -> DataFrame:
    """Every write as a reference: range and hash of its bytes."""
    return writes.select("device", "offset", F.octet_length("data").alias("length"), F.sha2("data", 256).alias("hash"))


def safe_blocks(status: DataFrame) -> DataFrame:
    """Blocks whose last write has arrived: set, and current is what was being updated."""
    return status.where(F.col("is_set") & (F.col("current_id") == F.col("updating_id"))).select("device", "block_no", F.col("current_hash").alias("hash"))


def alternate_sources(safe: DataFrame, size, block: int, location: str) -> DataFrame:
    """Safe blocks as sources, the last cut at the device's end (``size``: a column or number)."""
    offset = F.col("block_no") * block
    end = size if not isinstance(size, int) else F.lit(size)
    return safe.select("device", offset.alias("offset"), F.least(F.lit(block), end - offset).alias("length"), "hash", F.concat_ws(" ", F.lit(location), F.col("device").cast("string")).alias("location"))
