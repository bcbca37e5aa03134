"""Copy-on-write overlays, comparison and difference of devices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

ZERO_HASH = "0" * 64


def zeros(length: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), length.cast("int")))


def resolve(base: DataFrame, overlay: DataFrame, nonzero: DataFrame | None = None) -> DataFrame:
    """What a reader sees: the overlay's block, else the base's, else zeroes; ``block_no, data, origin``.

    ``nonzero(block_no)`` tells base blocks with content (``None``: all), so the others' payloads are not used.
    """
    over = overlay.select("block_no", F.col("data").alias("_over"))
    rows = base.join(over, "block_no", "left")
    if nonzero is not None:
        rows = rows.join(nonzero.select("block_no", F.lit(True).alias("_full")), "block_no", "left")
    else:
        rows = rows.withColumn("_full", F.lit(True))
    data = F.when(F.col("_over").isNotNull(), F.col("_over")).when(F.col("_full"), F.col("data")).otherwise(zeros(F.octet_length("data")))
    origin = F.when(F.col("_over").isNotNull(), "overlay").when(F.col("_full"), "base").otherwise("zero")
    return rows.select("block_no", data.alias("data"), origin.alias("origin"))


def nonzero_blocks(hashes: DataFrame) -> DataFrame:
    """Blocks whose hash isn't the all-zero mark."""
    return hashes.where(F.col("hash") != ZERO_HASH).select("block_no")


def resolve_layers(layers: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Many overlays in one pass: of each block the greatest depth that has it wins; the base has depth 0."""
    rows = layers.select("block_no", "depth", "data")
    if base is not None:
        rows = rows.union(base.select("block_no", F.lit(0).alias("depth"), "data"))
    return rows.groupBy("block_no").agg(F.max("depth").alias("depth"), F.max_by("data", "depth").alias("data"))


def unrequired(blocks: DataFrame, *overlays: DataFrame) -> DataFrame:
    """Blocks that no overlay has: all layers agree that a shared base can supply them."""
    rows = blocks.select("block_no")
    for overlay in overlays:
        rows = rows.join(overlay, "block_no", "left_anti")
    return rows


@F.pandas_udf(LongType())
def differing_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of unequal bytes of two binaries of one length."""
    return pd.Series([int(np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))) for x, y in zip(a, b)], dtype="int64")


def block_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``block_no, n_bytes`` of blocks that both have and that differ."""
    both = a.select("block_no", F.col("data").alias("a")).join(b.select("block_no", F.col("data").alias("b")), "block_no").where("a <> b")
    return both.select("block_no", differing_bytes(F.col("a"), F.col("b")).alias("n_bytes"))


def count_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``n_blocks, n_bytes`` by which two devices differ; an error if one lacks a block of the other, or blocks differ in length."""
    both = a.select("block_no", F.col("data").alias("a")).join(b.select("block_no", F.col("data").alias("b")), "block_no", "full_outer")
    fits = F.coalesce(F.octet_length("a") == F.octet_length("b"), F.lit(False))
    other = both.where(~fits | (F.col("a") != F.col("b"))).select(F.when(fits, F.col("a")).otherwise(F.raise_error(F.lit("devices differ in size")).cast("binary")).alias("a"), "b")
    return other.select(differing_bytes("a", "b").alias("n")).agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_bytes"))


def equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """``equal``: the same blocks with the same bytes."""
    both = a.select("block_no", F.col("data").alias("a")).join(b.select("block_no", F.col("data").alias("b")), "block_no", "full_outer")
    return both.agg(F.coalesce(F.every(F.coalesce(F.col("a") == F.col("b"), F.lit(False))), F.lit(True)).alias("equal"))


def overlay_metrics(base: DataFrame, overlay: DataFrame, nonzero: DataFrame, block: int) -> DataFrame:
    """``size, overlay_size, nonzero_size`` in bytes, rounded to blocks."""
    marks = [base.select(F.lit("size").alias("k")), overlay.select(F.lit("overlay_size").alias("k")), nonzero.select(F.lit("nonzero_size").alias("k"))]
    rows = marks[0].union(marks[1]).union(marks[2])
    return rows.agg(*((F.count_if(F.col("k") == k) * block).alias(k) for k in ("size", "overlay_size", "nonzero_size")))


def write_through(base: DataFrame, overlay: DataFrame, writes: DataFrame) -> DataFrame:
    """The overlay after whole and partial writes ``block_no, seq, rel_offset, part``.

    Only blocks with a partial first write read the base. Parts fold in order of seq: each keeps the bytes before and
    after it and replaces the rest. Lists hold one block's writes, so cut long logs into epochs.
    """
    start = base.join(writes.select("block_no").distinct(), "block_no", "left_semi").join(overlay.select("block_no", F.col("data").alias("_over")), "block_no", "left").select("block_no", F.coalesce("_over", "data").alias("_seed"))
    folded = writes.groupBy("block_no").agg(F.array_sort(F.collect_list(F.struct("seq", "rel_offset", "part"))).alias("w"))
    rows = start.join(folded, "block_no").withColumn(
        "data",
        F.expr("aggregate(w, _seed, (a, x) -> concat(substring(a, 1, cast(x.rel_offset as int)), x.part, substring(a, cast(x.rel_offset as int) + octet_length(x.part) + 1)))"),
    )
    return rows.select("block_no", "data").union(overlay.join(rows, "block_no", "left_anti").select("block_no", "data"))
