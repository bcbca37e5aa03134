"""Operations seen as blocks: which blocks they touch, how they split, and how writes fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def touches(ops: DataFrame, size: int, block: int) -> DataFrame:
    """One row for each block that an operation touches, clamped to the device.

    Adds ``block_no``, ``rel_offset`` and ``part_len`` (where the operation lies in the block), ``part_from`` (where the
    part lies in the operation) and ``complete`` (the part covers the whole block, a short last block included).
    Operations of no length or beyond the end touch nothing.
    """
    valid = ops.where((F.col("length") > 0) & (F.col("offset") < size))
    end = F.least(F.col("offset") + F.col("length"), F.lit(size))
    rows = valid.withColumn("_end", end).withColumn("block_no", F.explode(F.expr(f"sequence(offset div {block}, (_end - 1) div {block})")))
    low = F.greatest(F.col("offset"), F.col("block_no") * block)
    high = F.least(F.col("_end"), (F.col("block_no") + 1) * block)
    full = F.least(F.lit(block), F.lit(size) - F.col("block_no") * block)
    rows = rows.withColumn("rel_offset", low - F.col("block_no") * block).withColumn("part_from", low - F.col("offset")).withColumn("part_len", high - low)
    return rows.withColumn("complete", F.col("part_len") == full).drop("_end")


def map_over_blocks(ops: DataFrame, block: int) -> DataFrame:
    """Every block of ``[offset, offset + length)``, unclamped, with ``complete`` for the operation as a whole:
    false for all its blocks if its first or its last is partial."""
    rows = ops.where("length > 0").withColumn("block_no", F.explode(F.expr(f"sequence(offset div {block}, (offset + length - 1) div {block})")))
    return rows.withColumn("complete", (F.col("offset") % block == 0) & ((F.col("offset") + F.col("length")) % block == 0))


def is_zero(data: Column) -> Column:
    """All bytes zero; true for no bytes."""
    return F.ltrim(F.hex(data), F.lit("0")) == ""


def last_writes(touched: DataFrame) -> DataFrame:
    """The write that each block shows in the end, of writes that cover whole blocks: ``device, block_no, seq``."""
    return touched.where("op = 'W' and complete").groupBy("device", "block_no").agg(F.max("seq").alias("seq"))


def write_fold_bytes(touched: DataFrame, cell: int = 64) -> DataFrame:
    """How many bytes of each block every write shows in the end, whatever their overlap: ``device, block_no, seq, bytes``.

    The last writer of a byte is a maximum, so writes fold apart: whole cells of a block are one row each, and the bytes
    around them, less than two cells a write, one row each. Writes that show nothing have no row.
    """
    key = ["device", "block_no"]
    rows = touched.where("op = 'W' and part_len > 0").selectExpr(*key, "seq", "cast(rel_offset as long) as a", "cast(rel_offset + part_len as long) as z")
    rows = rows.withColumns({"c0": F.expr(f"(a + {cell - 1}) div {cell}"), "c1": F.expr(f"z div {cell}")})
    whole = rows.where("c1 > c0").select(*key, "seq", F.explode(F.expr("sequence(c0, c1 - 1)")).alias("cell")).groupBy(*key, "cell").agg(F.max("seq").alias("top"))
    edges = F.expr(f"if(c1 <= c0, sequence(a, z - 1), if(a < c0 * {cell}, sequence(a, c0 * {cell} - 1), cast(array() as array<bigint>)))")
    tails = F.expr(f"if(c1 > c0 and z > c1 * {cell}, sequence(c1 * {cell}, z - 1), cast(array() as array<bigint>))")
    bytes_ = rows.select(*key, "seq", F.explode(F.concat(edges, tails)).alias("byte")).groupBy(*key, "byte").agg(F.max("seq").alias("seq"))
    bytes_ = bytes_.withColumn("cell", F.expr(f"byte div {cell}"))
    # A cell's bytes are its own but for those that a later write took one by one.
    taken = bytes_.join(whole, [*key, "cell"], "left").where("top is null or seq > top")
    one = taken.groupBy(*key, "seq").agg(F.count("*").alias("n"))
    lost = taken.where("top is not null").groupBy(*key, "cell").agg(F.count("*").alias("lost"))
    left = whole.join(lost, [*key, "cell"], "left").select(*key, F.col("top").alias("seq"), (cell - F.coalesce("lost", F.lit(0))).alias("n"))
    return one.union(left).groupBy(*key, "seq").agg(F.sum("n").alias("bytes")).where("bytes > 0")


def write_extent(touched: DataFrame) -> DataFrame:
    """Union of the byte ranges written to each block: how many bytes are covered, by an ordered scan of interval ends.

    Exact for any overlap and free of per-block lists: bytes covered up to each write are those beyond the furthest end so far.
    """
    w = Window.partitionBy("device", "block_no").orderBy("rel_offset", "seq").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("rel_offset") + F.col("part_len")
    before = F.coalesce(F.max(end).over(w), F.lit(0))
    rows = touched.where("op = 'W'").withColumn("fresh", F.greatest(F.lit(0), end - F.greatest(before, F.col("rel_offset"))))
    return rows.groupBy("device", "block_no").agg(F.sum("fresh").alias("bytes"))


def shard(blocks: DataFrame, per_shard: int) -> DataFrame:
    """Contiguous range shards of ``per_shard`` blocks."""
    return blocks.withColumn("shard", F.expr(f"block_no div {per_shard}"))


def mirrors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks on which two replicas disagree, or that one lacks: ``block_no, state``."""
    both = a.select("block_no", F.col("data").alias("a")).join(b.select("block_no", F.col("data").alias("b")), "block_no", "full_outer")
    state = F.when(F.col("a").isNull(), "only b").when(F.col("b").isNull(), "only a").otherwise("corrupt")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("block_no", state.alias("state"))
