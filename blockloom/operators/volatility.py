"""Write volatility of blocks and the orders it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def volatility(touched: DataFrame, blocks: DataFrame, as_of: Column, expiry_s: int) -> DataFrame:
    """``device, block_no, n``: writes that touched each block of ``blocks(device, block_no)`` from ``as_of - expiry`` on."""
    recent = touched.where((F.col("op") == "W") & (micros(F.col("ts")) >= as_of - expiry_s * 1000000))
    counts = recent.groupBy("device", "block_no").agg(F.count("*").alias("n"))
    return blocks.join(counts, ["device", "block_no"], "left").select("device", "block_no", F.coalesce("n", F.lit(0)).alias("n"))


def total_volatility(touched: DataFrame, as_of: Column, expiry_s: int) -> DataFrame:
    """The same over all touched blocks, available or not."""
    recent = touched.where((F.col("op") == "W") & (micros(F.col("ts")) >= as_of - expiry_s * 1000000))
    return recent.groupBy("device").agg(F.count("*").alias("total"))


def running_volatility(touched: DataFrame, expiry_s: int) -> DataFrame:
    """Each write's block count at its time, itself included."""
    w = Window.partitionBy("device", "block_no").orderBy(micros(F.col("ts"))).rangeBetween(-expiry_s * 1000000, 0)
    return touched.where("op = 'W'").withColumn("n", F.count("*").over(w))


def order_any(blocks: DataFrame) -> DataFrame:
    """Lowest block first: adds ``rank`` within each device."""
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy("device").orderBy("block_no")))


def order_priority(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested blocks first, by their earliest request; then the others by number. Adds ``kind`` and ``rank``."""
    first = requests.groupBy("device", "block_no").agg(F.min("seq").alias("asked"))
    rows = blocks.join(first, ["device", "block_no"], "left")
    order = Window.partitionBy("device").orderBy(F.col("asked").isNull(), "asked", "block_no")
    return rows.select("device", "block_no", F.when(F.col("asked").isNull(), "standard").otherwise("priority").alias("kind"), F.row_number().over(order).alias("rank"))


def order_volatility(counts: DataFrame) -> DataFrame:
    """Least volatile first: unwritten blocks upwards, then by count, of equal ones the highest number first."""
    order = Window.partitionBy("device").orderBy("n", F.when(F.col("n") == 0, F.col("block_no")).otherwise(-F.col("block_no")))
    return counts.withColumn("rank", F.row_number().over(order))


def heatmap(counts: DataFrame, n_blocks: int, parts: int = 64) -> DataFrame:
    """Sum of ``n`` in each of ``parts`` equal parts of every device, empty ones included."""
    part = F.expr(f"block_no * {parts} div {n_blocks}")
    frame = counts.select("device").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sums = counts.groupBy("device", part.cast("int").alias("part")).agg(F.sum("n").alias("n"))
    return frame.join(sums, ["device", "part"], "left").select("device", "part", F.coalesce("n", F.lit(0)).alias("n"))


def transfer_heatmap(marks: DataFrame, n_blocks: int, parts: int = 64) -> DataFrame:
    """How blocks came, from ``block_no, kind`` (p2p, alt or dup): counts of each part and one coded value.

    The value counts p2p blocks, unless there are others: alternates from four times ``n_blocks div parts`` on, or
    duplicates, which win, from twice that on. The separate counts tell them apart where a part has under one block.
    """
    part = F.expr(f"block_no * {parts} div {n_blocks}").cast("int")
    n = marks.groupBy(part.alias("part")).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("p2p", "alt", "dup")))
    step = n_blocks // parts
    value = F.when(F.col("n_dup") > 0, 2 * step + F.col("n_dup")).when(F.col("n_alt") > 0, 4 * step + F.col("n_alt")).otherwise(F.col("n_p2p"))
    return n.withColumn("value", value)
