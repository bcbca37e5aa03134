"""Migration and continuous synchronisation as tables of block state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_status(status: DataFrame, arrived: DataFrame) -> DataFrame:
    """``device, block_no, is_set, updating_id, current_id, current_hash`` after ``arrived(device, block_no, id, hash, ok)``.

    Every attempt moves ``updating_id`` up; a success sets id and hash if it is newer than what is there.
    """
    old = status.select("device", "block_no", F.col("updating_id").alias("u"), F.when(F.col("is_set"), F.struct(F.col("current_id").alias("id"), F.col("current_hash").alias("hash"))).alias("c"))
    new = arrived.select("device", "block_no", F.col("id").alias("u"), F.when(F.col("ok"), F.struct("id", "hash")).alias("c"))
    got = old.union(new).groupBy("device", "block_no").agg(F.max("u").alias("updating_id"), F.max("c").alias("c"))
    return got.select("device", "block_no", F.col("c").isNotNull().alias("is_set"), "updating_id", F.col("c.id").alias("current_id"), F.col("c.hash").alias("current_hash"))


def progress(blocks: DataFrame, migrated: DataFrame, dirty: DataFrame) -> DataFrame:
    """``device, total, n_migrated, n_ready, migrated_ppm``: ready is migrated and not dirty."""
    rows = blocks.join(migrated.select("device", "block_no").distinct().withColumn("m", F.lit(1)), ["device", "block_no"], "left").join(dirty.select("device", "block_no").distinct().withColumn("d", F.lit(1)), ["device", "block_no"], "left")
    done = F.coalesce(F.col("m"), F.lit(0))
    got = rows.groupBy("device").agg(F.count("*").alias("total"), F.sum(done).alias("n_migrated"), F.sum(done * F.when(F.col("d").isNull(), 1).otherwise(0)).alias("n_ready"))
    return got.withColumn("migrated_ppm", F.expr("n_migrated * 1000000 div total"))


def remaining(blocks: DataFrame, unrequired: DataFrame, present: DataFrame) -> DataFrame:
    """Blocks still to send: without those the other side can supply or has."""
    return blocks.join(unrequired, ["device", "block_no"], "left_anti").join(present, ["device", "block_no"], "left_anti")


def availability(blocks: DataFrame, arrived: DataFrame, dirtied: DataFrame) -> DataFrame:
    """``device, n_available, total``: blocks that arrived and were not dirtied at the source since."""
    last = arrived.groupBy("device", "block_no").agg(F.max("seq").alias("a")).join(dirtied.groupBy("device", "block_no").agg(F.max("seq").alias("d")), ["device", "block_no"], "left").where("d is null or a > d")
    rows = blocks.join(last.select("device", "block_no", F.lit(1).alias("ok")), ["device", "block_no"], "left")
    return rows.groupBy("device").agg(F.count("ok").alias("n_available"), F.count("*").alias("total"))


def needed(reads: DataFrame, arrivals: DataFrame) -> DataFrame:
    """First read of each block that came before its first arrival: one NEED a block, ``device, block_no, seq, waited_for``."""
    first = reads.groupBy("device", "block_no").agg(F.min("seq").alias("seq"))
    came = arrivals.groupBy("device", "block_no").agg(F.min("seq").alias("waited_for"))
    return first.join(came, ["device", "block_no"], "left").where("waited_for is null or seq < waited_for")


def merge_remote(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Incoming blocks, over which blocks written whole at home win."""
    mine = local.select("device", "block_no", F.col("data").alias("_mine"))
    return remote.join(mine, ["device", "block_no"], "left").select("device", "block_no", F.coalesce("_mine", "data").alias("data"), F.col("_mine").isNotNull().alias("kept_local"))
