"""Sets of block numbers as rows, and packed as bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 32768  # of a packed bitmap


def block_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(start, max(start, end)).withColumnRenamed("id", "block_no")


def set_bits(blocks: DataFrame, start: int, end: int) -> DataFrame:
    return blocks.union(block_range(blocks.sparkSession, start, end)).distinct()


def clear_bits(blocks: DataFrame, start: int, end: int) -> DataFrame:
    return blocks.where(~((F.col("block_no") >= start) & (F.col("block_no") < end)))


def set_bits_if(a: DataFrame, b: DataFrame, start: int, end: int) -> DataFrame:
    """``a`` and what ``b`` has in the range."""
    return a.union(within(b, start, end)).distinct()


def clear_bits_if(a: DataFrame, b: DataFrame, start: int, end: int) -> DataFrame:
    """``a`` without what ``b`` has in the range."""
    return a.join(within(b, start, end), "block_no", "left_anti")


def within(blocks: DataFrame, start: int, end: int) -> DataFrame:
    return blocks.where((F.col("block_no") >= start) & (F.col("block_no") < end))


def all_set(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """``all_set``: true if every block of the range is there; true for an empty range."""
    return within(blocks, start, end).agg((F.count_distinct("block_no") == max(0, end - start)).alias("all_set"))


def set_if_clear(blocks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union, and ``block_no, was_set`` for each wanted block."""
    was = wanted.join(blocks.withColumn("_set", F.lit(True)), "block_no", "left").select("block_no", F.coalesce("_set", F.lit(False)).alias("was_set"))
    return blocks.union(wanted).distinct(), was


def zeroes(blocks: DataFrame, size: int) -> DataFrame:
    """The complement within ``[0, size)``."""
    return block_range(blocks.sparkSession, 0, size).join(blocks, "block_no", "left_anti")


def zero_extent(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """``first, stop`` around all clear blocks of the range; ``(start, start)`` if none is clear."""
    clear = block_range(blocks.sparkSession, start, end).join(blocks, "block_no", "left_anti")
    return clear.agg(F.coalesce(F.min("block_no"), F.lit(start)).cast("long").alias("first"), F.coalesce(F.max("block_no") + 1, F.lit(start)).cast("long").alias("stop"))


def zero_extents(blocks: DataFrame, keys: DataFrame, start: int, end: int, *groups: str) -> DataFrame:
    """``zero_extent`` of each group of ``keys``, those without any set block included."""
    keys = keys.select(*groups).distinct()
    places = F.sequence(F.lit(start), F.lit(end - 1)) if end > start else F.array().cast("array<int>")
    clear = keys.withColumn("block_no", F.explode(places.cast("array<long>"))).join(blocks, [*groups, "block_no"], "left_anti")
    found = clear.groupBy(*groups).agg(F.min("block_no").alias("first"), (F.max("block_no") + 1).alias("stop"))
    return keys.join(found, [*groups], "left").select(*groups, *(F.coalesce(c, F.lit(start)).cast("long").alias(c) for c in ("first", "stop")))


def keep_where(blocks: DataFrame, predicate) -> DataFrame:
    """Visit set blocks and clear those for which ``predicate(column)`` is false."""
    return blocks.where(predicate(F.col("block_no")))


def first_and_rest(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lowest block, and the set without it; both empty for an empty set."""
    low = blocks.agg(F.min("block_no").alias("block_no")).where("block_no is not null")
    return low, blocks.join(low, "block_no", "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric difference; empty if the sets are equal."""
    marks = a.select("block_no", F.lit(1).alias("m")).union(b.select("block_no", F.lit(2).alias("m")))
    return marks.groupBy("block_no").agg(F.bit_or("m").alias("m")).where("m <> 3").select("block_no")


def keep_only(ids: DataFrame, keep: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Retained and removed rows."""
    return ids.join(keep, key, "left_semi"), ids.join(keep, key, "left_anti")


def runs(blocks: DataFrame, *groups: str) -> DataFrame:
    """Maximal runs of consecutive blocks: ``groups..., low, high``."""
    w = Window.partitionBy(*groups).orderBy("block_no")
    rows = blocks.withColumn("_run", F.col("block_no") - F.row_number().over(w))
    return rows.groupBy(*groups, "_run").agg(F.min("block_no").alias("low"), F.max("block_no").alias("high")).drop("_run")


def short_text(blocks: DataFrame, *groups: str) -> DataFrame:
    """Runs as text, like ``7 100-102 905``, one text a group."""
    part = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    listed = runs(blocks, *groups).groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("low", part.alias("part")))).alias("_parts"))
    return listed.select(*groups, F.concat_ws(" ", F.transform("_parts", lambda x: x["part"])).alias("text"))


def load_short_text(texts: DataFrame, column: str = "text") -> DataFrame:
    """``block_no`` of run texts; ``b-a`` with b >= a is malformed and raises; an empty text is an empty set."""
    part = texts.select(F.explode(F.filter(F.split(F.trim(column), " "), lambda x: x != "")).alias("part"))
    low, high = F.split_part("part", F.lit("-"), F.lit(1)).cast("long"), F.when(F.contains("part", F.lit("-")), F.split_part("part", F.lit("-"), F.lit(2)).cast("long"))
    checked = F.when(high.isNotNull() & (high <= low), F.raise_error(F.lit("malformed data")).cast("long")).otherwise(F.coalesce(high, low))
    return part.select(F.explode(F.sequence(low, checked)).alias("block_no"))


def pack(blocks: DataFrame, *groups: str) -> DataFrame:
    """Bitmaps of BITS blocks: ``groups..., bucket, bits``. Numbers are packed one up, as buckets count from one."""
    one = F.col("block_no") + 1
    return blocks.groupBy(*groups, F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))


def packed_or(*sets: DataFrame) -> DataFrame:
    """Union of packed sets."""
    rows = sets[0].select("bucket", "bits")
    for s in sets[1:]:
        rows = rows.union(s.select("bucket", "bits"))
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def packed_count(packed: DataFrame) -> DataFrame:
    return packed.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
