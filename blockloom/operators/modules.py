"""Steps of a device chain on its operation log, and on the maps and devices around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.blocks import is_zero


def gate(ops: DataFrame, locks: DataFrame, reads_too: bool = False) -> DataFrame:
    """Operations with ``passed_at``: while the device is locked a write (or, with ``reads_too``, a read) waits for the unlock.

    ``locks(device, seq, locked)`` are lock and unlock events on the operations' scale. Null: never unlocked.
    """
    rows = ops.select("device", "seq", "op", F.lit(None).cast("boolean").alias("locked")).union(locks.select("device", "seq", F.lit(None).cast("string").alias("op"), "locked"))
    back = Window.partitionBy("device").orderBy("seq", F.col("op").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, so that the frame grows from its start: a frame that shrinks is computed anew for each row.
    ahead = Window.partitionBy("device").orderBy(F.desc("seq"), F.col("op").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("held", F.coalesce(F.last("locked", ignorenulls=True).over(back), F.lit(False)))
    rows = rows.withColumn("free", F.min(F.when(~F.col("locked"), F.col("seq"))).over(ahead)).where("op is not null")
    waits = F.col("held") & (F.lit(True) if reads_too else F.col("op") == "W")
    return rows.select("device", "seq", "op", F.when(waits, F.col("free")).otherwise(F.col("seq")).alias("passed_at"))


def artificial_latency(ops: DataFrame, read: int, read_byte: int, write: int, write_byte: int) -> DataFrame:
    """Adds ``delay``: a fixed part and one for each byte, for reads and for writes."""
    delay = F.when(F.col("op") == "R", read + read_byte * F.col("length")).when(F.col("op") == "W", write + write_byte * F.col("length")).otherwise(0)
    return ops.withColumn("delay", delay)


def hooked(rows: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows through user steps in order, before or after any operator."""
    for step in steps:
        rows = rows.transform(step)
    return rows


def observed(ops: DataFrame, name: str) -> DataFrame:
    """The same rows; counts and bytes of each kind reach the driver's observation ``name`` as they pass."""
    marks = [F.count_if(F.col("op") == k).alias(f"n_{k.lower()}") for k in ("R", "W", "SYNC")]
    return ops.observe(name, *marks, F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def available_parts(touched: DataFrame, size: int, block: int, remote: bool) -> DataFrame:
    """Blocks that a write makes available: those it covers whole; from the remote side also a short last block it fills to the end."""
    whole = (F.col("rel_offset") == 0) & (F.col("part_len") == block)
    tail = (F.col("rel_offset") == 0) & (F.col("block_no") * block + F.col("part_len") == size)
    return touched.where((F.col("op") == "W") & ((whole | tail) if remote else whole)).select("device", "block_no", "seq")


def track_rows(blocks: DataFrame, block: int, seq: int) -> DataFrame:
    """Blocks as tracking requests of a log, to be tracked from ``seq`` on."""
    return blocks.select("device", F.lit(seq).cast("long").alias("seq"), F.lit("TRACK").alias("op"), (F.col("block_no") * block).alias("offset"), F.lit(block).alias("length"))


def read_ids(ids: DataFrame, mapped: DataFrame, slots: DataFrame) -> DataFrame:
    """Bytes of mapped ids: ``id, slot, data, found``; all are wanted, so one that isn't found is a row to fail on."""
    got = ids.join(mapped, "id", "left").join(slots.select(F.col("block_no").alias("slot"), "data"), "slot", "left")
    return got.select("id", "slot", "data", F.col("slot").isNotNull().alias("found"))


def merge_map(mapped: DataFrame, added: DataFrame) -> DataFrame:
    """A slot map with another laid over it."""
    return mapped.join(added, "id", "left_anti").select("id", "slot").union(added.select("id", "slot"))


def map_for_range(mapped: DataFrame, offset: int, length: int, block: int) -> DataFrame:
    """Entries whose slots lie in a byte range of the provider."""
    return mapped.where((F.col("slot") * block < offset + length) & ((F.col("slot") + 1) * block > offset))


def find_path(maps: DataFrame, pathname: str) -> DataFrame:
    return maps.where(F.col("pathname") == pathname)


def find_range(maps: DataFrame, start: int, end: int) -> DataFrame:
    return maps.where((F.col("addr_start") == start) & (F.col("addr_end") == end))


def find_page(maps: DataFrame, address: int, page: int = 4096) -> DataFrame:
    """Entries that hold a whole page from an address on."""
    return maps.where((F.col("addr_start") <= address) & (F.col("addr_end") >= address + page))


def dirty_by_frame(pages: DataFrame, frames: DataFrame) -> DataFrame:
    """Present pages whose physical frame has the kernel's dirty flag (bit 4): ``pages`` with flags, ``frames(pfn, kflags)``."""
    return pages.where("present").join(frames.where(F.getbit("kflags", F.lit(4)) == 1), "pfn")


def fill_zeroes(blocks: DataFrame, numbers: DataFrame, size: int, block: int) -> DataFrame:
    """Blocks of a store in which a missing one reads as zeroes."""
    length = F.least(F.lit(block), F.lit(size) - F.col("block_no") * block).cast("int")
    zero = F.unhex(F.repeat(F.lit("00"), length))
    return numbers.join(blocks, "block_no", "left").withColumn("data", F.coalesce("data", zero))


def device_log(blocks: DataFrame, block: int) -> DataFrame:
    """A device as the writes that build it on zeroes: one for each block that isn't all zero."""
    rows = blocks.where(~is_zero(F.col("data")))
    return rows.select("device", F.col("block_no").alias("seq"), F.lit("W").alias("op"), (F.col("block_no") * block).alias("offset"), F.octet_length("data").alias("length"), "data")


def timed(ops: DataFrame) -> DataFrame:
    """Adds ``dt_ns``: nanoseconds since the device's first operation."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = ops.groupBy("device").agg(F.min(micros).alias("_first"))
    return ops.join(first, "device").withColumn("dt_ns", (micros - F.col("_first")) * 1000).drop("_first")


def to_samples(table: DataFrame, ids: list[str], subsystem: str) -> DataFrame:
    """Columns of a metrics table as rows ``ids..., subsystem, metric, value``."""
    values = [c for c in table.columns if c not in ids]
    return table.select(*ids, *(F.col(c).cast("long").alias(c) for c in values)).unpivot(ids, values, "metric", "value").withColumn("subsystem", F.lit(subsystem))


def instant(samples: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """The last value of each series."""
    return samples.groupBy(*series).agg(F.max_by("value", F.struct(*order)).alias("value"))
