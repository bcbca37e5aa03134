"""Writers of different priority on one device, and buffered writes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def combine_flags(writes: DataFrame) -> DataFrame:
    """Adds ``existing, allowed, duplicate`` to ``block_no, seq, priority``.

    A write passes unless a higher priority wrote the block before; an equal one is a duplicate too.
    """
    before = Window.partitionBy("block_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = writes.withColumn("existing", F.coalesce(F.max("priority").over(before), F.lit(-1)))
    return rows.withColumn("allowed", F.col("priority") >= F.col("existing")).withColumn("duplicate", F.col("priority") == F.col("existing"))


def combine_metrics(flags: DataFrame) -> DataFrame:
    """Block writes allowed, blocked and duplicate of each priority."""
    return flags.groupBy("priority").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_blocked"), F.count_if("duplicate").alias("n_duplicate"))


def combine_final(writes: DataFrame) -> DataFrame:
    """The write that each block shows: the last of the highest priority. Pre-aggregated, unlike the flags."""
    return writes.groupBy("block_no").agg(F.max(F.struct("priority", "seq")).alias("w")).select("block_no", F.col("w.priority").alias("priority"), F.col("w.seq").alias("seq"))


def flush_order(buffered: DataFrame, target: int) -> DataFrame:
    """Blocks that a flush to below ``target`` buffered bytes takes, largest first: ``device, block_no, bytes, left``.

    ``left`` is what stays buffered on the device after the block. At least one block goes. Ties go by block number.
    """
    order = Window.partitionBy("device").orderBy(F.desc("bytes"), "block_no")
    everything = F.sum("bytes").over(Window.partitionBy("device"))
    rows = buffered.withColumn("left", everything - F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.row_number().over(order))
    return rows.where((F.col("left") + F.col("bytes") >= target) | (F.col("_n") == 1)).select("device", "block_no", "bytes", "left")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's writes, last first: those inside an interval seen before. Seen intervals are kept as a staircase,
    starts and ends both rising, so it is never longer than a block has bytes."""
    now, starts, ends = None, [], []
    for batch in batches:
        out = []
        for device, block_no, seq, a, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if (device, block_no) != now:
                now, starts, ends = (device, block_no), [], []
            b = a + n
            k = bisect_right(starts, a)
            if k and ends[k - 1] >= b:
                out.append((device, block_no, seq))
                continue
            k = stop = bisect_left(starts, a)
            while stop < len(ends) and ends[stop] <= b:
                stop += 1
            starts[k:stop], ends[k:stop] = [a], [b]
        columns = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["device", "block_no", "seq"])


def discarded_writes(touched: DataFrame) -> DataFrame:
    """Buffered writes that a later write to the block covers wholly: ``device, block_no, seq``.

    Each block's writes stream by from the last to the first, with state bounded by the block's size; no pairs are formed.
    """
    columns = [F.col(c).cast("long") for c in ("device", "block_no", "seq", "rel_offset", "part_len")]
    rows = touched.where("op = 'W'").select(*columns).repartition("device", "block_no").sortWithinPartitions("device", "block_no", F.desc("seq"))
    return rows.mapInArrow(_covered, "device long, block_no long, seq long")
