"""Streams of operations: dirty tracking, volatility and continuous synchronisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockloom.operators.sync import upsert_status
from blockloom.operators.track import MOVES

DIRTY = "device long, block_no long, emitted_seq long"


def _track(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, op in zip(rows["seq"], rows["op"]):
        if op == "SYNC" and now == 2:
            out.append((key[0], key[1], int(seq)))
        now = MOVES[op][now] if op in MOVES else now
    if now:
        state.update((now,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["device", "block_no", "emitted_seq"])


def track_dirty(touched: DataFrame) -> DataFrame:
    """Blocks that each sync emits, from a stream of ``device, block_no, seq, op`` with syncs spread to blocks.

    State is one number for each tracked block; an untracked block has none. Within a trigger operations go by seq; across
    triggers by arrival.
    """
    rows = touched.select("device", "block_no", "seq", "op")
    return rows.groupBy("device", "block_no").applyInPandasWithState(_track, DIRTY, "s int", "append", GroupStateTimeout.NoTimeout)


def sliding_volatility(touched: DataFrame, expiry: str, slide: str, lateness: str) -> DataFrame:
    """Writes to each block in sliding windows of event time; rows later than ``lateness`` are dropped."""
    writes = touched.where("op = 'W'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return writes.groupBy("device", "block_no", F.window("ts", expiry, slide)).agg(F.count("*").alias("n"))


def synchronise(dirty: DataFrame, path: str, hashes: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Keep a table of block status in step with a stream of dirty blocks; returns a writer to be started.

    Each trigger is an update with its number: ``hashes`` copies the blocks and gives ``device, block_no, hash, ok``. A new version of
    the table is written beside the old one, so a repeated trigger writes the same version again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = hashes(batch.select("device", "block_no").distinct()).withColumn("id", F.lit(number + 1).cast("long"))
        if number:
            old = spark.read.parquet(f"{path}/v{number - 1}")
        else:
            old = spark.createDataFrame([], "device long, block_no long, is_set boolean, updating_id long, current_id long, current_hash string")
        upsert_status(old, arrived).write.mode("overwrite").parquet(f"{path}/v{number}")

    return dirty.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
