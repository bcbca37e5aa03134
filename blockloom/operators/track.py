"""Dirty tracking: a per-block automaton, folded in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.blocks import touches
from blockloom.operators.metrics import prefix_sum

#: States: 0 untracked, 1 tracked, 2 dirty. What each operation makes of them; a sync emits what it finds dirty.
MOVES = {"R": (1, 1, 2), "TRACK": (1, 1, 2), "W": (0, 2, 2), "SYNC": (0, 1, 0)}
SEGMENT = 4096  # sequence numbers folded at a time


def with_epochs(ops: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Adds ``epoch``: how many syncs of its device came up to each operation."""
    marked = ops.withColumn("_sync", F.when(F.col("op") == "SYNC", 1).otherwise(0))
    return prefix_sum(marked, ["device"], "seq", ["seq"], "_sync", width).withColumnRenamed("running", "epoch").drop("_sync")


def dirty_fold(ops: DataFrame, size: int, block: int, segment: int = SEGMENT) -> DataFrame:
    """``device, block_no, tracked, dirty, n_emitted, last_write`` of each touched block after a log of operations.

    Reading or tracking a block tracks it, a write to a tracked block makes it dirty, a sync emits the dirty blocks and stops
    tracking them; writes before tracking are not seen. Syncs are not spread to blocks: between two operations of a
    block any number of syncs does what one does, so a block only compares the operations' epochs.

    The outcome depends on the order of operations, but operations are maps of three states and maps compose: each
    segment of a block's log is folded into one map (with the emissions and the last seen write for each state it may
    start in), and the segments' maps into the block's outcome. No block needs its whole log in one row.
    """
    timed = with_epochs(ops)
    totals = timed.groupBy("device").agg(F.max("epoch").alias("total"))
    rows = touches(timed.where("op <> 'SYNC'"), size, block).select("device", "block_no", "seq", "op", "ts", "epoch", F.expr(f"seq div {segment}").alias("part"))
    lists = rows.groupBy("device", "block_no", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "ts", "epoch"))).alias("ops"))
    emits = "if({now} > a.e and a.s = 2, 1, 0)"
    state = "if({now} > a.e and a.s = 2, 0, a.s)"
    inner, outer = state.format(now="x.epoch"), state.format(now="x.first")
    move = "case x.op " + " ".join(f"when '{op}' then element_at(array({', '.join(map(str, MOVES[op]))}), {inner} + 1)" for op in ("R", "TRACK", "W")) + f" else {inner} end"
    fold = (
        "aggregate(ops, named_struct('s', {start}, 'n', 0L, 'w', cast(null as timestamp_ntz), 'e', ops[0].epoch), (a, x) -> named_struct("
        f"'s', {move}, 'n', a.n + {emits.format(now='x.epoch')}, 'w', if(x.op = 'W' and {inner} > 0, x.ts, a.w), 'e', x.epoch))"
    )
    ends = [F.expr("ops[0].epoch").alias("first"), F.expr("element_at(ops, -1).epoch").alias("last")]
    maps = lists.select("device", "block_no", "part", *ends, F.array(*(F.expr(fold.format(start=s)) for s in range(3))).alias("m"))
    chain = maps.groupBy("device", "block_no").agg(F.array_sort(F.collect_list(F.struct("part", "first", "last", "m"))).alias("c"))
    took = f"element_at(x.m, {outer} + 1)"
    end = F.expr(
        "aggregate(c, named_struct('s', 0, 'n', 0L, 'w', cast(null as timestamp_ntz), 'e', 0L), (a, x) -> named_struct("
        f"'s', {took}.s, 'n', a.n + {emits.format(now='x.first')} + {took}.n, 'w', coalesce({took}.w, a.w), 'e', x.last))"
    )
    got = chain.withColumn("e", end).join(totals, "device")
    last = (F.col("total") > F.col("e.e")) & (F.col("e.s") == 2)
    now = F.when(last, 0).otherwise(F.col("e.s"))
    return got.select("device", "block_no", (now >= 1).alias("tracked"), (now == 2).alias("dirty"), (F.col("e.n") + F.when(last, 1).otherwise(0)).alias("n_emitted"), F.col("e.w").alias("last_write"))


def spread_syncs(touched: DataFrame, ops: DataFrame) -> DataFrame:
    """For streams, whose state is kept by block: ``touched`` without its SYNC rows and with one for each block that the log
    touches and each sync of its device."""
    seen = touched.where("op <> 'SYNC'").select("device", "block_no").distinct()
    syncs = ops.where("op = 'SYNC'").select("device", "seq", "op", "ts").join(seen, "device")
    return touched.where("op <> 'SYNC'").select("device", "block_no", "seq", "op", "ts").union(syncs.select("device", "block_no", "seq", "op", "ts"))


def dirty_metrics(state: DataFrame, as_of) -> DataFrame:
    """``device, n_tracked, n_dirty, max_age`` (seconds since the oldest last write of a dirty block, 0 if none)."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) if not hasattr(as_of, "_jc") else as_of
    oldest = F.min(F.when(F.col("dirty"), F.unix_micros(F.col("last_write").cast("timestamp"))))
    return state.groupBy("device").agg(F.count_if("tracked").alias("n_tracked"), F.count_if("dirty").alias("n_dirty"), F.coalesce(F.expr("0L") + F.floor((F.max(age) - oldest) / 1000000), F.lit(0)).cast("long").alias("max_age"))


def dirty_groups(state: DataFrame, as_of_micros, max_age_s: int, limit: int, shift: int, min_changed: int) -> DataFrame:
    """The next groups of ``1 << shift`` blocks to send: those with a block dirty for longer than max_age first, then those with
    most dirty blocks, at least min_changed; ``limit`` in all. Ties go by group."""
    age = (as_of_micros - F.unix_micros(F.col("last_write").cast("timestamp"))) / 1000000
    groups = state.where("dirty").groupBy("device", F.shiftright("block_no", shift).alias("grp")).agg(F.count("*").alias("n_dirty"), F.max((age > max_age_s).cast("int")).alias("expired"))
    return groups.where((F.col("expired") == 1) | (F.col("n_dirty") >= min_changed)).orderBy(F.desc("expired"), F.desc("n_dirty"), "device", "grp").limit(limit)
