"""Metrics of operations: totals, histograms, concurrency, rates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed bucket bounds of operation sizes, in bytes: powers of two from 4 KiB to 1 MiB.
SIZE_BUCKETS = tuple(4096 << k for k in range(9))


def op_metrics(ops: DataFrame) -> DataFrame:
    """Operations, bytes, errors and time by device and kind; time of reads and writes counts when they succeed, of syncs always."""
    timed = F.when(F.col("ok") | (F.col("op") == "SYNC"), F.col("micros")).otherwise(0)
    return ops.groupBy("device", "op").agg(F.count("*").alias("n_ops"), F.sum("length").alias("n_bytes"), F.count_if(~F.col("ok")).alias("n_errors"), F.sum(timed).alias("micros"))


def average_latency(metrics: DataFrame) -> DataFrame:
    """Mean microseconds of an operation without error, 0 if there is none."""
    good = F.col("n_ops") - F.col("n_errors")
    return metrics.withColumn("mean_micros", F.when(good > 0, F.expr("micros div (n_ops - n_errors)")).otherwise(0))


def size_histogram(ops: DataFrame) -> DataFrame:
    """Operations by the least bucket bound that holds their size, not cumulative, empty buckets included; larger ones count nowhere."""
    le = F.element_at(F.filter(F.array(*(F.lit(b) for b in SIZE_BUCKETS)), lambda b: F.col("length") <= b), 1)
    fits = ops.where(F.col("length") <= SIZE_BUCKETS[-1])
    counts = fits.groupBy("device", "op", le.alias("le")).agg(F.count("*").alias("n"))
    frame = ops.select("device", "op").distinct().withColumn("le", F.explode(F.array(*(F.lit(b) for b in SIZE_BUCKETS))))
    return frame.join(counts, ["device", "op", "le"], "left").select("device", "op", "le", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_sum(rows: DataFrame, keys: list[str], at: str, order: list[str], value: str, width: int) -> DataFrame:
    """Adds ``running``: the sum of ``value`` up to each row in ``order``, which starts with ``at``.

    Stretches of ``width`` along ``at`` are summed first and their sums scanned, then each stretch is scanned on its own: the
    rows of a key are spread over tasks, however many it has.
    """
    rows = rows.withColumn("_part", F.expr(f"{at} div {width}"))
    sums = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(value).over(within)).join(sums, [*keys, "_part"])
    return rows.withColumn("running", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def concurrency(ops: DataFrame, width: int = 1 << 20) -> DataFrame:
    """``device, n_started, in_flight_sum``: at each start, operations in flight with itself, summed. From ``device, seq, start, stop``."""
    events = ops.select("device", F.col("start").alias("t"), F.lit(1).alias("d"), "seq").union(ops.select("device", F.col("stop").alias("t"), F.lit(-1).alias("d"), "seq"))
    flying = prefix_sum(events, ["device"], "t", ["t", "d", "seq"], "d", width).where("d = 1")
    return flying.groupBy("device").agg(F.count("*").alias("n_started"), F.sum("running").alias("in_flight_sum"))


def changed_only(samples: DataFrame, series: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Samples that differ from the one before them in their series; the first counts from zero."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*series).orderBy(*order)), F.lit(0))
    return samples.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def increase(samples: DataFrame, series: list[str], order: list[str], by: list[str], value: str = "value") -> DataFrame:
    """Growth of counters by ``series`` and ``by``; after a fall a counter has restarted, and counts from zero."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(*order))
    step = F.when(before.isNull(), 0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return samples.withColumn("_step", step).groupBy(*dict.fromkeys([*series, *by])).agg(F.sum("_step").alias("increase"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio of two increases as whole parts, null without a denominator."""
    return F.when(denominator > 0, F.floor(numerator / denominator).cast("long"))


def running_average(samples: DataFrame, series: list[str], micros: Column, window_s: int, value: str) -> DataFrame:
    """Mean over the last ``window_s`` seconds, strictly younger only; the sample itself always counts. Adds ``n_in`` and ``sum_in``.

    Time is cut into stretches as long as the window. A window is then the start of its own stretch and the end of the one
    before, which comes along a window later: both are running totals, so no sample is added up again for each window that
    it is in, and nothing is subtracted. Samples without a time are in one window.
    """
    long = window_s * 1000000
    twice = F.explode(F.array(F.struct(F.lit(0).alias("late"), F.lit(True).alias("own")), F.struct(F.lit(long).alias("late"), F.lit(False).alias("own"))))
    rows = samples.withColumns({"_at": micros.cast("long"), "_value": F.col(value)}).withColumn("_as", twice).where("_as.own or _at is not null")
    rows = rows.withColumns({c: F.when(F.col("_as.own"), F.col(c)) for c in samples.columns if c not in series})
    rows = rows.withColumn("_at", F.col("_at") + F.col("_as.late")).withColumn("_part", F.expr(f"_at div {long} - if(_at % {long} < 0, 1, 0)"))
    own, earlier = F.col("_as.own"), ~F.col("_as.own")
    key = Window.partitionBy(*series, "_part")
    start = key.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    end = key.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    n = F.count_if(own).over(start) + F.count_if(earlier).over(end)
    one, two = F.sum(F.when(own, F.col("_value"))).over(start), F.sum(F.when(earlier, F.col("_value"))).over(end)
    summed = rows.withColumns({"n_in": n, "sum_in": F.coalesce(one + two, one, two)}).where(own)
    return summed.select(*samples.columns, "n_in", "sum_in")


def bandwidth(ops: DataFrame, micros: Column) -> DataFrame:
    """Bytes of the second before each operation, scaled to a full second from the span that was seen."""
    w = Window.partitionBy("device").orderBy(micros).rangeBetween(-1000000, 0)
    span = micros - F.min(micros).over(w)
    rows = ops.withColumn("bytes_1s", F.sum("length").over(w)).withColumn("span", span)
    return rows.withColumn("bytes_per_s", F.when(F.col("span") > 0, F.expr("bytes_1s * 1000000 div span")).otherwise(F.col("bytes_1s")))


def concurrency_shares(devices: DataFrame, max_concurrency: int) -> DataFrame:
    """Each device's share of concurrent requests: one, and of the rest a part in proportion to its size."""
    everything = Window.partitionBy()
    n = F.count("*").over(everything)
    rows = devices.withColumn("_spare", F.greatest(F.lit(max_concurrency), n) - n).withColumn("_total", F.sum("size").over(everything))
    return rows.withColumn("share", F.expr("1 + _spare * size div _total")).drop("_spare", "_total")


def rate_limited(reports: DataFrame, series: list[str], micros: Column, gap_ms: int, ties: str) -> DataFrame:
    """Progress reports at most every ``gap_ms``: those at least that long after the last one kept of their series, and each
    series' last, which is always sent. Equal times go by the column ``ties``.

    What is kept depends on what was kept before, so a series is read in order by one task; it streams and holds one time.
    """
    rows = reports.select(F.struct(*series).alias("_key"), micros.alias("_at"), "*")
    ends = rows.groupBy(F.col("_key").alias("_series")).agg(F.max(F.struct("_at", ties)).alias("_end"))
    rows = rows.join(ends, F.col("_key").eqNullSafe(F.col("_series"))).withColumn("_forced", F.struct("_at", ties) == F.col("_end"))
    names = reports.columns
    rows = rows.select("_key", "_at", "_forced", *names).repartition("_key").sortWithinPartitions("_key", "_at", ties)

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, due = None, 0
        for batch in batches:
            keep = []
            for key, at, forced in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sent = key != last or at >= due
                if sent:
                    last, due = key, at + gap_ms * 1000
                keep.append(sent or forced)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[3:], names=names)

    return rows.mapInArrow(spaced, reports.schema)
