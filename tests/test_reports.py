import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import metrics as M
from blockloom.operators import overlay as O


def spaced(rows, gap):
    kept = set()
    for key in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == key)
        last = None
        for t, seq in own:
            if last is None or t - last >= gap:
                last = t
                kept.add((key, seq))
        kept.add((key, own[-1][1]))
    return kept


def test_reports_are_spaced_from_the_last_sent(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.randint(0, 60) * 1000, k) for k in range(200)]
    reports = spark.createDataFrame(rows, "device string, t long, seq long")
    got = [(r.device, r.seq) for r in M.rate_limited(reports, ["device"], F.col("t"), 7, "seq").collect()]
    assert len(got) == len(set(got)) and set(got) == spaced(rows, 7000)
    # Two milliseconds apart on both sides of a round time: the second one isn't sent, as a third follows it.
    close = spark.createDataFrame([("a", 6000, 0), ("a", 8000, 1), ("a", 9000, 2)], "device string, t long, seq long")
    assert [r.seq for r in M.rate_limited(close, ["device"], F.col("t"), 7, "seq").orderBy("seq").collect()] == [0, 2]
    assert M.rate_limited(reports.limit(0), ["device"], F.col("t"), 7, "seq").count() == 0


def test_running_average_counts_the_window(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(-4, 5)]), rng.choice([-1, 0, 1, 999_999]), rng.choice([None, 1, 2, 7]), k) for k in range(300)]
    rows = [(d, None if s is None else s * 1_000_000 + u, v, k) for d, s, u, v, k in rows]
    samples = spark.createDataFrame(rows, "device string, t long, v long, seq long")
    got = {r.seq: (r.n_in, r.sum_in) for r in M.running_average(samples, ["device"], F.col("t"), 2, "v").collect()}
    for d, t, _, k in rows:
        near = [v for dev, at, v, _ in rows if dev == d and (at is None if t is None else at is not None and t - 2_000_000 < at <= t)]
        assert got[k] == (len(near), sum(v for v in near if v is not None) if any(v is not None for v in near) else None)
    assert M.running_average(samples.limit(0), ["device"], F.col("t"), 2, "v").count() == 0


def test_running_average_adds_no_sample_up_again(spark):
    """40,000 samples in one window: 800 million additions if each window were added up anew."""
    from time import monotonic

    samples = spark.range(40_000, numPartitions=1).selectExpr("0 as device", "id as t", "1 as v")
    M.running_average(samples.limit(10), ["device"], F.col("t"), 1, "v").collect()
    plan = M.running_average(samples, ["device"], F.col("t"), 1, "v")
    began = monotonic()
    assert tuple(plan.agg(F.max("n_in"), F.sum("sum_in")).first()) == (40_000, 800_020_000)
    assert monotonic() - began < 8
    assert "RangeFrame, -" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("other", [[(0, b"abcd")], [(0, b"abcd"), (1, b"abc")], [(0, b"abcd"), (1, b"abcd"), (2, b"abcd")]])
def test_devices_of_other_sizes_have_no_difference(spark, other):
    one = spark.createDataFrame([(0, b"abcd"), (1, b"abcd")], "block_no long, data binary")
    with pytest.raises(Exception, match="devices differ in size"):
        O.count_differences(one, spark.createDataFrame(other, one.schema)).collect()


def test_bytes_of_large_blocks_are_counted(spark):
    data = bytes(65536)
    one, two = (spark.createDataFrame([(0, x), (1, data)], "block_no long, data binary") for x in (data, bytes([1, 0]) * 32768))
    assert tuple(O.count_differences(one, two).first()) == (1, 32768)
    assert tuple(O.count_differences(one, one).first()) == (0, 0)
