"""Literal cases: small inputs with exact results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from blockloom.operators import blocks as B
from blockloom.operators import combine as C
from blockloom.operators import hashing as H
from blockloom.operators import overlay as O
from blockloom.operators import ranges as R
from blockloom.operators import sets as S
from blockloom.operators import track as T
from blockloom.operators import volatility as V

T0 = datetime(2024, 1, 1)
OPS = "device long, seq long, ts timestamp_ntz, op string, offset long, length int"


def numbers(df, column="block_no"):
    return sorted(r[0] for r in df.select(column).collect())


def bits(spark, values):
    return spark.createDataFrame([(v,) for v in values], "block_no long")


def ops(spark, rows, step_ms=1):
    return spark.createDataFrame([(0, k, T0 + timedelta(milliseconds=k * step_ms), *r) for k, r in enumerate(rows)], OPS)


def test_set_and_clear(spark):
    some = S.set_bits(bits(spark, []), 100, 180)
    assert numbers(some) == list(range(100, 180))
    full = S.block_range(spark, 0, 1000)
    assert numbers(S.zeroes(S.clear_bits(full, 100, 180), 1000)) == list(range(100, 180))
    assert [S.all_set(some, *r).first()[0] for r in ((100, 180), (100, 185), (0, 1000), (5, 5))] == [True, False, False, True]
    assert not S.all_set(S.clear_bits(some, 150, 151), 100, 180).first()[0]
    assert [S.within(some, *r).count() for r in ((0, 1000), (95, 105))] == [80, 5]
    assert S.packed_count(S.pack(bits(spark, [0, 32767, 32768, 70000]))).first()[0] == 4
    assert S.packed_count(S.packed_or(S.pack(bits(spark, [1, 2])), S.pack(bits(spark, [2, 3])))).first()[0] == 3


def test_conditional_sets_and_extents(spark):
    a, b = bits(spark, [99]), bits(spark, [99, 100])
    assert numbers(S.set_bits_if(a, b, 90, 105)) == [99, 100]
    assert numbers(S.clear_bits_if(b, a, 90, 105)) == [100]
    union, was = S.set_if_clear(a, b)
    assert numbers(union) == [99, 100] and {tuple(r) for r in was.collect()} == {(99, True), (100, False)}
    zero = [7, 100, 101, 102, 905, 907]
    rest = S.clear_bits(S.block_range(spark, 0, 1000), 0, 0).join(bits(spark, zero), "block_no", "left_anti")
    assert tuple(S.zero_extent(rest, 0, 1000).first()) == (7, 908)
    assert tuple(S.zero_extent(S.block_range(spark, 0, 10), 3, 9).first()) == (3, 3)
    low, others = S.first_and_rest(bits(spark, [5, 3, 9]))
    assert numbers(low) == [3] and numbers(others) == [5, 9] and S.first_and_rest(bits(spark, []))[0].count() == 0
    assert numbers(S.difference(a, b)) == [100] and S.difference(a, a).count() == 0
    assert numbers(S.keep_where(b, lambda c: c > 99)) == [100]


def test_short_text(spark):
    some = bits(spark, [7, 100, 101, 102, 905, 907])
    text = S.short_text(some)
    assert text.first()[0] == "7 100-102 905 907"
    assert S.difference(S.load_short_text(text), some).count() == 0
    with pytest.raises(Exception, match="malformed"):
        S.load_short_text(spark.createDataFrame([("9-3",)], "text string")).collect()
    assert S.load_short_text(spark.createDataFrame([("",)], "text string")).count() == 0


def dirty(spark, rows, size, block):
    return T.dirty_fold(ops(spark, rows), size, block, 2)


def test_dirty_tracker(spark):
    size = 32 << 20
    rows = [("R", 10, 1234567)] + [("W", o, 9000) for o in (10, 10000, 40000)] + [("SYNC", 0, 0)]
    got = dirty(spark, rows, size, 4096)
    assert numbers(got.where("n_emitted = 1")) == [0, 1, 2, 3, 4, 9, 10, 11]
    assert got.where("dirty or n_emitted > 1").count() == 0
    twice = dirty(spark, rows + [("SYNC", 0, 0)], size, 4096)
    assert twice.agg(F.sum("n_emitted")).first()[0] == 8
    unseen = dirty(spark, [("W", 0, 10), ("R", 0, 10), ("SYNC", 0, 0), ("W", 0, 10)], size, 4096)
    assert [tuple(r)[2:5] for r in unseen.collect()] == [(True, True, 0)]


def test_dirty_groups(spark):
    rows = [("TRACK", 0, 1 << 20)] + [("W", o, 9000) for o in (10, 30, 10000, 40000)]
    state = dirty(spark, rows, 1 << 20, 4096)
    now = F.unix_micros(F.lit(T0 + timedelta(milliseconds=4)))
    pick = lambda age, shift, least: numbers(T.dirty_groups(state, now, age, 100, shift, least), "grp")
    assert numbers(state.where("dirty")) == [0, 1, 2, 3, 4, 9, 10, 11]
    assert pick(0, 1, 0) == [0, 1, 2, 4, 5]
    assert pick(60, 1, 0) == [0, 1, 2, 4, 5]
    assert pick(60, 1, 2) == [0, 1, 5]
    assert pick(60, 2, 2) == [0, 2]
    assert pick(60, 1, 1000) == []


def test_volatility_and_order(spark):
    log = ops(spark, [("W", o, 8192) for o in (10, 7000, 7004, 190000)])
    touched = B.touches(log, 4096 * 4096, 4096)
    blocks = S.block_range(spark, 0, 60).withColumn("device", F.lit(0).cast("long"))
    late = F.unix_micros(F.lit(T0 + timedelta(seconds=5)))
    counts = V.volatility(touched, blocks, late, 60)
    assert {r.block_no: r.n for r in counts.where("n > 0").collect()} == {0: 1, 1: 3, 2: 3, 3: 2, 46: 1, 47: 1, 48: 1}
    assert V.total_volatility(touched, late, 60).first()["total"] == 12
    assert V.volatility(touched, blocks, late, 1).agg(F.sum("n")).first()[0] == 0
    ranked = [r.block_no for r in V.order_volatility(counts).orderBy("rank").collect()]
    assert ranked[0] == 4 and ranked[-7:] == [48, 47, 46, 0, 3, 2, 1]
    first = V.order_priority(blocks, spark.createDataFrame([(0, 57, 9), (0, 57, 1), (0, 3, 4)], "device long, block_no long, seq long"))
    assert [r.block_no for r in first.orderBy("rank").limit(4).collect()] == [57, 3, 0, 1]


def test_combinator(spark):
    writes = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 2), (1, 4, 1)], "block_no long, seq long, priority int")
    assert {r.block_no: r.priority for r in C.combine_final(writes).collect()} == {0: 2, 1: 2}
    assert {r.priority: (r.n_allowed, r.n_blocked, r.n_duplicate) for r in C.combine_metrics(C.combine_flags(writes)).collect()} == {1: (1, 1, 0), 2: (2, 0, 0)}


def device(spark, data, block):
    return spark.createDataFrame([(0, k // block, bytearray(data[k : k + block])) for k in range(0, len(data), block)], "device long, block_no long, data binary")


def test_compare_and_integrity(spark):
    data = bytearray(range(256)) * 16
    other = bytearray(data)
    for at in (7, 8, 900, 3000):
        other[at : at + 6] = bytes(255 - x for x in data[at : at + 6])
    a, b = device(spark, data, 1024), device(spark, other, 1024)
    assert tuple(O.count_differences(a, b).first()) == (2, sum(x != y for x, y in zip(data, other)))
    assert O.equals(a, a).first()[0] and not O.equals(a, b).first()[0]
    hashes = H.block_hashes(a)
    assert [tuple(r)[1:] for r in H.check(a, hashes).collect()] == [(0, True)]
    assert [tuple(r)[1:] for r in H.check(b, hashes.where("block_no > 0")).collect()] == [(1, False)]
    import hashlib

    assert H.device_hashes(a).first()["hash"] == hashlib.sha256(data).hexdigest()


def test_regions_and_defragmentation(spark):
    ids = [0x12345678 + 4096 * k for k in range(8)] + [0x20000000]
    got = R.regions(spark.createDataFrame([(i,) for i in ids], "id long"), 4096, 6 * 4096)
    assert {r.start: r.length for r in got.collect()} == {305419896: 24576, 305444472: 8192, 536870912: 4096}
    mapped = spark.createDataFrame([(0x12345678, 0)], "id long, slot long")
    new = R.allocate(mapped, spark.createDataFrame([(0x12345678,), (0x1234,), (0x5678,)], "id long"), 2)
    assert {r.id: r.slot for r in new.collect()} == {0x12345678: 0, 0x1234: 1, 0x5678: None}
    assert R.map_stats(new.where("slot is not null"), 4096).first() == (8192, 8192)
    holes = spark.createDataFrame([(4096, 0), (1 << 40, 2)], "id long, slot long")
    assert [r.new_slot for r in R.defragment(holes).orderBy("id").collect()] == [0, 1]
    assert R.allocate_run(holes, 2, 5).first()[0] == 3 and R.allocate_run(holes, 3, 5).count() == 0


def test_layers_and_unrequired(spark):
    base = device(spark, bytes([99]) * 100, 10).drop("device")
    layers = spark.createDataFrame([(1, 0, bytearray(b"layer-one.")), (2, 3, bytearray(b"layer-two.")), (3, 0, bytearray(b"layer-3333"))], "depth int, block_no long, data binary")
    seen = {r.block_no: bytes(r.data) for r in O.resolve_layers(layers.where("depth <= 2"), base).collect()}
    assert seen[0] == b"layer-one." and seen[3] == b"layer-two." and seen[5] == bytes([99]) * 10
    assert {r.block_no: bytes(r.data) for r in O.resolve_layers(layers, base).collect()}[0] == b"layer-3333"
    wide = S.block_range(spark, 0, 800)
    log = ops(spark, [("W", o, 4096) for o in (0, 10240, 400000, 701902)])
    overlay = B.touches(log, 50 << 20, 65536).select("block_no").distinct()
    assert numbers(O.unrequired(wide, overlay)) == [k for k in range(800) if k not in (0, 6, 10)]


def test_partial_writes_fold(spark):
    base = device(spark, bytes(range(40)), 10).drop("device")
    writes = spark.createDataFrame([(1, 1, 2, bytearray(b"abcd")), (1, 2, 4, bytearray(b"XY"))], "block_no long, seq long, rel_offset int, part binary")
    got = O.write_through(base, base.limit(0), writes).first()
    assert bytes(got.data) == bytes([10, 11]) + b"abXY" + bytes([16, 17, 18, 19])
    zero = O.resolve(base, base.limit(0), bits(spark, [0])).where("block_no = 3").first()
    assert bytes(zero.data) == bytes(10) and zero.origin == "zero"
