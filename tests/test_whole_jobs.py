"""Queries that take all rows of their tables."""

import random

from blockloom.operators import blocks as B
from blockloom.operators import ranges as R
from blockloom.operators import sets as S
from blockloom.plans import registry
from tests.test_entry import DATA

QUERIES = registry.queries()


def test_slots_for_all_ids(spark):
    mapped = spark.createDataFrame([(5, 1), (7, 3)], "id long, slot long")
    wanted = spark.createDataFrame([(k,) for k in range(10)] + [(0,)], "id long")
    assert R.slots_for(mapped, wanted) == 12 and R.slots_for(mapped.limit(0), wanted) == 10
    got = {r.id: r.slot for r in R.allocate(mapped, wanted, R.slots_for(mapped, wanted)).collect()}
    assert got == {0: 0, 1: 2, 2: 4, 3: 5, 4: 6, 5: 1, 6: 7, 7: 3, 8: 8, 9: 9}


def written(spark):
    """Blocks written on each device, by plain loops over the log."""
    from blockloom.plans import bind

    got = {}
    for r in bind.oplog(spark, DATA).collect():
        got.setdefault(r.device, set())
        if r.op == "W" and r.length > 0:
            got[r.device] |= {*range(r.offset // bind.BLOCK, (min(r.offset + r.length, bind.SIZE) - 1) // bind.BLOCK + 1)}
    return got


def test_short_text_has_every_written_block(spark):
    got = {r.device: {b.block_no for b in S.load_short_text(spark.createDataFrame([(r.text,)], "text string")).collect()} for r in QUERIES["short_text_all"](spark, DATA).collect()}
    assert got == {d: b for d, b in written(spark).items() if b}


def test_zero_extents_of_each_device(spark):
    blocks = spark.createDataFrame([(1, 0), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)], "device long, block_no long")
    keys = spark.createDataFrame([(1,), (2,), (3,), (3,)], "device long")
    assert sorted(map(tuple, S.zero_extents(blocks, keys, 0, 4, "device").collect())) == [(1, 1, 3), (2, 0, 0), (3, 0, 4)]
    assert {r.stop for r in S.zero_extents(blocks, keys, 5, 5, "device").collect()} == {5}
    clear = {d: sorted({*range(256)} - b) for d, b in written(spark).items()}
    want = {(d, c[0] if c else 0, c[-1] + 1 if c else 0) for d, c in clear.items()}
    assert {tuple(r) for r in QUERIES["zero_extents_all"](spark, DATA).collect()} == want


def test_every_write_has_its_mark_and_its_blocks(spark):
    from blockloom.plans import bind

    t = B.touches(bind.oplog(spark, DATA), bind.SIZE, bind.BLOCK)
    marks = sum(r.n_dup for r in QUERIES["heatmap_p2p_all"](spark, DATA).collect())
    assert marks == t.where("op = 'W'").count() > 0
    reads = {}
    for r in t.where("op = 'R'").collect():
        reads.setdefault(r.device, set()).add(r.block_no)
    ready = {r.device: r.n_ready for r in QUERIES["progress_all"](spark, DATA).collect()}
    assert ready == {d: len(reads.get(d, set()) - b) for d, b in written(spark).items()}
    got = QUERIES["cow_write_all"](spark, DATA).collect()
    assert len(got) == bind.base(spark, DATA).count() and all(r.data[8:12] == b"wx".hex() for r in got)


def test_write_fold_of_bytes(spark):
    rng = random.Random(4)
    rows = [(d, 0, s, "W" if s % 9 else "R", a, rng.randint(0, 300 - a)) for s in range(1, 60) for d in range(2) for a in [rng.choice([0, 16, rng.randrange(300)])]]
    df = spark.createDataFrame(rows, "device long, block_no long, seq long, op string, rel_offset long, part_len long")
    want = {}
    for d in range(2):
        shown = {b: s for dev, _, s, op, a, n in rows if dev == d and op == "W" for b in range(a, a + n)}
        for s in shown.values():
            want[d, 0, s] = want.get((d, 0, s), 0) + 1
    for cell in (1, 16, 64, 512):
        assert {tuple(r)[:3]: r.bytes for r in B.write_fold_bytes(df, cell).collect()} == want
