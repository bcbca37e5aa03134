import random

import numpy as np

import corpus_pipeline
from blockloom.llm import near_copies
from blockloom.llm.near_copies import parities, parities_apart, shingle_hashes
from blockloom.scratch import materialize

SCHEMA = "doc_id long, text string"


def similar(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similar(rows[i][1], rows[j][1]):
                group = [group[j] if g == group[i] else g for g in group]
    return sorted(min(r[0] for r, g in zip(rows, group) if g == k) for k in set(group))


def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    boiler = rng.choices(words, k=30)
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(3, 150)) + boiler * rng.randint(0, 1)
        rows.append(base)
        for _ in range(6):
            near = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 20)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append(near)
    # A hot group: near copies of one text, each with its own change.
    hot = rng.choices(words, k=100)
    rows += [hot[:k] + ["x"] + hot[k:] for k in range(60)]
    # Another whose members mostly are near the first of it but not near each other.
    wide = rng.choices(words, k=120)
    for changes in rng.choices(range(1, 7), k=90):
        near = list(wide)
        for k in rng.sample(range(120), changes):
            near[k] = rng.choice(words)
        rows.append(near)
    texts = [" ".join(t) for t in rows] + [None, "", " \n", "one", "ONE", "one two"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = materialize(corpus_pipeline.near_duplicates(spark, df, ""), "t")
    assert sorted(r.doc_id for r in out.collect()) == brute(rows) and out.columns == df.columns
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_blocks_of_a_shingle_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_OF", 8)
    rows = corpus()
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_shingles():
    assert len(shingle_hashes(b"a b c d e f")) == 2 and len(shingle_hashes(b"A b")) == 1 and len(shingle_hashes(None)) == 0
    assert (shingle_hashes(b"A b") == shingle_hashes(b" a  B")).all()


def test_parities_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 40, 500, 5000):
        for m in (0, 1, n // 3, n):
            shared = rng.integers(-(2**63), 2**63, n)
            a, b = (np.unique(np.concatenate([shared, rng.integers(-(2**63), 2**63, k)])) for k in (m, 2 * m // 3))
            assert parities_apart(parities(a), parities(b)) == parities_apart(parities(b), parities(a)) <= len(np.setxor1d(a, b))
    apart = [np.unique(rng.integers(-(2**63), 2**63, 3000)) for _ in range(2)]
    assert 9 * parities_apart(*map(parities, apart)) > 6000


def test_pairs_meet_at_their_first_shared_shingle(spark):
    from pyspark.sql import functions as F

    from blockloom.llm.components import _oriented

    # Long sets, whose parities tell nothing: 0 and 1 share a whole run of shingles, 2 shares every third of them, and 9 others with 3.
    runs = {0: list(range(100)), 1: list(range(100)), 2: sorted([*range(0, 100, 3), *(1000 + k for k in range(9))]), 3: [1000 + k for k in range(9)]}
    places = [(k, fp, 4000, at, fp) for fp, keys in runs.items() for at, k in enumerate(keys)]
    rooted = spark.createDataFrame(places, "key long, fp long, n int, pos int, root long")
    hubs = rooted.groupBy("key").agg(F.count("*").alias("size"), F.max("root").alias("hub")).where("size > 1")
    odd = near_copies.parities(np.arange(4000))
    sets = spark.createDataFrame([(fp, bytearray(odd)) for fp in runs], "fp long, odd binary")
    made = []
    first = near_copies._first_met
    near_copies._first_met = lambda rows: made.append(materialize(first(rows), "met")) or made[-1]
    try:
        pairs = near_copies._unlinked_pairs(rooted.join(hubs, "key"), sets, sets.selectExpr("fp as a", "fp as b").limit(0))
    finally:
        near_copies._first_met = first
    assert sorted(map(tuple, pairs.collect())) == [(1, 0), (2, 0), (2, 1), (3, 2)]
    assert _oriented(made[0]).count() == 4 and made[0].count() <= 12


def test_sets_repeated_for_each_block_are_not_broadcast(spark):
    odd = ", ".join(f"id as o{k}" for k in range(near_copies.WORDS_OF_BITS))
    rows = materialize(spark.range(600).selectExpr("1L as key", "id as fp", "10 as n", "0 as pos", "id as root", "-1L as hub", "3 as blocks", "array(id) as earlier", *odd.split(", ")), "t")
    plan = near_copies._first_met(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_exploded_prefixes_are_not_broadcast(spark, monkeypatch):
    plans, write = [], materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    sets = write(spark.range(300).selectExpr("id as fp", "20 as n", "transform(sequence(0, 19), x -> x + id div 2) as prefix"), "t")
    met = near_copies._meeting(sets.selectExpr("fp", "n", "posexplode(prefix) as (pos, key)"))
    assert met.count() == 6000 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
