import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import simhash
from blockloom.llm.components import connected_components
from blockloom.llm.simhash import fingerprint, keep_one, near_pairs, simhash_groups
from blockloom.scratch import materialize


def brute_components(nodes, linked):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


def test_fingerprint_of_engine_hashes(spark):
    for text in ("The cat sat on the mat the cat sat", "Two wOrds", "É É é", "a b c"):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        hashes = [spark.range(1).select(F.xxhash64(F.lit(s.decode()))).first()[0] & (1 << 64) - 1 for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert fingerprint(text.encode()) & (1 << 64) - 1 == want
    assert fingerprint(None) == fingerprint(b" \n") == 0


def test_blocks_of_long_texts(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=5000)).encode()
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert fingerprint(text) == whole


@pytest.mark.parametrize("crowded", [32, 1])
def test_pairs_lose_no_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(crowded)
    prints = {0, -1, 1, 3, 7}
    for _ in range(40):
        x = rng.getrandbits(64)
        prints |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(6)}
    signed = sorted({np.array(p & (1 << 64) - 1, np.uint64).view(np.int64).item() for p in prints})
    got = {(r.a, r.b) for r in near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(80)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for e in links if e[0] != e[1] for x in e})
    pairs = {*links} | {(b, a) for a, b in links}
    groups = brute_components(nodes, lambda a, b: (a, b) in pairs)
    lowest = {}
    for n, g in zip(nodes, groups):
        lowest[g] = min(lowest.get(g, n), n)
    assert got == {n: lowest[g] for n, g in zip(nodes, groups)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(2)
    rows = []
    for k in range(40):
        words = [rng.choice(["alpha", "beta", "Gamma", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(120)]
        rows.append((3 * k, " ".join(words)))
        rows.append((3 * k + 1, "  ".join(words).upper().lower() if k % 2 else " ".join(words)))
        rows.append((3 * k + 2, " ".join(words[:-1] + ["end"])))
    return rows + [(500, None), (501, ""), (502, "..."), (None, rows[0][1]), (9, rows[9][1]), (9, rows[9][1])]


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(df).collect())
    prints = [fingerprint((t or "").encode()) & (1 << 64) - 1 for _, t in rows]
    groups = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    lowest = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            lowest[g] = min(lowest.get(g, i), i)
    assert got == sorted((i is None, i, f"{p:016x}", lowest.get(g)) for (i, _), p, g in zip(rows, prints, groups))
    kept = keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(lowest.values()) and kept.columns == df.columns
    assert simhash_groups(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_odd_columns_stay(spark):
    from blockloom.llm.near_copies import keep_dissimilar
    from blockloom.llm.simhash import keep_one

    rows = [(k, f"word{k} " * 3 + " ".join(f"x{k}y{j}" for j in range(30)), 1, 2, "r", {"k": 1}) for k in range(12)] + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, q_n int, q_id long, row_hash string, m map<string,int>")
    for keep in (keep_one, keep_dissimilar):
        out = keep(df)
        assert out.schema == df.schema and sorted(map(repr, out.collect())) == sorted(map(repr, [tuple_row(df, r) for r in rows]))


def tuple_row(df, values):
    from pyspark.sql import Row

    return Row(**dict(zip(df.columns, values)))


def test_exploded_segments_are_not_broadcast(spark):
    prints = materialize(spark.range(2000).selectExpr("xxhash64(id) as fp"), "t")
    joins = [x for x in near_pairs(prints)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "sub" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_classes_are_not_broadcast(spark):
    prints = materialize(spark.range(2000).selectExpr("id as doc_id", "id as row_hash", "xxhash64(id % 900) as fp"), "t")
    plan = simhash.grouped(prints, spark.range(0).selectExpr("id as a", "id as b"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
