import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from blockloom.llm import mixing
from blockloom.llm.mixing import apply_mix, mix_documents


def targets(sizes, share=1.5, most=2.0):
    """Reshare by weight until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, got = share * sum(sizes.values()), {}
    while rest := [s for s in names if s not in got]:
        per = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * per > most * sizes[s]]
        if not over:
            got |= {s: weight[s] * per for s in rest}
            break
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
    return got


def brute(rows):
    size = lambda t: len((t or "").encode().split())
    sources = defaultdict(list)
    for i, t, s in rows:
        sources[s].append((hashlib.md5(("mix" + ("" if i is None else str(i))).encode()).hexdigest(), i is not None, i or 0, size(t), i))
    goal = targets({s: sum(x[3] for x in v) for s, v in sources.items()})
    out = []
    for s, docs in sources.items():
        total, budget, at = sum(x[3] for x in docs), int(goal[s]), 0
        passes = budget // total if total else 0
        for _, _, _, n, i in sorted(docs):
            out.append((i, n, total, round(goal[s], 6), passes * n + max(0, min(n, budget - passes * total - at))))
            at += n
    return sorted(map(repr, out))


@pytest.mark.parametrize("range_rows", [1024, 3])
def test_against_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    rows = [(i, "w " * (i % 13), ["a", "b", "é", "z", None][min(4, i % 17)]) for i in range(300)] + [(7, "w w", "b"), (7, "w w", "b"), (None, "x y", "a"), (900, None, "empty"), (901, " \t", "empty"), (902, "l " * 20000, "b")]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, source string, size int, mix_key string").repartition(3)
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix_documents(df).collect()]
    assert sorted(map(repr, got)) == brute(rows)
    assert mix_documents(df.limit(0)).count() == 0


def test_twin(spark):
    sf = "/root/testdata/sf0.001"
    got = mix_documents(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(mixing.ORACLE).fetchall())


def test_documents_follow_the_mix(spark):
    rows = [(i, f"doc {i} " + "w " * (i % 40), "abc"[min(2, i % 7)], 1.5) for i in range(200)] + [(3, "same row", "a", 0.0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra double")
    out = apply_mix(df)
    assert out.columns == df.columns
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    want = {r.source: r.t for r in mix_documents(df).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert all(want[s] - 2 <= got[s] <= want[s] for s in want)
    assert apply_mix(df.limit(0)).count() == 0


def test_equal_rows_stay_whole(spark):
    df = spark.createDataFrame([(1, "one two three four", "a")] * 1000 + [(2, "x y", "b")], "doc_id long, text string, source string").repartition(5)
    got = {(r.doc_id, r.text): r["count"] for r in apply_mix(df, weights=(1.0, 1.0), share=1.5).groupBy("doc_id", "text").count().collect()}
    assert got == {(1, "one two three four"): 1499, (1, "one two three"): 1, (2, "x y"): 2}


def test_odd_columns_stay(spark):
    rows = [(k, f"w{k} " * 5, "a", 1, "z", {"k": k}, [{"m": 1}]) for k in range(20)] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q_size int, q_row string, m map<string,int>, n array<map<string,int>>")
    out = apply_mix(df, share=1.0)
    assert out.columns == df.columns and sorted(map(repr, out.collect())) == sorted(map(repr, df.where("text is not null").collect()))
