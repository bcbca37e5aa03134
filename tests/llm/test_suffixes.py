import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from blockloom.llm import suffixes as S
from blockloom.llm.suffixes import LENGTH, remove_repeats, repeat_digests


def brute(rows):
    """Places of every 200-byte string, by dictionary."""
    where = defaultdict(list)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for k, (_, b) in enumerate(texts):
        for i in range(len(b) - LENGTH + 1):
            where[b[i : i + LENGTH]].append((k, i))
    gone = [bytearray(len(b)) for _, b in texts]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + LENGTH] = b"\1" * LENGTH
    out = []
    for (i, b), g in zip(texts, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        runs = sum(1 for j, y in enumerate(g) if y and (j == 0 or not g[j - 1]))
        out.append((i, len(b), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, q string").repartition(3)
    return sorted((tuple(r) for r in repeat_digests(df).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(150, 400)], text(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", ""]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[5][1][:300]), (103, "a" * 1000), (104, "ab" * 300), (105, "a" * 199), (106, "a" * 200), (107, None), (108, "")]
    near = rows[7][1]
    for k in range(12):
        words = near.split(" ")
        words[rng.randrange(len(words))] = word()
        rows.append((200 + k, " ".join(words)))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(spark, rows) == brute(rows)


def test_repeated_rows_empty_table_and_nulls(spark):
    rows = [(None, "z" * 150 + "y" * 150), (1, None), (1, None), (2, "")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_cover_has_every_difference():
    assert {(a - b) % S.V for a in S.D for b in S.D} == set(range(S.V)) and S.GRAM + S.V - 1 == LENGTH


def test_crowded_buckets_are_split(spark):
    """One gram at more than LIMIT places: repeats in it are found, and none of it is sorted as a bucket."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("bcdefgh ", k=n))
    rows = [(1, "a" * 400_000), (2, letters(150) + "a" * 450 + letters(90)), (3, letters(300) + "a" * 150 + letters(300)), (4, letters(900))]
    assert got(spark, rows) == brute(rows)


def test_one_gram_in_many_contexts_meets_nowhere():
    rng = np.random.default_rng(2)
    common = rng.integers(97, 123, 134, np.uint8).tobytes()
    texts = [rng.integers(97, 123, 100, np.uint8).tobytes() + common + rng.integers(97, 123, 166, np.uint8).tobytes() for _ in range(42_000)]
    chunks = pa.Table.from_batches(list(S._chunker(1 << 20)([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])])))
    asked = pa.Table.from_batches(list(S._ask_samples(8)(chunks.to_batches()))).sort_by("route")
    flags = {}
    for batch in S._judge(asked.to_batches()):
        for r in batch.to_pylist():
            flags.setdefault(r["chunk"], []).append(r)
    rows = [r | {"flags": flags[r["chunk"]]} for r in chunks.to_pylist()]
    chunk = S._Chunk(rows[0], 8)
    crowded = set(chunk.code[chunk.classes(rows[0]["flags"]) == 2].view(np.int64).tolist())
    assert len(crowded) > 3

    class Batch:
        def to_pylist(self):
            return rows

    blocks = pa.Table.from_batches(list(S._emit_blocks(8)([Batch()]))).column("route").to_pylist()
    assert not crowded & set(blocks) and max(map(blocks.count, set(blocks))) < S.LIMIT
    strings = pa.Table.from_batches(list(S._ask_strings(8)([Batch()]))).sort_by("route")
    assert list(S._judge(strings.to_batches())) == []


def test_long_text_crosses_chunks(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, long), (2, long[1_048_300:1_049_000]), (3, long[5:400] + "tail")]
    out = {r[0]: r for r in got(spark, rows)}
    assert out[1][1:4] == (2_300_000, 700 + 395, 2)
    assert out[2][2:4] == (700, 1) and out[3][2:4] == (395, 1)


def test_document_stage_keeps_columns(spark):
    rng = random.Random(3)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(2))
    df = spark.createDataFrame([(1, a, "s"), (2, "intro " + a[100:400] + " end", "s"), (3, b, None), (4, b, None)], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert set(rows) == {1, 2} and rows[2].text == "intro  end" and rows[1].text == a[:100] + a[400:]
    assert remove_repeats(df).columns == ["doc_id", "text", "source"]


def test_odd_columns_stay(spark):
    from blockloom.llm.suffixes import remove_repeats

    rows = [(k, f"text {k}", "key", 5, {"k": 1}) for k in range(5)] + [(None, None, None, None, None), (9, "long " * 200, "a", 1, {}), (10, "long " * 200, "b", 1, {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, q_k string, q_spans int, m map<string,int>")
    out = remove_repeats(df)
    assert out.schema == df.schema and sorted(map(repr, out.collect())) == sorted(map(repr, df.where("doc_id is null or doc_id < 9").collect()))
