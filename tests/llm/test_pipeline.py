"""The corpus pipeline against its stages' brute-force meaning, on a small corpus."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from blockloom.llm.simhash import fingerprint
from blockloom.llm.textstats import text_stats
from blockloom.llm.wordtok import default_vocabulary
from blockloom.scratch import materialize
from tests.llm.test_mixing import targets
from tests.llm.test_suffixes import brute as brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    rows = []
    for i in range(90):
        t = text(rng.randint(40, 200))
        if i % 6 == 0:
            t += " " + passage + " " + text(20)
        rows.append([i, t, rng.choice(["en", "de"]), rng.choice("abc")])
    rows += [[200 + k, rows[k][1], "en", "a"] for k in range(5)]
    rows += [[300, "no", "en", "a"], [301, None, None, None], [302, "same words all over again " * 20, "en", "b"], [303, " ".join(w + "###" for w in words[:50]), "en", "b"]]
    return [(*r, len(r[1] or "")) for r in rows]


def stage(spark, k, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = materialize(corpus_pipeline.STAGES[k][1](spark, df, ""), "t")
    assert k == 4 or out.columns == df.columns
    return [tuple(r) for r in out.collect()]


def test_stages(spark):
    rows = corpus()
    good = stage(spark, 0, rows)
    assert {r[0] for r in good} == {r[0] for r in rows if r[0] < 300}
    assert all(text_stats(r[1].encode())[0] >= 10 for r in good)
    one = stage(spark, 1, good)
    prints = {r[0]: fingerprint(r[1].encode()) & (1 << 64) - 1 for r in good}
    reach = {i: min(j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
    assert sorted(r[0] for r in one) == sorted(i for i in prints if reach[i] == i)
    cut = stage(spark, 2, one)
    want = {i: (n, gone) for i, n, gone, _, _ in brute_repeats([(r[0], r[1]) for r in one])}
    before = {r[0]: r for r in one}
    assert sum(g for _, g in want.values()) > 5_000
    for i, t, lang, source, n in cut:
        size, gone = want[i]
        assert size - gone - 3 <= len(t.encode()) <= size - gone and (lang, source, n) == (before[i][2], before[i][3], len(t))
    mixed = stage(spark, 3, cut)
    count = lambda t: len(t.encode().split())
    sizes, got = {}, {}
    for r in cut:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    for r in mixed:
        got[r[3]] = got.get(r[3], 0) + count(r[1])
    assert got == {s: int(t) for s, t in targets(sizes).items() if int(t)}
    packed = stage(spark, 4, mixed)
    tok = Tokenizer.from_str(default_vocabulary())
    want = sorted((r[0], zlib.crc32(np.array(tok.encode(r[1], add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in mixed)
    assert sorted((p[0], p[4]) for p in packed if p[2] == 0 and p[3] < 2048) == want


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 50 and [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
