import random

import numpy as np
from tokenizers import Tokenizer

from blockloom.llm.token_files import END, scan_token_files, token_counts
from blockloom.llm.wordtok import default_vocabulary, word_ids


def test_scan_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    expected, files = [], []
    for k in range(5):
        ids = []
        for d in range(rng.randint(0, 60)):
            n = rng.choice([0, 1, 5, 300])
            expected.append((f"f{k}", d, len(ids), n, True))
            ids += [rng.randint(0, 49406) for _ in range(n)] + [END]
        if k % 2:
            expected.append((f"f{k}", sum(1 for e in expected if e[0] == f"f{k}"), len(ids), 3, False))
            ids += [9, 9, 9]
        path = tmp_path / f"f{k}"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files.append((str(path), path.stat().st_size))
    for block in (2, 14, 100, 4 << 20):
        got = scan_token_files(spark, files if block > 2 else files[:1], block).collect()
        want = expected if block > 2 else [e for e in expected if e[0] == "f0"]
        assert sorted((r.path.rpartition("/")[2], *r[1:]) for r in got) == sorted(want)


def test_counts_and_ids(spark):
    rng = random.Random(2)
    texts = ["It's the End, of 12 LINES!", "Größe ÉTÉ naïve ñandú", "日本語 ok ①", "Σίσυφος ΣΑΣ x", "<|endoftext|> </w>", "a b ć", "ﬁ ǅ İstanbul", "it'S WE'LL ''s", "x" * 500, None, "", " \t\n"]
    texts += ["".join(rng.choice("abcdefghéß,.'-0123<> \n") for _ in range(400)) for _ in range(30)]
    tok = Tokenizer.from_str(default_vocabulary())
    tok.encode_special_tokens = True
    fast = word_ids(default_vocabulary())
    for t in texts:
        assert np.frombuffer(fast.ids((t or "").encode()), "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids
    df = spark.createDataFrame([(i % 40, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, path int")
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts(df, block=64).collect())
    want = sorted((i % 40, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert got == want
    assert token_counts(df.limit(0)).count() == 0
