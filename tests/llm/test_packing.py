import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm.packing import CAPACITY, SMALL_PART, configurations, grouped_sizes, pack_documents, plan, solve
from blockloom.llm.wordtok import default_vocabulary


def unrolled(rows):
    """Sequences as lists of (offset, length) from a plan."""
    out = {}
    for length, first, end, sequence, count, offset in rows:
        for r in range(end - first):
            out.setdefault(sequence + r % count, []).append((offset + r // count * length, length))
    return out


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=25))
def test_plans_are_whole_and_tight(histogram):
    check_plan(plan(histogram, 100, 8), histogram)
    rows = plan(histogram, 100)
    assert len(check_plan(rows, histogram)) <= best_fit_decreasing([k for k, n in histogram.items() for _ in range(n)], 100) + 1


def check_plan(rows, histogram):
    sequences = unrolled(rows)
    assert sorted(x for s in sequences.values() for _, x in s) == sorted(k for k, n in histogram.items() for _ in range(n))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 100
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_configurations_beat_rounding():
    got = configurations([30, 34, 40], [100, 100, 100], 100)
    assert sum(t for t, _ in got) <= 120 and all(np.dot(c, [30, 34, 40]) <= 100 for _, c in got)


def test_documents(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde  ") for _ in range(rng.choice([10, 300, 3000]))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (5, texts[5]), (5, texts[5]), (None, "x"), (102, "long word " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(4)
    got = [r.asDict() for r in pack_documents(df).collect()]
    tok = Tokenizer.from_str(default_vocabulary())
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, k * CAPACITY, len(ids[k * CAPACITY : (k + 1) * CAPACITY]), zlib.crc32(ids[k * CAPACITY : (k + 1) * CAPACITY].tobytes())) for k in range(-(-len(ids) // CAPACITY))]
    assert sorted(repr(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in got) == sorted(map(repr, want))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(sequences) <= best_fit_decreasing([w[3] for w in want], CAPACITY) + 1
    assert pack_documents(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("same", [1, 2048])
def test_one_length_alone(same):
    assert max(s + n for *_, s, n, _ in plan({same: 10_000})) == -(-10_000 * same // 2048)


def test_special_tokens_in_texts_are_the_librarys(spark):
    from blockloom.llm.packing import token_pieces
    from blockloom.llm.wordtok import word_ids

    tok, fast = Tokenizer.from_str(default_vocabulary()), word_ids(default_vocabulary(), special=True)
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>x <|ENDOFTEXT|> <|end oftext|>", "a <| b |> c", "plain words"]
    for t in texts:
        assert np.frombuffer(fast.ids(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    got = token_pieces(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).first()
    assert got.length == len(tok.encode(texts[0], add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("seed", range(3))
def test_configured_sequences_stay(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(1500):
        n = min(CAPACITY - 1, max(1, int(rng.lognormvariate(6.5, 0.7))))
        histogram[n] = histogram.get(n, 0) + 1
    bins, configured, kept = solve(histogram)
    pieces = [k for k, n in histogram.items() for _ in range(n)]
    large = sum(n for k, n in histogram.items() if k * SMALL_PART > CAPACITY)
    assert kept >= 0.9 * configured and configured * 5 >= large
    assert bins.total() <= best_fit_decreasing(pieces, CAPACITY) + 1


def test_rounding_up_in_equal_groups():
    sizes, demand = grouped_sizes({500: 3, 505: 1, 510: 2, 700: 4, 900: 2}, 4)
    assert sizes == [500, 510, 700, 900] and demand == [3, 3, 3, 3]
