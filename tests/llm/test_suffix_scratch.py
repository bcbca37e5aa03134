"""Shuffles of finished steps are dropped before larger ones begin."""

import tracemalloc

import numpy as np
import pyarrow as pa

from blockloom.llm import suffixes


def test_shuffles_of_texts_and_samples_go_before_the_blocks(spark, monkeypatch):
    steps = []
    emit, answered = suffixes._emit_blocks, suffixes._answered
    monkeypatch.setattr(suffixes, "release", lambda session: steps.append("release"))
    monkeypatch.setattr(suffixes, "_answered", lambda *a: steps.append("flags") or answered(*a))
    monkeypatch.setattr(suffixes, "_emit_blocks", lambda routes: steps.append("blocks") or emit(routes))
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j % 90}" for j in range(100))) for k in range(4)], "doc_id long, text string")
    suffixes.repeat_digests(docs)
    assert steps == ["flags", "release", "blocks", "release"]


def test_texts_lie_in_the_scratch_folder_once_when_blocks_are_made(spark, monkeypatch):
    there, then = [], []
    emit, write, drop = suffixes._emit_blocks, suffixes.materialize, suffixes.discard
    monkeypatch.setattr(suffixes, "materialize", lambda df, name: there.append(name) or write(df, name))
    monkeypatch.setattr(suffixes, "discard", lambda t: there.remove(t._scratch_path.rsplit("/", 1)[1].rsplit("-", 1)[0]) or drop(t))
    monkeypatch.setattr(suffixes, "_emit_blocks", lambda routes: then.extend(there) or emit(routes))
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j % 90}" for j in range(100))) for k in range(4)], "doc_id long, text string")
    suffixes.repeat_digests(docs)
    assert then == ["twins", "flagged"] and there == ["twins", "spans"]


def test_routes_of_a_batch_are_judged_one_at_a_time():
    rng = np.random.default_rng(1)
    asked, codes = [], {}
    for route in range(8):
        for chunk in range(2):
            own = np.unique(rng.integers(0, 1 << 18, 60_000, dtype=np.uint64))
            codes[route, chunk] = own
            low = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, : suffixes.LOW // 8])
            asked.append(suffixes._ask(chunk, np.full(len(own), route), low, np.ones(len(own), np.int64)))
    batch = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
    tracemalloc.start()
    out = [x for b in suffixes._judge(iter([batch])) for x in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for (route, chunk), own in codes.items():
        (got,) = [x for x in out if (x["route"], x["chunk"]) == (route, chunk)]
        assert (np.unpackbits(np.frombuffer(got["bits"], np.uint8), count=len(own)) == np.isin(own, codes[route, 1 - chunk])).all() and got["hot"] is None
    assert most < 20_000_000


def repeated_blocks(n):
    rng = np.random.default_rng(3)
    common = [rng.integers(97, 123, 200, np.uint8).tobytes() for _ in range(40)]
    texts = [rng.integers(97, 123, 60, np.uint8).tobytes() + common[k % 40] + rng.integers(97, 123, 80, np.uint8).tobytes() for k in range(n)]
    chunks = pa.Table.from_batches(list(suffixes._chunker(1 << 20)([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])])))
    asked = pa.Table.from_batches(list(suffixes._ask_samples(8)(chunks.to_batches()))).sort_by("route")
    flags = {}
    for batch in suffixes._judge(asked.to_batches()):
        for r in batch.to_pylist():
            flags.setdefault(r["chunk"], []).append(r)
    kind = pa.list_(pa.struct([("route", pa.int64()), ("bits", pa.binary()), ("hot", pa.binary())]))
    flagged = chunks.append_column("flags", pa.array([flags.get(c, []) for c in chunks.column(0).to_pylist()], kind))
    return list(suffixes._emit_blocks(8)(flagged.combine_chunks().to_batches()))


def test_blocks_leave_in_small_batches():
    blocks = repeated_blocks(6_000)
    assert sum(b.num_rows for b in blocks) > 10_000 and max(b.nbytes for b in blocks) < 2_500_000


def test_blocks_are_sorted_without_a_matrix_of_places():
    blocks = pa.Table.from_batches(repeated_blocks(6_000))
    blocks = blocks.filter(blocks.column("anchor").is_valid()).slice(0, 15_000).sort_by("route").combine_chunks()
    batches = blocks.to_batches(max_chunksize=10_000)
    tracemalloc.start()
    runs = sum(b.num_rows for b in suffixes._sort_buckets(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 15_000 and runs and most < 1_600 * 15_000, most  # eight bytes for each of 200 places would be as much by themselves
