import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import tiff
from blockloom.llm.tiff import DEFLATE, LZW, NONE, PACKBITS, media_column, media_digests, pack_bits, pack_lzw, read_tiff, tiff_pages, unpack_bits, unpack_lzw, write_tiff

data = st.one_of(st.binary(max_size=3000), st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=5), st.integers(1, 3000)))


@settings(max_examples=150, deadline=None)
@given(data)
def test_codecs(x):
    assert unpack_bits(pack_bits(x), len(x)) == x
    assert unpack_lzw(pack_lzw(x), len(x)) == x


def test_lzw_fills_its_table():
    x = np.random.default_rng(1).integers(0, 256, 40000, np.uint8).tobytes()
    assert unpack_lzw(pack_lzw(x), len(x)) == x


@pytest.mark.parametrize("how", [NONE, LZW, DEFLATE, PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages(how, predictor, tile, order):
    rng = np.random.default_rng(how + tile)
    pages = [rng.integers(0, 40, (37, 50), np.uint8), rng.integers(0, 256, (5, 3, 3), np.uint8), np.full((1, 1), 7, np.uint8)]
    got = list(read_tiff(write_tiff(pages, how, predictor, tile, order, 8)))
    assert [g.shape for g in got] == [(37, 50, 1), (5, 3, 3), (1, 1, 1)]
    assert all((g.reshape(p.shape) == p).all() for g, p in zip(got, pages))


@pytest.mark.parametrize("how,predictor,tile", [(DEFLATE, 1, 0), (LZW, 2, 64), (None, 1, 0)])
def test_documents(spark, monkeypatch, how, predictor, tile):
    rows = [(1, "é" * 1000), (2, None), (3, ""), (4, "x" * 576), (4, "x" * 576), (None, "y" * 577), (5, "long " * 1_000_000)]
    df = spark.createDataFrame([(*r, "m") for r in rows if how == DEFLATE or len(r[1] or "") < 10_000], "doc_id long, text string, media string")
    got = media_digests(df, how, predictor, tile).collect()
    assert len(got) == df.count()
    for r in got:
        text = next((t or "") for i, t in rows if i == r.doc_id).encode()
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 4}) == 1
    if how == DEFLATE:
        assert tiff_pages(media_column(df)).where("doc_id = 5").count() == -(-(-(-5_000_000 // 576)) // tiff.PAGE_ROWS)
    assert media_digests(df.limit(0)).count() == 0


def test_missing_and_damaged_media(spark):
    good = write_tiff([np.full((4, 5), 9, np.uint8), np.full((2, 2), 8, np.uint8)], LZW)
    rows = [(1, 0, good), (2, 0, None), (3, 0, b""), (4, 0, b"II*\0"), (5, 0, good[:-30]), (6, 0, b"PNG" * 50), (None, 0, good), (7, 0, good[:10] + b"\xff" * 20 + good[30:])]
    got = tiff_pages(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, n_bytes long, media binary, error string")).collect()
    pages = {}
    for r in got:
        pages.setdefault(r.doc_id, []).append((r.page, r.error is None))
    assert pages[1] == pages[None] == [(0, True), (1, True)]
    assert all(pages[k][-1] == (None, False) for k in (2, 3, 4, 5, 6)) and set(pages) == {1, 2, 3, 4, 5, 6, 7, None}


def test_layouts_differ_and_hold_the_payload(spark):
    df = spark.createDataFrame([(k, f"text {k} " * (k % 50)) for k in range(120)], "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in media_column(df).collect()}
    assert all(b"".join(p.tobytes() for p in read_tiff(media[k])) == tiff._payload((f"text {k} " * (k % 50)).encode()) for k in media)
    assert len({tiff.LAYOUTS[zlib.crc32(tiff._payload((f"text {k} " * (k % 50)).encode())) % len(tiff.LAYOUTS)] for k in media}) == len(tiff.LAYOUTS)
