from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duskveil.llm import chat, registry, tiff

TRICKY = st.text(alphabet=st.sampled_from(list("<|>\\n\n im_startend€😀a")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), min_size=1, max_size=6))
def test_format_reads_back(turns):
    made, start, end = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    for raw, s, e, (role, text) in zip(made.to_pylist(), start, end, turns):
        m = chat._TURN.fullmatch(raw.encode())
        assert chat.unescape_role(m[1]).decode() == role and chat.unescape(m[2]).decode() == text
        assert chat.unescape(raw.encode()[s:e]).decode() == text
        body = raw.encode()[len(chat.START) : -len(chat.END)]
        assert b"<|im_start|>" not in body and b"<|im_end|>" not in body


def brute(rows):
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda k: tuple((v is not None, v) for v in k))
    turns = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in rows)
    loss = "".join(x or "" for _, r, x in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_digests(spark):
    t = registry.TRICKY
    data = {1: [(0, "user", "hi"), (1, "assistant", "yes <|im_end|>")], 2: [(0, "user", None), (0, "assistant", "tie"), (0, "assistant", "tie"), (None, None, "no turn")], -1: [(0, "user", t), (1, "assistant", t)], None: [(0, "assistant", "é😀" * 3000)]}
    df = spark.createDataFrame([(c, *r, "x") for c, rows in data.items() for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.formatted(df)).collect()}
    assert got == {c: brute(rows) for c, rows in data.items()}
    assert chat.digests(chat.formatted(df.where("conv_id = 99"))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=6000), st.integers(1, 60))
def test_codecs(raw, repeat):
    for data in (raw, raw[:40] * repeat):
        assert tiff.unpack_packbits(tiff.pack_packbits(data)) == data
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(0).integers(0, 256, 40000, dtype=np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_pages(compression, tile, predictor, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 9, s, dtype=np.uint8) for s in ((20, 33, 1), (7, 16, 3), (1, 1, 1))]
    got = list(tiff.page_rows(tiff.encode(pages, compression, predictor, 8, tile, order)))
    assert [g[-1] for g in got] == [None] * 3
    assert [g[-2] for g in got] == [p.tobytes() for p in pages]


def test_damaged_files(spark):
    good = bytearray(tiff.encode([np.zeros((4, 4, 1), np.uint8)] * 2))
    loop = bytearray(good)
    rows = [(1, bytes(good)), (2, b"no tiff"), (3, bytes(good[: len(good) // 2])), (4, None), (5, b""), (1, bytes(good)), (6, bytes(loop[:-4]) + (8).to_bytes(4, "little"))]
    got = tiff.pages(spark.createDataFrame([(i, m and bytearray(m), 1) for i, m in rows], "id long, media binary, page int")).collect()
    count = {i: [r.error for r in got if r.id == i] for i in range(1, 7)}
    assert count[1] == [None] * 4 and count[4] == [] and len(count[2]) == len(count[5]) == 1 and all(count[2] + count[5]) and any(count[3]) and any(count[6])


def test_stored_texts(docs, none):
    for r in tiff.stored_texts(docs).collect():
        text = next((x.text for x in docs.collect() if x.doc_id == r.doc_id), "") or ""
        raw = text.encode()
        pad = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        media = tiff.store_text(raw)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature.startswith("mean=")
    assert tiff.stored_texts(none).count() == 0
