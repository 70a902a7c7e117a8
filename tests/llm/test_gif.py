"""GIF: round trips, hand-made files with palettes, disposal and transparency, and the query's digests."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from windlake.llm import gif


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 255, 5000, 70_000):
        for data in (rng.integers(0, 1 << bits, n).astype(np.uint8).tobytes(), b"\1" * n, (bytes(range(3)) * n)[:n]):
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def test_known_file():
    # two colours, 2 x 2, codes clear 0 1 1 0 end written by hand with 3 bits each: 4 0 1 1, then 6 is unused, 0, 5
    codes, bits = [4, 0, 1, 1, 0, 5], [3, 3, 3, 3, 4, 4]
    value = at = 0
    for c, b in zip(codes, bits):
        value |= c << at
        at += b
    stream = value.to_bytes((at + 7) // 8, "little")
    assert gif.lzw_decode(stream, 2, 4) == bytes([0, 1, 1, 0])
    data = b"GIF87a\2\0\2\0\x80\0\0" + bytes([255, 0, 0, 0, 0, 255]) + b"\x2c\0\0\0\0\2\0\2\0\0\2" + bytes([len(stream)]) + stream + b"\0\x3b"
    (frame,) = gif.decode(data)
    assert frame.rgba[..., 0].tolist() == [[255, 0], [0, 255]] and frame.rgba[..., 2].tolist() == [[0, 255], [255, 0]]
    assert gif.colour_histogram(frame.rgba)[[48, 3]].tolist() == [2, 2]


def test_disposal_and_transparency():
    palette = bytes([9, 9, 9, 200, 0, 0, 0, 200, 0, 0, 0, 200])
    full, part = np.full((2, 2), 1), np.array([[0, 2]])
    shown = lambda **k: [f.rgba.copy() for f in gif.decode(gif.encode([full, part, np.array([[3]])], palette, **k))]
    kept = shown(disposal=1, transparent=0)
    assert kept[1][0, 0].tolist() == [200, 0, 0, 255] and kept[1][0, 1].tolist() == [0, 200, 0, 255] and kept[2][0].tolist() == [[0, 0, 200, 255], [0, 200, 0, 255]]
    cleared = shown(disposal=2, transparent=0)
    assert cleared[1][0].tolist() == [[0, 0, 0, 0], [0, 200, 0, 255]] and cleared[2][1].tolist() == [[0, 0, 0, 0]] * 2
    restored = shown(disposal=3)
    assert restored[1][1].tolist() == [[0, 0, 0, 0]] * 2 and restored[1][0, 0].tolist() == [9, 9, 9, 255]


def test_interlaced_rows():
    assert gif._interlaced(10).tolist() == [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]


def test_frames_table(spark):
    media = [(1, gif.encode([np.full((2, 3), 7), np.full((2, 3), 250)])), (2, None)]
    rows = gif.frame_table(spark.createDataFrame(media, "id long, media binary"), "id", "media").orderBy("frame").collect()
    assert [(r.id, r.frame, r.start_cs, r.width, r.height, sum(r.histogram), len(r.pixels)) for r in rows] == [(1, 0, 0, 3, 2, 6, 24), (1, 1, 10, 3, 2, 6, 24)]


def test_op7(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    odd = spark.createDataFrame([(-1, None, ""), (-2, "", ""), (-3, "é" * 100_000, ""), (None, "x" * 64, ""), (-2, "", "")], "doc_id long, text string, media string")
    text |= {-1: b"", -2: b"", -3: ("é" * 100_000).encode(), None: b"x" * 64}
    rows = [*gif.op7_gif(spark, sf).collect(), *gif.media_features(spark, odd).collect()]
    assert len(rows) == len(text) + 1
    for r in rows:
        data = text[r.doc_id]
        payload = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert gif.media_features(spark, odd.limit(0)).count() == 0


def test_broken_files_are_rows_and_no_failure(spark):
    whole = gif.encode([np.arange(64, dtype=np.uint8).reshape(8, 8)] * 3)
    files = [(1, whole), (2, whole[:-40]), (3, b"no gif"), (4, None), (5, b""), (6, whole[:900])]
    got = {}
    for r in gif.frame_table(spark.createDataFrame(files, "k long, m binary"), "k", "m").collect():
        got.setdefault(r.k, []).append(r.error is None)
    assert got[1] == [True] * 3 and 4 not in got and got[3] == got[5] == [False]
    assert got[2][-1] is False and got[2].count(False) == 1 and got[6].count(False) == 1
