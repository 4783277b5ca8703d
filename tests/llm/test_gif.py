import random
import struct

import numpy as np
import pytest

from lodestone.llm.op5_gif import PALETTE, _blocks, decode, encode, feature, frame_table, frames, histogram, lzw_decode, lzw_encode, media_table, payload_of


@pytest.mark.parametrize("n", [0, 1, 2, 3, 63, 64, 65, 255, 256, 3838, 5000, 70_000])
def test_lzw_round_trip(n):
    r = random.Random(n)
    for data in (bytes(r.randrange(256) for _ in range(n)), bytes(r.choice(b"abc ") for _ in range(n)), b"\0" * n, bytes(range(256)) * (n // 256)):
        assert lzw_decode(lzw_encode(data), 8) == data


def test_lzw_known_stream():
    # the classic 10 x 10 sample, four colours, minimum code size 2
    stream = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C0491 4C01".replace(" ", ""))
    rows = lzw_decode(stream, 2)
    assert len(rows) == 100
    assert rows[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2])
    assert rows[30:40] == bytes([1, 1, 1, 0, 0, 0, 0, 2, 2, 2])


def _gif(size, images):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0xF7, 0, 0), PALETTE]
    for (x, y, w, h), disposal, clear, pixels in images:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0), b"\0\x2c", struct.pack("<HHHHB", x, y, w, h, 0), b"\x08", _blocks(lzw_encode(bytes(pixels)))]
    return b"".join(out) + b"\x3b"


def test_disposal_and_transparency():
    got = [(f.start_ms, f.canvas[..., 0].copy(), f.canvas[..., 3].copy()) for f in decode(_gif((3, 1), [((0, 0, 3, 1), 1, None, [1, 2, 3]), ((0, 0, 2, 1), 3, 9, [9, 5]), ((1, 0, 1, 1), 2, None, [7]), ((2, 0, 1, 1), 0, None, [8])]))]
    assert [t for t, _, _ in got] == [0, 70, 140, 210]
    assert [c.tolist() for _, c, _ in got] == [[[1, 2, 3]], [[1, 5, 3]], [[1, 7, 3]], [[1, 0, 8]]]
    assert got[3][2].tolist() == [[255, 0, 255]]


def test_payload_and_frames(spark):
    assert [len(payload_of(b"a" * n)) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]
    texts = [None, "", "é" * 31, "word " * 30_000]
    media = media_table(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    rows = frames(media).collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in rows if r.id == k), key=lambda r: r.frame)
        back = b"".join(np.frombuffer(r.rgb, np.uint8)[0::3].tobytes() for r in own)
        assert back == payload_of((t or "").encode())
        assert [r.start_ms for r in own] == [100 * i for i in range(len(own))]
        assert all(sum(r.histogram[:8]) == r.width * r.height for r in own)
    assert frames(media.limit(0)).collect() == []
    assert histogram(np.zeros((2, 2, 4), np.uint8)).sum() == 0
    assert encode(payload_of(b"x")) == encode(payload_of(b"x"))


def plain_lzw(stream, size):
    """A decoder by the book, one code at a time."""
    clear, end, bits, have, at, out = 1 << size, (1 << size) + 1, 0, 0, 0, bytearray()
    table, width, last = {}, size + 1, None
    while True:
        while have < width:
            bits, have, at = bits | stream[at] << have, have + 8, at + 1
        code, bits, have = bits & (1 << width) - 1, bits >> width, have - width
        if code == end:
            return bytes(out)
        if code == clear:
            table, width, last = {i: bytes([i]) for i in range(clear)}, size + 1, None
            continue
        entry = table[code] if code in table else last + last[:1]
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = last + entry[:1]
        out, last = out + entry, entry
        if len(table) + 2 == 1 << width and width < 12:
            width += 1


def test_large_streams_by_a_plain_decoder():
    r = random.Random(12)
    for data in (r.randbytes(70_000), bytes(r.choice(b"the and of ") for _ in range(200_000))):
        assert plain_lzw(lzw_encode(data), 8) == data


def test_stored_timed_frames(spark):
    from pyspark.sql import functions as F

    texts = [None, "", "same", "same", "word " * 30_000]
    media = media_table(spark.createDataFrame([*enumerate(texts), (None, "same")], "doc_id bigint, text string"))
    rows = frame_table(media).select("*", feature(F.col("frames")).alias("feature")).collect()
    assert len(rows) == 6 and len({str(tuple(r)[1:]) for r in rows if r.n_bytes == 4}) == 1
    for r in rows:
        data = payload_of((texts[r.id] if r.id is not None else "same" or "").encode() if r.id not in (0,) else b"")
        bins = np.stack([np.bincount(np.frombuffer(PALETTE, np.uint8).reshape(-1, 3)[np.frombuffer(data, np.uint8), c] >> 5, minlength=8) for c in range(3)])
        assert r.feature == "|".join(",".join(map(str, b)) for b in bins.tolist()) and r.payload_bytes == len(data)
        assert [f.start_ms for f in r.frames] == [100 * k for k in range(len(r.frames))] and sum(sum(f.histogram) for f in r.frames) == 3 * len(data)
    assert frame_table(media.limit(0)).collect() == []
