import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import gif as G


def plain_decode(stream, size):
    """LZW bit by bit, as the format's text has it."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    at, width, clear = 0, size + 1, 1 << size
    table, before, out = None, None, bytearray()
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, before, width = {i: bytes([i]) for i in range(clear)}, None, size + 1
            free = clear + 2
            continue
        if code == clear + 1:
            break
        entry = table[code] if code in table else before + before[:1]
        if before is not None and free < 4096:
            table[free] = before + entry[:1]
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        out += entry
        before = entry
    return bytes(out)


@pytest.mark.parametrize("size", [2, 3, 5, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 300, 4000, 30_000])
def test_lzw(size, n):
    rng = random.Random(n)
    for spread in (1, 1 << size):
        data = bytes(rng.randrange(spread) for _ in range(n))
        z = G.lzw_encode(data, size)
        assert G.lzw_decode(z, size, 1 << 30) == data == plain_decode(z, size)
        assert G.lzw_decode(z, size, n // 2) == data[: n // 2]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_any_bytes(data):
    assert G.lzw_decode(G.lzw_encode(data), 8, 1 << 30) == data


def test_full_table_without_clear():
    """A writer may go on with a full table."""
    rng, codes, table = random.Random(1), [], {bytes([i]): i for i in range(256)}
    data, w = bytes(rng.randrange(256) for _ in range(9000)), b""
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        codes.append(table[w])
        if len(table) + 2 < 4096:
            table[w + bytes([c])] = len(table) + 2
        w = bytes([c])
    codes.append(table[w])
    bits, n, width = "", 258, 9
    for i, c in enumerate([256, *codes, 257]):
        bits += f"{c:0{width}b}"[::-1]
        if i > 1 and n < 4096:
            n += 1
        width = min(12, max(9, n.bit_length()))
    stream = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    assert plain_decode(stream, 8) == data == G.lzw_decode(stream, 8, 1 << 30)


def test_broken_streams():
    with pytest.raises(ValueError):
        G.lzw_decode(bytes([0xFF] * 10), 8, 100)
    for bad in (b"", b"GIF89a", b"PNG" * 10):
        with pytest.raises(ValueError):
            G.decode(bad)


RGB = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)


def animation():
    full = np.zeros((4, 5), np.uint8)
    patch = np.array([[1, 3], [3, 1]], np.uint8)
    return G.Image(5, 4, [
        G.Frame(0, 0, full, RGB, 100, G.KEEP), G.Frame(1, 1, patch, RGB, 200, G.PREVIOUS, 3), G.Frame(3, 2, np.full((2, 2), 2, np.uint8), RGB, 50, G.BACKGROUND), G.Frame(0, 0, patch, RGB[::-1].copy(), 70, 0, 1),
    ])


def test_disposal_and_transparency():
    image = G.decode(G.encode(animation()))
    assert [(f.delay_ms, f.disposal, f.transparent) for f in image.frames] == [(100, 1, None), (200, 3, 3), (50, 2, None), (70, 0, 1)]
    a, b, c, d = (x.copy() for x in image.shown())
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert (a == red).all()
    assert b[1, 1].tolist() == green and b[1, 2].tolist() == red and b[2, 2].tolist() == green
    assert c[1, 1].tolist() == red and c[2, 3].tolist() == blue
    assert d[3, 4].tolist() == [0, 0, 0, 0] and d[0, 1].tolist() == red and d[0, 0].tolist() == red


def test_interlaced_and_local_palette():
    rows = np.repeat(np.arange(11, dtype=np.uint8)[:, None] % 4, 6, 1)
    order = [*range(0, 11, 8), *range(4, 11, 8), *range(2, 11, 4), *range(1, 11, 2)]
    data = bytearray(G.encode(G.Image(6, 11, [G.Frame(0, 0, rows[order], RGB)])))
    at = data.index(b"\x2c\0\0\0\0")
    data[at + 9] |= 0x40
    assert (G.decode(bytes(data)).frames[0].indices == rows).all()


def test_frames_table(spark):
    df = spark.createDataFrame([(1, G.encode(animation()), "x"), (2, None, "y"), (3, b"junk", "z"), (1, G.encode(animation()), "x")], "id long, gif binary, frames string")
    got = G.frames(df, "id", "gif").collect()
    assert [len(r.frames) for r in got] == [4, 0, 0, 4] and got[1].width is None
    f = got[0].frames
    assert [x.start_ms for x in f] == [0, 100, 300, 350] and sum(f[0].histogram) == 20 and f[0].histogram[48] == 20 and sum(f[3].histogram) == 16
    assert len(f[0].rgba) == 80


@pytest.mark.parametrize("n", [64, 640, 64 * 70_000])
def test_store(n):
    data = bytes(i * i % 251 for i in range(n))
    media = G.store(data)
    back, image = G.restore(media)
    assert back == data and len(image.frames) == (2 if n > 64 * 65535 else 1) and G.store(data) == media


def test_query_columns(spark):
    texts = [None, "", "a" * 64, "a" * 65, "é中😀" * 1000, "a" * 64, "\0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 gif", "2 as feature")
    got = {r.doc_id: r for r in G.features(G.media(df)).collect()}
    assert got == {r.doc_id: r for r in G.stored_features(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        light = [0] * 64
        for b in data:
            light[b // 4] += 1
        assert r.brightness == light and sum(r.histogram) == len(data)
        assert r.feature == f"1:64x{len(data) // 64}:0:" + ",".join(f"{k}={n}" for k, n in enumerate(light) if n)
        assert [tuple(f) for f in r.frames] == [(0, 0, len(data) // 64, 64)]
    assert got[2][2:] == got[5][2:] and got[0][1:] == got[1][1:]
    assert G.features(G.media(df.limit(0))).collect() == []


def test_rows_without_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (4, None)], "doc_id long, text string").toDF("doc_id", "text").selectExpr("doc_id", "text", "1 as n_bytes", "'x' as feature")
    got = G.stored_features(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == [(0, 1), (0, 1), (3, 1), (3, 1), (4, 0)] and got[0] == got[1]


def test_brightness_of_colours():
    rgba = np.array([[[255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [255, 255, 255, 255], [9, 9, 9, 0]]], np.uint8)
    light = G.brightness(rgba)
    assert light.sum() == 4 and light[63] == 1 and light[255 * 77 >> 10] == 1 and light[255 * 150 >> 10] == 1 and light[255 * 29 >> 10] == 1
