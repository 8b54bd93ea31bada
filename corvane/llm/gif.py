"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames.

`decode` reads any GIF: both versions, global and local palettes, interlaced frames, delays,
the disposal methods and transparent indices. A code stream's bits are read with numpy: from
one clear code to the next the widths of codes are known beforehand. `encode` writes indexed
frames with full LZW. `frames` gives a row per frame with its delay, pixels and histograms.

`store` keeps any bytes as the indices of a grey image 64 pixels wide, `restore` reads them.

Defined results: a null or empty text is stored as 64 zero bytes; a null id stays null. Equal bytes give equal files.
Bytes that are no GIF give no frames (`frames`) or a ValueError (`decode`). Very long payloads
take several frames of at most 65,535 rows. Extra columns are ignored; repeated rows come back
repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm.common import arrow_batch, pick, slices

GREY = bytes(v for i in range(256) for v in (i, i, i))
WIDTH, ROWS = 64, 65535
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # rows x columns
    palette: np.ndarray  # colours x 3
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Image:
    width: int
    height: int
    frames: list[Frame]

    def shown(self) -> Iterator[np.ndarray]:
        """The canvas (RGBA) while each frame shows."""
        canvas = np.zeros((self.height, self.width, 4), np.uint8)
        for f in self.frames:
            before = canvas.copy() if f.disposal == PREVIOUS else None
            h, w = f.indices.shape
            part = canvas[f.top : f.top + h, f.left : f.left + w]
            own = f.indices[: part.shape[0], : part.shape[1]]
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(f.palette), :3] = f.palette
            colours[:, 3] = 255
            if f.transparent is None:
                part[:] = colours[own]
            else:
                drawn = own != f.transparent
                part[drawn] = colours[own[drawn]]
            yield canvas
            if f.disposal == BACKGROUND:
                part[:] = 0
            elif before is not None:
                canvas = before


@lru_cache
def _widths(size: int) -> np.ndarray:
    """Bits of the n-th code after a clear code, until the table is full."""
    n = np.arange(4096 - (1 << size) - 2 + 1)
    free = (1 << size) + 2 + n - 1  # the table's first free place as the n-th code is read
    free[0] = (1 << size) + 2
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(free)).astype(np.int64) + 1))


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """A code stream with a clear code first and whenever the table is full."""
    clear, stop = 1 << size, (1 << size) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    add = codes.append
    table: dict[int, int] = {}  # a known string's code and the next value: the longer string's code; codes stand 8 bits up
    get, free, most = table.get, (stop + 1) << 8, 4095 << 8
    rest = iter(data)
    at = next(rest, -1) << 8
    for c in rest:
        known = get(at | c)
        if known is not None:
            at = known
            continue
        add(at)
        if free == most:
            add(clear << 8)
            runs.append(codes)
            codes = []
            add = codes.append
            table.clear()
            free = (stop + 1) << 8
        else:
            table[at | c] = free
            free += 256
        at = c << 8
    if at >= 0:
        add(at)
    add(stop << 8)
    runs.append(codes)
    widths = _widths(size)
    bits = np.concatenate([[size + 1], *(widths[: len(r)] for r in runs)])
    flat = np.concatenate([[clear], *(np.array(r) >> 8 for r in runs)])
    grid = (flat[:, None] >> np.arange(12)) & 1
    return np.packbits(grid[np.arange(12) < bits[:, None]].astype(np.uint8), bitorder="little").tobytes()


@lru_cache
def _first(clear: int) -> list[bytes]:
    return [bytes([i]) for i in range(clear)] + [b"", b""]


def _strings(codes: list[int], table: list[bytes], before: bytes, clear: int) -> list[bytes]:
    """What the codes stand for; table grows as they are read. before: the string of the code before,
    empty behind a clear code."""
    rest = iter(codes)
    out: list[bytes] = []
    if not before:
        first = next(rest, None)
        if first is None:
            return out
        if first >= clear:
            raise ValueError("a code stream begins with a code that is not yet known")
        before = table[first]
        out.append(before)
    known, add, grow = len(table), out.append, table.append
    for c in rest:
        if c < known:
            entry = table[c]
        elif c == known:
            entry = before + before[:1]
        else:
            raise ValueError("a code stream holds a code that is not yet known")
        if known < 4096:
            grow(before + entry[:1])
            known += 1
        add(entry)
        before = entry
    return out


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """At most `most` values of a code stream; what is missing at its end stays missing."""
    clear, stop = 1 << size, (1 << size) + 1
    widths = _widths(size)
    base = _first(clear)
    raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
    last = len(stream) * 8
    bit, out, got = 0, [], 0
    table, before, count = list(base), b"", 0  # count: codes since the clear code
    while got < most:
        ws = widths[count : count + 4096] if count < len(widths) else np.full(4096, 12)
        ends = bit + np.cumsum(ws)
        ws, ends = ws[ends <= last], ends[ends <= last]
        if not len(ws):
            break
        starts = ends - ws
        byte = starts >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7).astype(np.uint32)) & ((1 << ws) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(marks[0]) if len(marks) else len(codes)
        part = _strings(codes[:n].tolist(), table, before, clear)
        if part:
            count, before = count + n, part[-1]
            out.append(b"".join(part))
            got += len(out[-1])
        if len(marks):
            bit = int(ends[n])
            if codes[n] == stop:
                break
            table, before, count = list(base), b"", 0
        else:
            bit = int(ends[-1])
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(b)]) + b for i in range(0, len(data), 255) if (b := data[i : i + 255])) + b"\0"


def encode(image: Image) -> bytes:
    """A GIF89a; the first frame's palette is global, others are local where they differ."""

    def table(palette: np.ndarray) -> tuple[int, bytes]:
        bits = max(1, (len(palette) - 1).bit_length())
        return bits, palette.astype(np.uint8).tobytes().ljust(3 << bits, b"\0")

    bits, colours = table(image.frames[0].palette)
    out = [b"GIF89a", struct.pack("<HHBBB", image.width, image.height, 0x80 | 7 << 4 | bits - 1, 0, 0), colours]
    if len(image.frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for f in image.frames:
        own_bits, own = table(f.palette)
        local = own != colours
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay_ms // 10, f.transparent or 0) + b"\0")
        h, w = f.indices.shape
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, 0x80 | own_bits - 1 if local else 0) + (own if local else b""))
        size = max(2, own_bits)
        out += [bytes([size]), _blocks(lzw_encode(f.indices.tobytes(), size))]
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> Image:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def table(flag: int) -> np.ndarray:
        nonlocal at
        n = 3 << (flag & 7) + 1
        at += n
        return np.frombuffer(data[at - n : at], np.uint8).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = table(flags) if flags & 0x80 else np.frombuffer(GREY, np.uint8).reshape(-1, 3)
    image = Image(width, height, [])
    timing = (0, 0, None)
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                bits, delay, clear = struct.unpack_from("<BHB", body)
                timing = (delay * 10, bits >> 2 & 7, clear if bits & 1 else None)
        elif kind == 0x2C:
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = table(own) if own & 0x80 else shared
            size = data[at]
            at += 1
            if not 1 <= size <= 8:
                raise ValueError(f"a code size of {size}")
            flat = np.frombuffer(lzw_decode(blocks(), size, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if own & 0x40:
                rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(flat)
                plain[rows] = flat
                flat = plain
            image.frames.append(Frame(left, top, flat, palette, *timing))
            timing = (0, 0, None)
        else:
            raise ValueError(f"an unknown block {kind:#x}")
    return image


def store(payload: bytes) -> bytes:
    """payload, a positive multiple of 64 bytes, as a grey GIF of 64 columns."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    grey = np.frombuffer(GREY, np.uint8).reshape(-1, 3)
    parts = [grid[i : i + ROWS] for i in range(0, len(grid), ROWS)]
    return encode(Image(WIDTH, len(parts[0]), [Frame(0, 0, p, grey, 100 * (len(parts) > 1), KEEP) for p in parts]))


def restore(media: bytes) -> tuple[bytes, Image]:
    image = decode(media)
    return b"".join(f.indices.tobytes() for f in image.frames), image


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Pixels by colour: two bits each of red, green and blue, 64 bins; transparent ones are left out."""
    shown = rgba[rgba[..., 3] > 0]
    return np.bincount((shown[:, 0] >> 6).astype(np.int64) << 4 | (shown[:, 1] >> 6 << 2) | shown[:, 2] >> 6, minlength=64)


def brightness(rgba: np.ndarray) -> np.ndarray:
    """Pixels by luminance (77 red, 150 green, 29 blue of 256), 64 bins of four levels; transparent ones are left out."""
    shown = rgba[rgba[..., 3] > 0].astype(np.uint32)
    return np.bincount((shown[:, 0] * 77 + shown[:, 1] * 150 + shown[:, 2] * 29 >> 10).astype(np.int64), minlength=64)


FRAMES = "array<struct<frame:int,start_ms:long,delay_ms:int,disposal:int,width:int,height:int,rgba:binary,histogram:array<long>,brightness:array<long>>>"


def frames(media: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """id, width, height, frames (start, delay, disposal, the canvas as RGBA, histograms by colour and by luminance)."""
    rows = pick(media, id_col, gif_col).toDF("id", "gif")
    inner = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("width", pa.int32()),
                       ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("brightness", pa.list_(pa.int64()))])

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data or b"")
        except (ValueError, struct.error, IndexError):
            return None, None, []
        out, now = [], 0
        for k, (f, canvas) in enumerate(zip(image.frames, image.shown(), strict=True)):
            out.append({"frame": k, "start_ms": now, "delay_ms": f.delay_ms, "disposal": f.disposal, "width": image.width, "height": image.height, "rgba": canvas.tobytes(), "histogram": histogram(canvas).tolist(), "brightness": brightness(canvas).tolist()})
            now += f.delay_ms
        return image.width, image.height, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "gif", 1 << 20):
            found = [one(g) for g in batch.column(1).to_pylist()]
            yield arrow_batch([batch.column(0), *([f[k] for f in found] for k in range(3))], pa.schema([("id", batch.column(0).type), ("width", pa.int32()), ("height", pa.int32()), ("frames", pa.list_(inner))]))

    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(f"width int, height int, frames {FRAMES}").fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def media(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, gif: each text's padded bytes, stored as a GIF."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, data = zip(*map(padded, batch.column(1).to_pylist()), strict=True)
            yield arrow_batch([batch.column(0), list(sizes), [store(d) for d in data]], pa.schema([("doc_id", batch.column(0).type), ("n_bytes", pa.int64()), ("gif", pa.binary())]))

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("gif", T.BinaryType())]))


TIMES = "array<struct<start_ms:long,delay_ms:int,rows:int,columns:int>>"
FIELDS = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames {TIMES}, histogram array<long>, brightness array<long>"
_ARROW = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
          ("frames", pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("rows", pa.int32()), ("columns", pa.int32())]))),
          ("histogram", pa.list_(pa.int64())), ("brightness", pa.list_(pa.int64()))]


def _examined(size: int, gif: bytes) -> tuple:
    payload, image = restore(gif)
    colours, light = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for canvas in image.shown():
        colours += histogram(canvas)
        light += brightness(canvas)
    times, now = [], 0
    for f in image.frames:
        times.append({"start_ms": now, "delay_ms": f.delay_ms, "rows": f.indices.shape[0], "columns": f.indices.shape[1]})
        now += f.delay_ms
    feature = f"{len(image.frames)}:{image.width}x{image.height}:{now}:" + ",".join(f"{i}={n}" for i, n in enumerate(light.tolist()) if n)
    return size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), feature, times, colours, light


def _described(rows: DataFrame, size_bytes: str, one) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size_bytes):
            found = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield arrow_batch([batch.column(0), *([f[k] for f in found] for k in range(len(_ARROW)))], pa.schema([("doc_id", batch.column(0).type), *_ARROW]))

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(FIELDS).fields]))


def features(stored: DataFrame) -> DataFrame:
    """Of rows of `media`: digests of what is read back and of the file, the timed frames, and histograms of
    the canvases by colour and by luminance; `feature` names frames, size, milliseconds and the latter."""
    return _described(stored.select("doc_id", "n_bytes", "gif"), "gif", _examined)


def stored_features(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """`features` of `media` in one pass, for files that need not be kept: a text's file is made, read back and
    described by one task, so it crosses to no other process."""

    def one(text: str | None) -> tuple:
        size, data = padded(text)
        return _examined(size, store(data))

    return _described(pick(docs, id_col, text_col).toDF("doc_id", "text"), "text", one)
