"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are joined, turned into an array of codepoints and from there into an array of classes
(letter, number, blank, ...). Where pieces begin follows from the classes: for white space
from the neighbours alone, for the rest from a machine of seven states. A class is a function
from state to state; such functions compose associatively, so the states are found by a scan:
blocks of codepoints are composed side by side, then the blocks by doubling, and last each
block is run from its known state. No regex takes part. The slices go to a cache of pieces; a
piece that is not in it is merged by rank.

The scan gives the same pieces as matching
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Defined results: a null or empty text has no tokens. Every text comes back from `decode` byte
by byte. Repeated rows come back repeated; an empty table gives an empty result. Extra columns
are ignored. Whole texts are read; a piece may be as long as its text (merging one is
n log n). The cache holds `CACHE` pieces twice at most, and short
pieces only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm.common import arrow_batch, pick, slices

CACHE, CACHED_CHARS, SHORT = 100_000, 64, 48
WIDTH = 512  # codepoints of a block
TOKENS = 1 << 18  # decoded at a time
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE, WHITE = range(7)
#: States: a new piece comes next; in letters, numbers, other; after the blank that the next
#: piece begins with; one or two characters of a contraction to come.
FRESH, IN_L, IN_N, IN_P, JOIN, ONE, TWO = range(7)
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each codepoint. Which are letters and numbers is asked of the library whose
    tokens are to be matched, as it may know another Unicode version than Python."""
    single = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, cls in (("L", LETTER), ("N", NUMBER)):
        known = tiktoken.Encoding(f"class-{kind}", pat_str=rf"\p{{{kind}}}", mergeable_ranks=single, special_tokens={})
        out[np.frombuffer(bytes(known.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = cls
    out[WHITE_SPACE] = WHITE
    return out


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece begin) by class and state."""
    step, begins = np.zeros((7, 7), np.uint8), np.zeros((7, 7), bool)
    opened = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_P, QUOTE1: ONE, QUOTE2: TWO, SPACE: JOIN, WHITE: FRESH}
    inside = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_P, QUOTE1: IN_P, QUOTE2: IN_P}
    for cls, to in opened.items():
        for state in range(7):
            if state in (ONE, TWO):
                step[cls, state] = FRESH if state == ONE else ONE
            elif cls in inside and (state == JOIN or state == inside[cls]):
                step[cls, state] = inside[cls]
            else:
                step[cls, state], begins[cls, state] = to, True
    return step, begins


STEP, BEGINS = _machine()


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin, as flags. points: codepoints, after each text one more of any kind;
    ends: the places of those."""
    cls = classes()[points]
    n = len(cls)
    cls[ends] = WHITE
    white = cls == WHITE
    sep = np.zeros(n + 2, bool)
    sep[ends] = True
    # white space: the first of a run begins a piece, and the last does if a text goes on behind it
    before = np.concatenate(([True], ~white[:-1]))
    before[ends[:-1] + 1] = True
    behind = np.concatenate((~white[1:], [False]))
    local = before | behind
    cls[(points == 32) & behind & ~sep[:n]] = SPACE
    # apostrophes: what would they contract?
    p1 = np.concatenate((points[1:], [0]))
    p1[ends] = 0
    p1[ends[ends > 0] - 1] = 0
    p2 = np.concatenate((points[2:], [0, 0]))[:n]
    quote = points == 39
    quote[ends] = False
    if quote.any():
        q = np.flatnonzero(quote)
        a, b = p1[q], p2[q]
        gone = sep[q + 1] | sep[q + 2]
        b = np.where(gone, 0, b)
        cls[q[np.isin(a, [ord(c) for c in "stmd"])]] = QUOTE1
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cls[q[two]] = QUOTE2
    rows = -(-n // WIDTH)
    grid = np.full(rows * WIDTH, WHITE, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, WIDTH).T)
    flat = STEP.ravel()
    # each block as a function of the state before it
    fn = np.tile(np.arange(7, dtype=np.uint8), (rows, 1))
    for column in grid:
        fn = flat[column[:, None] * np.uint8(7) + fn]
    # composed over all blocks before, by doubling
    total = fn
    hop = 1
    while hop < rows:
        total = np.concatenate((total[:hop], np.take_along_axis(total[hop:], total[:-hop], axis=1)))
        hop *= 2
    state = np.concatenate(([FRESH], total[:-1, FRESH])).astype(np.uint8)
    begin = np.empty((WIDTH, rows), bool)
    starts = BEGINS.ravel()
    for k, column in enumerate(grid):
        at = column * np.uint8(7) + state
        begin[k] = starts[at]
        state = flat[at]
    out = begin.T.ravel()[:n]
    ws = (cls == WHITE) | (cls == SPACE)
    return np.where(ws, local, out) | sep[:n]


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The pieces of each text."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    at = np.flatnonzero(boundaries(points, ends))
    where = np.searchsorted(at, ends).tolist()
    cuts = at.tolist()
    first = 0
    for last in where:
        own = cuts[first : last + 1]
        yield [joined[a:z] for a, z in zip(own, own[1:])]
        first = last + 1


class Codec:
    """Ranks of a file of lines `base64(bytes) rank`; ids are the ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths  # of each token's bytes in flat
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        # two tokens' ids (the first one 20 bits up) and the id of both together
        self.pairs = {
            self.ranks[a] << 20 | self.ranks[b]: rank
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (a := token[:i]) in self.ranks and (b := token[i:]) in self.ranks
        }
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.digits = [str(i) for i in range(len(self.token))]
        self.ids: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Joins the pair of least rank, the leftmost of equals, until no pair has one."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) <= SHORT:
            return self._merge_short(piece)
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 where none starts
        prev = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, z = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != z:
                continue
            end[i], end[mid] = z, 0
            if z < n:
                prev[z] = i
                r = ranks.get(piece[i : end[z]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[z]))
            p = prev[i]
            if p >= 0:
                r = ranks.get(piece[p:z])
                if r is not None:
                    heapq.heappush(heap, (r, p, z))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        """The same, by looking for the least of a short list each time."""
        get, none = self.pairs.get, len(self.token)
        ids = [self.single[b] for b in piece]
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = least
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | least, none)
            if i < len(ranks):
                ranks[i] = get(least << 20 | ids[i + 1], none)
        return tuple(ids)

    def learn(self, own: list[str]) -> None:
        """Puts what is missing into the cache. A full cache becomes the older of two; what is
        asked for again comes back from there."""
        if len(self.ids) > CACHE:
            self.ids, self.before = {}, self.ids
        for piece in set(own).difference(self.ids):
            self.ids[piece] = self.before.get(piece) or self.merge(piece.encode())

    def forget(self, own: list[str]) -> None:
        """Long pieces do not stay."""
        for piece in own:
            if len(piece) > CACHED_CHARS and piece in self.ids:
                del self.ids[piece]

    def encode(self, own: list[str]) -> tuple[list[int], str]:
        """Ids of a text's pieces, and the same as digits with blanks between."""
        self.learn(own)
        ids = list(chain.from_iterable(map(self.ids.__getitem__, own)))
        if max(map(len, own), default=0) > CACHED_CHARS:
            self.forget(own)
        return ids, " ".join(map(self.digits.__getitem__, ids))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin, and the length behind; a slice of ids is the bytes between two of these."""
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Each token's bytes go to where its offset says, `TOKENS` tokens at a time."""
        out = np.empty(int(offsets[-1] - offsets[0]), np.uint8)
        for at in range(0, len(ids), TOKENS):
            some, own = ids[at : at + TOKENS], offsets[at : at + TOKENS + 1]
            source = np.repeat(self.starts[some] - own[:-1], np.diff(own)) + np.arange(own[0], own[-1])
            out[own[0] - offsets[0] : own[-1] - offsets[0]] = self.flat[source]
        return out.tobytes()


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, ranks_path: str, id_col="doc_id", text_col="text", arrays: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with arrays, ids and offsets (the first
    byte of each token, then the length): `decode` gives the bytes of any range of tokens. Offsets are
    kept through either way; decoded_sha256 is that of the bytes decoded by them.
    ranks_path must be readable on every executor."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    lists = pa.list_(pa.int32())
    extra = [("ids", lists), ("offsets", lists)] if arrays else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in slices(batches, "text"):
            schema = pa.schema([("doc_id", batch.column(0).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *extra])
            made, digests = [], []
            for some in pieces([t or "" for t in batch.column(1).to_pylist()]):
                ids, digits = own.encode(some)
                made.append(np.array(ids, np.int32))
                digests.append(hashlib.sha256(digits.encode()).hexdigest())
            counts = np.fromiter(map(len, made), np.int64, len(made))
            ids = np.concatenate(made)
            # the offsets of all the slice's texts in a row, and where each text begins among its tokens
            offsets, first = own.offsets(ids), np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
            raw, at = own.decode(ids, offsets), offsets[first]
            back = [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
            more = []
            if arrays:
                more.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)))
                # a text has an offset more than it has tokens
                where = np.arange(len(ids) + len(made)) - np.repeat(np.arange(len(made)), counts + 1)
                local = (offsets[where] - np.repeat(at[:-1], counts + 1)).astype(np.int32)
                more.append(pa.ListArray.from_arrays(pa.array((first + np.arange(len(first))).astype(np.int32)), pa.array(local)))
            yield arrow_batch([batch.column(0), pa.array(counts), digests, back, *more], schema)

    fields = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n, _ in extra]
    return rows.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, ranks_path: str, id_col="doc_id", first: int = 0, last: int | None = None) -> DataFrame:
    """doc_id, bytes of tokens [first, last) of rows that hold ids and offsets; null ids give null."""
    rows = pick(encoded, id_col, "ids", "offsets").toDF("doc_id", "ids", "offsets")

    def one(own: Codec, ids: list[int] | None, offsets: list[int] | None) -> bytes | None:
        if ids is None or offsets is None:
            return None
        some = np.array(ids[first:last], np.int64)
        return own.decode(some, np.array(offsets[first : first + len(some) + 1], np.int64)) if len(some) else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            found = [one(own, i, o) for i, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield arrow_batch([batch.column(0), found], pa.schema([("doc_id", batch.column(0).type), ("bytes", pa.binary())]))

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("bytes", T.BinaryType())]))
