"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are read as words: A-Z lowered, runs of digits, letters and anything
beyond ASCII. The items' words go into one suffix automaton; a document's words are streamed
through it and the length of the longest match that ends at each word is tracked. Where it
reaches `window` words, or a whole item that is shorter, the words of the match are hit.
`clean` removes hit spans and drops documents whose hit share is above a limit.

A stretch of words can hold a match only if every pair of neighbours in it is a pair of some
item, so stretches are found first with a bit table of hashed pairs (it errs on one side
only), and the automaton reads these.

The automaton is built on the driver for at most `block_words` words of items at a time;
longer items are cut into pieces that overlap by window - 1 words, and a larger benchmark is
worked off in blocks. Its windows' hashes go into one bit table first, and only documents that have one of these (nearly
all of them are hit, whatever the number of blocks) are written aside and read by each block in turn: what it finds is
written with them and merged with the next block's. The others' texts stay where they are. Pieces that repeat go before
they are dealt to blocks. So one automaton is held at a time, and memory is bounded whatever the benchmark's size.

Defined results: a null text has no words and no hits; null ids and repeated rows of documents come back as they are; an item without words is never hit. A
null item_id counts as an item and is named by the empty string. Items that repeat (same id) count once.
An empty benchmark hits nothing. Extra columns are ignored by `hits` and kept by `clean`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import arrow_batch, count_position, drop_path, fresh_path, materialize, numbered, pick, position, slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PAIRS = 1 << 20
WINDOW, MAX_COVERAGE, BLOCK_WORDS = 10, 0.5, 400_000
#: Of the table of windows' hashes: bits for each window, and of the whole at most (32 MB); bits that a window sets.
BITS_EACH, MOST_BITS, PROBES = 32, 1 << 28, 6


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(TABLE).split()


class Automaton:
    """Of pieces (item index, words). States hold the items whose windows end in them."""

    def __init__(self, pieces: list[tuple[int, list[bytes], bool]], window: int):
        """The flag of a piece says that it is a whole item of under `window` words."""
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in ws], short) for item, ws, short in pieces if ws]
        for _, ws, _ in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.found: dict[int, set[int]] = {}  # of a state that holds a window's words: its items
        self.short: dict[int, dict[int, set[int]]] = {}  # of a state that holds a short item: its length, items
        for item, ws, short in coded:
            for i, state, _ in self._walk(ws):
                if short:
                    if i == len(ws) - 1:
                        self.short.setdefault(state, {}).setdefault(len(ws), set()).add(item)
                elif i >= window - 1:
                    self.found.setdefault(self._cut(state, window), set()).add(item)
        self.least = min([window, *(len(ws) for _, ws, short in coded if short)])
        table = np.zeros(PAIRS, bool)
        for _, ws, _ in coded:
            a = np.array(ws, np.int64)
            table[_pair(a[:-1], a[1:])] = True
        self.pairs = table
        self.any = bool(coded)

    def _extend(self, last: int, w: int) -> int:
        step = self.next[last].get(w)
        if step is not None and self.length[step] == self.length[last] + 1:
            return step
        if step is not None:
            return self._clone(last, step, w)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._clone(at, to, w)
        return new

    def _clone(self, at: int, to: int, w: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[to]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def _cut(self, state: int, length: int) -> int:
        """The state of the last `length` words of what state holds."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _walk(self, coded: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match that ends there)."""
        state = length = 0
        nxt, link, lengths = self.next, self.link, self.length
        for i, w in enumerate(coded):
            while state and w not in nxt[state]:
                state = link[state]
                length = lengths[state]
            if w in nxt[state]:
                state = nxt[state][w]
                length += 1
            yield i, state, length

    def match(self, ws: list[bytes]) -> tuple[list[list[int]], set[int], int]:
        """Hit spans [start, end) of words, items with occurring windows, longest match."""
        spans: list[list[int]] = []
        items: set[int] = set()
        longest = 0
        if not self.any or len(ws) < self.least:
            return spans, items, longest
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        if self.least == 1:
            good = codes >= 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False]))))
            stretches = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        else:
            good = self.pairs[_pair(codes[:-1], codes[1:])] & (codes[:-1] >= 0) & (codes[1:] >= 0)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False]))))
            stretches = [(a, z + 1) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()) if z + 1 - a >= self.least]
        seen: set[int] = set()
        for a, z in stretches:
            for i, state, length in self._walk(codes[a:z].tolist()):
                longest = max(longest, length)
                if length >= self.window:
                    _add(spans, a + i + 1 - length, a + i + 1)
                    cut = self._cut(state, self.window)
                    if cut not in seen:
                        seen.add(cut)
                        items |= self.found.get(cut, set())
                if self.short:
                    at = state
                    while at > 0:
                        for n, who in self.short.get(at, {}).items():
                            if n <= length:
                                _add(spans, a + i + 1 - n, a + i + 1)
                                items |= who
                        at = self.link[at]
        return spans, items, longest


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & (PAIRS - 1)


def _add(spans: list[list[int]], start: int, end: int) -> None:
    """Keeps spans sorted and apart; a new one ends no earlier than the last."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


def pieces_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col="item_id", text_col="text") -> tuple[DataFrame, int]:
    """item, words, n, short, a row per different piece; the number of blocks."""
    items = pick(benchmark, id_col, text_col).toDF("item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    piece = max(2 * window, 2000)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int64()), ("short", pa.bool_())])
        for batch in slices(batches, "text"):
            out = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws = words(text)
                for at in range(0, max(1, len(ws) - window + 1), piece - window + 1) if ws else ():
                    some = ws[at : at + piece]
                    out.append((item, b" ".join(some), len(some), len(ws) < window))
            yield arrow_batch([[o[k] for o in out] for k in range(4)], schema)

    pieces = materialize(items.mapInArrow(cut, "item string, words binary, n long, short boolean").distinct(), "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    # a quarter less than fits, as hashing fills blocks unevenly
    return pieces, max(1, -(-int(total * 4 // 3) // block_words)) if total > block_words else 1


def block(pieces: DataFrame, k: int, n: int, window: int) -> tuple[list[str], Automaton]:
    """(item ids, automaton) of one of n blocks."""
    got = sorted((r[0], bytes(r[1]), r[3]) for r in pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k).collect())
    ids = sorted({g[0] for g in got})
    where = {x: i for i, x in enumerate(ids)}
    return ids, Automaton([(where[i], w.split(), s) for i, w, s in got], window)


class Screen:
    """Which documents may hold a window: a bit table of the hashes of windows, which errs on one side only."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        """bits: packed; sizes: the numbers of words that windows have."""
        self.bits, self.sizes = bits, sizes

    @staticmethod
    def hashes(ws: list[bytes], size: int) -> np.ndarray:
        """Of each `size` words in a row."""
        known: dict[bytes, int] = {}
        at = np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws))
        values = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[at]
        n = max(0, len(ws) - size + 1)
        total = np.full(n, size, np.uint64)
        for j in range(size):
            total = (total + values[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
        return total

    def slots(self, ws: list[bytes], size: int) -> np.ndarray:
        """A row of PROBES bits for each window (a Bloom filter's)."""
        h = self.hashes(ws, size)
        step = (h >> np.uint64(32)) * np.uint64(2) + np.uint64(1)
        return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(8 * len(self.bits))

    def passes(self, text: str | None) -> bool:
        ws = words(text)
        for size in self.sizes:
            at = self.slots(ws, size)
            if (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1).any():
                return True
        return False


def screen_of(pieces: DataFrame, window: int) -> Screen:
    """Of rows of `pieces_of`."""
    count = pieces.agg(F.sum(F.when(F.col("short"), 1).otherwise(F.col("n") - window + 1))).first()[0] or 0
    sizes = sorted(r[0] for r in pieces.select(F.when(F.col("short"), F.col("n")).otherwise(window)).distinct().collect())
    table = Screen(np.zeros(min(MOST_BITS, 1 << max(10, int(BITS_EACH * count - 1).bit_length())) // 8, np.uint8), sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [table.slots(w.split(), len(w.split()) if short else window) for w, short in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield arrow_batch([np.unique(np.concatenate(found)).astype(np.int64).ravel()], pa.schema([("slot", pa.int64())]))

    # as many numbers as the table has bits, at most
    some = pieces.select("words", "short").mapInArrow(run, "slot long").distinct().toArrow().column("slot").to_numpy()
    np.bitwise_or.at(table.bits, some >> 3, (1 << (some & 7)).astype(np.uint8))
    return table


FOUND = "struct<spans:array<int>,items:array<string>,longest:int>"
PA_FOUND = pa.struct([("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int32())])


def passes(rows: DataFrame, benchmark: DataFrame, window: int, block_words: int, at: int) -> tuple[DataFrame, tuple[list[str], Automaton], DataFrame | None]:
    """(rows, last block, others): a pass over rows, whose column `at` is the text, for every block but the last.
    Columns come back as c0, c1, ... and after a pass with one more, what the blocks found so far. Where there are several blocks, others are
    the rows that hold no window of any."""
    pieces, n = pieces_of(benchmark, window, block_words)
    spark, width, before = rows.sparkSession, len(rows.columns), None
    rows, others = numbered(rows), None
    if n > 1:
        table = spark.sparkContext.broadcast(screen_of(pieces, window))

        def side(may: bool) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in slices(batches, f"c{at}"):
                    yield part.filter(pa.array([table.value.passes(t) is may for t in part.column(at).to_pylist()], pa.bool_()))

            return rows.mapInArrow(run, rows.schema)

        others, rows = side(False), materialize(side(True), "decontaminate-screened")
    names = [*rows.columns, f"c{width}"]
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"c{width} {FOUND}").fields])
    for k in range(n - 1):
        held = spark.sparkContext.broadcast(block(pieces, k, n, window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, f"c{at}"):
                found = [spans_of(words(t), held.value, f) for t, f in zip(part.column(at).to_pylist(), earlier(part, width), strict=True)]
                state = [{"spans": [x for s in spans for x in s], "items": sorted(items), "longest": longest} for spans, items, longest in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(state, PA_FOUND)], names=names)

        path = fresh_path(spark, "decontaminate")
        rows.mapInArrow(run, schema).write.parquet(path)
        rows = spark.read.schema(schema).parquet(path)
        held.destroy()
        if before:
            drop_path(spark, before)
        before = path
    return rows, block(pieces, n - 1, n, window), others


def earlier(batch: pa.RecordBatch, width: int) -> list[dict | None]:
    return batch.column(width).to_pylist() if batch.num_columns > width else [None] * batch.num_rows


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, longest, a row per row of docs. `longest` is
    the longest match, within pieces of items of 2,000 words."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows, last, others = passes(rows, benchmark, window, block_words, 1)
    fields = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("longest", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "c1"):
            found = [verdict(words(t), held.value, f) for t, f in zip(batch.column(1).to_pylist(), earlier(batch, 2), strict=True)]
            schema = pa.schema([("doc_id", batch.column(0).type), *fields])
            yield arrow_batch([batch.column(0), *([f[k] for f in found] for k in range(5))], schema)

    return _both(rows, last, others, window, run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, longest long")


def _both(rows: DataFrame, last: tuple[list[str], Automaton], others: DataFrame | None, window: int, run: Callable, schema) -> DataFrame:
    """What run makes of rows with the last block, and of the others with none."""
    held = rows.sparkSession.sparkContext.broadcast(last)
    out = rows.mapInArrow(lambda batches: run(batches, held), schema)
    if others is None:
        return out
    none = rows.sparkSession.sparkContext.broadcast(([], Automaton([], window)))
    return out.unionByName(others.mapInArrow(lambda batches: run(batches, none), schema))


def verdict(ws: list[bytes], part: tuple[list[str], Automaton], before: dict | None = None) -> tuple[int, int, int, str, int]:
    spans, items, longest = spans_of(ws, part, before)
    named = ",".join(sorted(items))
    return len(ws), sum(z - a for a, z in spans), len(items), hashlib.sha256(named.encode()).hexdigest(), longest


def spans_of(ws: list[bytes], part: tuple[list[str], Automaton], before: dict | None = None) -> tuple[list[list[int]], set[str], int]:
    """What a block finds, merged with what those before it found."""
    ids, automaton = part
    spans, who, longest = automaton.match(ws)
    items = {ids[i] for i in who}
    if before:
        items.update(before["items"])
        longest = max(longest, before["longest"])
        merged: list[list[int]] = []
        for a, z in sorted([*spans, *map(list, zip(before["spans"][::2], before["spans"][1::2], strict=True))]):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        spans = merged
    return spans, items, longest


def without(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    lower = raw.lower()
    at = [m.span() for m in WORD.finditer(lower)]
    out, last = [], 0
    for a, z in spans:
        out.append(raw[last : at[a][0]])
        last = at[z - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS, text_col="text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs without hit spans: rows of which more than max_coverage of the words are hit go,
    the others lose their hit spans (chars_col, if it is there and holds whole numbers, is set anew)."""
    at, n_at = position(docs, text_col), count_position(docs, chars_col)
    width = len(docs.columns)
    schema = numbered(docs).schema
    rows, last, others = passes(docs, benchmark, window, block_words, at)

    def run(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            before = earlier(part, width)
            part = part.select(schema.names)
            keep, texts, changed = [], part.column(at).to_pylist(), False
            chars = part.column(n_at).to_pylist() if n_at is not None else None
            for i, text in enumerate(texts):
                ws = words(text)
                spans = spans_of(ws, held.value, before[i])[0]
                keep.append(sum(z - a for a, z in spans) <= max_coverage * len(ws))
                if spans and keep[-1]:
                    texts[i], changed = without(text, spans), True
                    if chars is not None:
                        chars[i] = len(texts[i])
            if changed:
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    columns[n_at] = pa.array(chars, columns[n_at].type)
                part = pa.RecordBatch.from_arrays(columns, names=schema.names)
            yield part.filter(pa.array(keep, pa.bool_()))

    return _both(rows, last, others, window, run, schema).toDF(*docs.columns)
