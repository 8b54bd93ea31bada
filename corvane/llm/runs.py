"""Periodic runs: stretches of words that repeat with a period, three times or more.

Words are runs of anything but blanks. A run is a stretch with smallest period q, of max(LEAST, 3 q)
words or more, which no neighbouring word extends. Every run with period q holds a grid point g (a
multiple of q) such that the q words from g on equal the q words from g + q on. So for each period the
grid points of all texts of a slice are compared by prefix hashes, all (period, grid point) pairs of a
block at once: n / q points for period q, n log n in all. How far the pairs that agree extend to the
left and to the right is found by binary search over the same hashes, for all of them at the same time;
then the words themselves are compared, and what several grid points or multiples of the period have
found is told once, with the least period. Hashes can only make a stretch too long, never too short, and
comparing the words shows it: such a slice is searched again with the words in place of the hashes.

`runs` gives a row per document with its runs; `collapse` keeps the first period of each run.

Defined results: null and empty texts have no words and no runs. Rows that repeat are handled like others.
Of the column names given, exact ones win where they clash; other columns are kept by `collapse` and
ignored by `runs`. Empty tables give empty results. Ties of the highest exponent go to the least start,
then to the least period. Whole texts are searched, whatever their length: a text beyond a slice is a
slice of its own, and blocks bound the pairs that are held at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import arrow_batch, count_position, numbered, pick, position, slices

#: Words that a run has at least.
LEAST = 24
#: (period, grid point) pairs that are compared at a time.
BLOCK = 1 << 19
#: Any odd number: the base of the prefix hashes.
BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def numbers(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Equal words get equal numbers, across texts."""
    known: dict[bytes, int] = {}
    after = count()
    return [np.fromiter(map(known.setdefault, ws, after), np.int64, len(ws)) for ws in texts]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Grid:
    """The numbered words of several texts in a row, each text followed by a word of its own."""

    def __init__(self, texts: list[np.ndarray], least: int):
        top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
        self.least = least
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        self.ids = np.concatenate([x for i, t in enumerate(texts) for x in (t, [top + i])]) if texts else np.zeros(0, np.int64)
        n = len(self.ids)
        self.power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(self.ids) * self.power[:n])))

    def equal(self, at: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words from each `at` on have the hash of those q further on."""
        h = self.prefix
        return (h[at + size] - h[at]) * self.power[q] == h[at + q + size] - h[at + q]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Periods and grid points, in blocks, of texts that are long enough for the period."""
        n, longest = len(self.ids), int(self.sizes.max(initial=0))
        if longest < self.least:
            return
        periods = np.arange(1, longest // 3 + 1)
        points = np.maximum(0, (n - 2 * periods) // periods + 1)
        at = 0
        while at < len(periods):
            total = np.cumsum(points[at:])
            stop = at + max(1, int(np.searchsorted(total, BLOCK, "right")))
            some = points[at:stop]
            q = np.repeat(periods[at:stop], some)
            first = np.repeat(np.cumsum(some) - some, some)
            yield q, (np.arange(len(q)) - first) * q
            at = stop

    def reach(self, q: np.ndarray, at: np.ndarray, back: bool) -> np.ndarray:
        """How many words in a row equal those q further on, from `at` on or before it: a binary search
        over all pairs at once."""
        low = np.zeros(len(q), np.int64)
        high = at.copy() if back else len(self.ids) - q - at
        while (low < high).any():
            mid = (low + high + 1) // 2
            good = self.equal(at - mid if back else at, q, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low

    def found(self) -> np.ndarray:
        """start, end, period of each run, once."""
        kept = [np.zeros((0, 3), np.int64)]
        for q, at in self.pairs():
            near = self.ids[at] == self.ids[at + q]
            q, at = q[near], at[near]
            near = self.equal(at, q, q)
            q, at = q[near], at[near]
            start, end = at - self.reach(q, at, True), at + q + self.reach(q, at, False)
            long = end - start >= np.maximum(self.least, 3 * q)
            kept.append(np.unique(np.stack((start[long], end[long], q[long]), 1), axis=0))
        all_runs = np.concatenate(kept)
        order = np.lexsort((all_runs[:, 2], all_runs[:, 1], all_runs[:, 0]))
        all_runs = all_runs[order]
        first = np.ones(len(all_runs), bool)
        first[1:] = (all_runs[1:, :2] != all_runs[:-1, :2]).any(1)
        return all_runs[first]

    def true(self, found: np.ndarray) -> bool:
        """Whether the words bear out every run; that none ends too soon is sure."""
        return all(np.array_equal(self.ids[a : z - q], self.ids[a + q : z]) for a, z, q in found.tolist())

    def plain(self) -> np.ndarray:
        """The same by comparing words, period by period: for the case that hashes have failed."""
        kept = {}
        for q in range(1, int(self.sizes.max(initial=0)) // 3 + 1):
            same = np.concatenate(([0], (self.ids[:-q] == self.ids[q:]).astype(np.int8), [0]))
            starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1) + q
            long = ends - starts >= max(self.least, 3 * q)
            for a, z in zip(starts[long].tolist(), ends[long].tolist()):
                kept.setdefault((a, z), q)
        return np.array(sorted((a, z, q) for (a, z), q in kept.items()), np.int64).reshape(-1, 3)


def periodic(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Of each text its runs as rows (start, length, period), by start, then period."""
    grid = Grid(texts, least)
    found = grid.found()
    if not grid.true(found):
        found = grid.plain()
    owner = np.searchsorted(grid.starts, found[:, 0], "right") - 1
    rows = np.stack((found[:, 0] - grid.starts[owner], found[:, 1] - found[:, 0], found[:, 2]), 1)
    rows, owner = rows[o := np.lexsort((rows[:, 2], rows[:, 0], owner))], owner[o]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[a:z] for a, z in zip(cuts[:-1], cuts[1:])]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words are left when each run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def best(found: np.ndarray) -> tuple[int, int, int, int] | None:
    """start, length, period and floor(1000 length / period) of the run with the greatest exact ratio."""
    if not len(found):
        return None
    most = max(found.tolist(), key=lambda r: (_Ratio(r[1], r[2]), -r[0], -r[2]))
    return most[0], most[1], most[2], 1000 * most[1] // most[2]


class _Ratio:
    """Compared by cross-multiplication, without rounding."""

    def __init__(self, over: int, under: int):
        self.over, self.under = over, under

    def __lt__(self, other: _Ratio) -> bool:
        return self.over * other.under < other.over * self.under

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Ratio) and self.over * other.under == other.over * self.under


def planted(ids: np.ndarray, key: str | None) -> np.ndarray:
    """Where the words of a text come from: a tenth of all keys makes the tail of a text periodic. A row without
    a key keeps its words."""
    n = len(ids)
    h = zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not n:
        return np.arange(n)
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _pass(docs: DataFrame, kinds: T.StructType, make: Callable, at: int) -> DataFrame:
    name = docs.columns[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name):
            texts = [words(t) for t in batch.column(at).to_pylist()]
            yield make(batch, texts)

    return docs.mapInArrow(run, kinds)


def runs(docs: DataFrame, id_col="doc_id", text_col="text", least: int = LEAST, plant: bool = False) -> DataFrame:
    """doc_id, n_words, n_runs, the run of the highest exponent (start, length, period, exponent_milli), runs (all, as
    structs), digests of the runs and of the words that `collapse` leaves. With plant, texts are changed first by `planted`."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", "text", F.col("doc_id").cast("string").alias("key"))
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    whole = [("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
    last = [("runs", pa.list_(one)), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]

    def make(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        ids = numbers(texts)
        if plant:
            source = [planted(i, k) for i, k in zip(ids, batch.column(2).to_pylist(), strict=True)]
            ids = [i[s] for i, s in zip(ids, source)]
            texts = [[ws[j] for j in s.tolist()] if len(ws) else ws for ws, s in zip(texts, source)]
        out = []
        for ws, found in zip(texts, periodic(ids, least), strict=True):
            left = ws if not len(found) else [w for w, keep in zip(ws, kept_words(len(ws), found).tolist()) if keep]
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
            listed = [{"start": s, "length": n, "period": q} for s, n, q in found.tolist()]
            out.append((len(ws), len(found), *(best(found) or (None,) * 4), listed, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
        return arrow_batch([batch.column(0), *map(list, zip(*out))], pa.schema([("doc_id", batch.column(0).type), *whole, *last]))

    kinds = [rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n, _ in whole)]
    kinds.append(T.StructField("runs", T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in one]))))
    kinds += [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
    return _pass(rows, T.StructType(kinds), make, 1)


def collapse(docs: DataFrame, text_col="text", n_chars_col: str | None = "n_chars", least: int = LEAST) -> DataFrame:
    """docs, with texts cut to the first period of each run: their words are joined by one space. Texts without
    runs stay as they are to the last blank. n_chars, if it is a column of whole numbers, is set anew with the text."""
    safe, at, size = numbered(docs), position(docs, text_col), count_position(docs, n_chars_col)

    def make(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        old = batch.column(at).to_pylist()
        new = [t if not len(found) else b" ".join(w for w, keep in zip(ws, kept_words(len(ws), found).tolist()) if keep).decode() for t, ws, found in zip(old, texts, periodic(numbers(texts), least), strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(new, columns[at].type)
        if size is not None:
            was = columns[size].to_pylist()
            columns[size] = pa.array([c if a is b else len(b) for a, b, c in zip(old, new, was, strict=True)], columns[size].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return _pass(safe, safe.schema, make, at).toDF(*docs.columns)
