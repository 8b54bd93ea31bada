"""Chinese word segmentation: of all ways to cut a run of characters, the likeliest by the words' frequencies.

A lexicon maps words to frequencies. Characters that no word covers are words of their own, less likely than
any known one; neighbours among these are taken together and give overlapping pairs, so that unknown
words are found by their parts; or, where a `Positions` model is given, by the likeliest places of its word
boundaries. ASCII letters and digits form words, other characters stand alone. The lexicon is small by nature (`MAX_WORDS`)
and goes to executors once, as a broadcast. `operators.lexicon` learns both from a corpus.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS_ZH
from corvane.operators.hybrid import LOCATION_TERMS

MAX_WORDS = 1_000_000
FREQUENCY = 10  # of a word that comes without one
PIECE = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*|[㐀-䶿一-鿿〇豈-﫿]+|\S")
HAN_RUN = "[㐀-䶿一-鿿〇豈-﫿]+"
#: Bytes of texts that are Python's values at a time, about.
SLICE_BYTES = 1 << 20
#: Of a character in a word: first, inner, last, alone.
STATES = "BMES"
HAN = re.compile(r"[㐀-䶿一-鿿〇豈-﫿]")


def _read(lines: Iterable[str]) -> dict[str, int]:
    rows = (x.split() for x in lines if x.strip() and not x.startswith("#"))
    return {r[0]: int(r[1]) for r in rows}


#: The lexicon that comes with the engine, terms for places, and the Chinese stop words.
DEFAULT = {**dict.fromkeys((*LOCATION_TERMS, *STOP_WORDS_ZH), 2 * FREQUENCY), **_read(pkgutil.get_data("corvane.functions", "lexicon.txt").decode().splitlines())}


class Positions:
    """A hidden Markov model of characters' places in words. Runs are decoded many at a time: a step of the Viterbi algorithm is
    taken for all of them at once."""

    def __init__(self, emit: dict[str, np.ndarray], other: np.ndarray, step: np.ndarray, start: np.ndarray):
        """Log probabilities by state; other: of characters that are not known."""
        self.emit, self.other, self.step, self.start = emit, other, step, start

    @classmethod
    def of(cls, emit: Mapping[str, Iterable[int]], step: np.ndarray, start: np.ndarray) -> Positions:
        """Of counts; one is added to each of a character. Steps that words do not have (B to B, say) stay impossible."""
        rows = {c: np.array(list(n), float) for c, n in emit.items()}
        total = sum(rows.values(), np.zeros(4)) + len(rows) + 1
        may = np.array([[0, 1, 1, 0], [0, 1, 1, 0], [1, 0, 0, 1], [1, 0, 0, 1]], float)
        with np.errstate(divide="ignore"):
            steps = (np.asarray(step, float) + 1) * may
            begin = (np.asarray(start, float) + 1) * np.array([1, 0, 0, 1.0])
            return cls({c: np.log((n + 1) / total) for c, n in rows.items()}, np.log(1 / total), np.log(steps / steps.sum(1, keepdims=True)), np.log(begin / begin.sum()))

    def states(self, runs: list[str]) -> list[str]:
        """The likeliest states of each run's characters; a run ends with E or S. Of equals the first in the order B, M, E, S."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        longest = len(runs[order[0]]) if runs else 0
        if not longest:
            return [""] * len(runs)
        counts = np.array([len(runs[i]) for i in order])
        score = np.zeros((len(runs), 4))
        back = np.zeros((longest, len(runs), 4), np.int8)
        last = np.zeros((len(runs), 4))
        for t in range(longest):
            n = int((counts > t).sum())  # of the runs that have a character here
            seen = np.stack([self.emit.get(runs[i][t], self.other) for i in order[:n]])
            if t == 0:
                score[:n] = self.start + seen
            else:
                ways = score[:n, :, None] + self.step[None]
                back[t, :n] = ways.argmax(1)
                score[:n] = ways.max(1) + seen
            ends = np.flatnonzero(counts[:n] == t + 1)
            last[ends] = score[ends]
        last[:, [0, 1]] = -np.inf
        out = [""] * len(runs)
        for k, i in enumerate(order):
            if counts[k]:
                path = [int(last[k].argmax())]
                for t in range(counts[k] - 1, 0, -1):
                    path.append(int(back[t, k, path[-1]]))
                out[i] = "".join(STATES[s] for s in reversed(path))
        return out

    def cut(self, runs: list[str]) -> list[list[str]]:
        """The words of each run."""
        return [re.findall(r".", run, re.DOTALL) if not states else [run[m.start() : m.end()] for m in re.finditer(r"S|BM*E", states)] for run, states in zip(runs, self.states(runs))]


class Cutter:
    """Segmentation by one lexicon: a mapping to frequencies, or words alone; unknown runs by a model, or as pairs."""

    def __init__(self, words: Mapping[str, int] | Iterable[str], model: Positions | None = None):
        self.model = model
        known = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, FREQUENCY)
        if len(known) > MAX_WORDS:
            raise ValueError(f"a lexicon of over {MAX_WORDS} words")
        total = math.log(sum(max(1, n) for n in known.values()) + 1)
        self.weight = {w: math.log(max(1, n)) - total for w, n in known.items() if w}
        self.unknown = -total - 1
        self.longest = max(map(len, self.weight), default=1)

    def likeliest(self, run: str) -> list[str]:
        """The cut whose words' log probabilities sum highest; of equals that with the longest first word."""
        n = len(run)
        best, size = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            best[i] = self.weight.get(run[i], self.unknown) + best[i + 1]
            for k in range(2, min(self.longest, n - i) + 1):
                w = self.weight.get(run[i : i + k])
                if w is not None and w + best[i + k] >= best[i]:
                    best[i], size[i] = w + best[i + k], k
        out, i = [], 0
        while i < n:
            out.append(run[i : i + size[i]])
            i += size[i]
        return out

    def __call__(self, text: str | None) -> list[str]:
        return self.many([text])[0]

    def many(self, texts: Iterable[str | None]) -> list[list[str]]:
        """The words of each text; unknown runs of all are cut together."""
        found, loose = [self._parts(t) for t in texts], []
        for parts in found:
            loose += [p for p in parts if isinstance(p, list)]
        cuts = iter(self.model.cut([p[0] for p in loose]) if self.model else [[p[0][i : i + 2] for i in range(len(p[0]) - 1)] or [p[0]] for p in loose])
        return [[w for p in parts for w in (next(cuts) if isinstance(p, list) else (p,))] for parts in found]

    def _parts(self, text: str | None) -> list[str | list[str]]:
        """Words, and unknown runs as lists of one."""
        out: list[str | list[str]] = []
        for m in PIECE.finditer(text or ""):
            if not HAN.match(m[0]):
                out.append(m[0])
                continue
            loose = ""
            for w in (*self.likeliest(m[0]), ""):
                if w and w not in self.weight:
                    loose += w
                    continue
                if loose:
                    out.append([loose])
                    loose = ""
                if w:
                    out.append(w)
        return out


@lru_cache(1)
def _default() -> Cutter:
    return Cutter(DEFAULT)


def cut(text: str | None, words: Mapping[str, int] | Iterable[str] | None = None) -> list[str]:
    return (_default() if words is None else Cutter(words))(text)


def segmented(text: Column, words: Mapping[str, int] | Iterable[str] = DEFAULT, model: Positions | None = None) -> Column:
    """Words of each text, as an Arrow function. The lexicon goes out as a broadcast; each worker keeps one cutter."""
    spark = SparkSession.getActiveSession()
    held = spark.sparkContext.broadcast(Cutter(words, model))

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, held.value.many, pa.list_(pa.string()))

    return run(text)


def in_slices(values: pa.Array, make: Callable[[list], Sequence], kind: pa.DataType, limit: int = SLICE_BYTES) -> pa.Array:
    """What make gives for values, of which about `limit` bytes (or one) are taken at a time: of a batch, whatever its size, no more than a slice
    and what is made of it are Python's values at once."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, parts = 0, []
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
        parts.append(pa.array(list(make(values.slice(at, to - at).to_pylist())), kind))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def user_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, freq, tag of a file's lines."""
    return lexicon_lines(spark.read.text(path))


def lexicon_lines(lines: DataFrame) -> DataFrame:
    """lines: value. word, freq, tag of lines `word [freq] [tag]`; blank lines and those with # are left out.
    The number of rows is the number of entries."""
    own = lines.select(F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "").alias("l")).where("l <> '' and not startswith(l, '#')")
    part = F.split("l", r"[ \t]+")
    return own.select(part[0].alias("word"), F.coalesce(F.get(part, 1).try_cast("int"), F.lit(FREQUENCY)).alias("freq"), F.coalesce(F.get(part, 2), F.lit("l")).alias("tag"))


def with_user_words(lexicon: DataFrame, words: Mapping[str, int] | Iterable[str] = DEFAULT) -> dict[str, int]:
    """words with the entries of `user_lexicon`, which take the place of known ones."""
    found = lexicon.groupBy("word").agg(F.max("freq").alias("freq")).limit(MAX_WORDS + 1).collect()
    known = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, FREQUENCY)
    if len(found) + len(known) > MAX_WORDS:
        raise ValueError(f"a lexicon of over {MAX_WORDS} words")
    return known | {r.word: r.freq for r in found}
