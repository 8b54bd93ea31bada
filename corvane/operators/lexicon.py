"""Models of words for segmentation, learned from a corpus: what a position in a word looks like, and which words there are.

`position_counts` counts, over texts that are cut into words, how often each character begins, continues, ends or is a word (states
B, M, E, S) and how often one state follows another; `positions` makes a `Positions` model of the counts, which cuts runs
that no lexicon knows.

`candidates` finds words in texts without blanks: substrings that are frequent, that hold together (the
least pointwise mutual information over their cuts in two is high) and that stand next to many different characters on either
side (branching entropy). `refine` runs rounds of expectation-maximisation for a unigram model over them: the expected number of
uses of each word over all cuts of all texts, forward and backward; each round the likelihood of the corpus does not fall. The
lexicon that comes out is what `segment.Cutter` takes.

Everything is counted by Spark over whole texts. What reaches the driver is bounded: counts by character by the alphabet, a
lexicon by `max_words`. Null and empty texts count nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.segment import HAN_RUN, MAX_WORDS, STATES, Positions

#: Characters of a candidate; occurrences it has at least.
LONGEST, LEAST = 6, 5
#: Words whose positions are counted at a time, about.
WORDS = 250_000
#: Least cohesion and branching entropy, in nats.
COHESION, BRANCHING = 2.0, 0.7


def position_counts(texts: DataFrame, words: Column) -> DataFrame:
    """kind, state, symbol, n: emit (a character in a state), step (a state after another), start (the first state of a text)."""
    rows = texts.select(words.alias("w")).where(F.size("w") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            upto = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS, "right")))
                codes, n = _position_codes(batch.column(0).slice(at, to - at))
                codes, where = np.unique(np.concatenate([seen[0], codes]), return_inverse=True)
                seen, at = (codes, np.bincount(where, np.concatenate([seen[1], n]), len(codes)).astype(np.int64)), to
        kind, state, symbol = seen[0] >> 26, seen[0] >> 24 & 3, (seen[0] & 0xFFFFFF).tolist()
        symbols = [chr(c) if k == 0 else STATES[c] if k == 1 else "" for k, c in zip(kind.tolist(), symbol, strict=True)]
        cells = [pa.array(np.array(["emit", "step", "start"])[kind]), pa.array(np.array(list(STATES))[state]), pa.array(symbols, pa.string()), pa.array(seen[1])]
        yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in cells[:3]), cells[3]], names=["kind", "state", "symbol", "n"])

    # a task tells each count once; they are bounded by the alphabet
    return rows.mapInArrow(run, "kind string, state string, symbol string, n long").groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n"))


def _position_codes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What is counted in some texts' words and how often: the kind (emit, step, start), 2 bits of the state, 24 of a character or state."""
    words, text = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    used = pc.fill_null(pc.greater(pc.binary_length(words), 0), False)
    words, text = words.filter(used), text[used.to_numpy(zero_copy_only=False)]
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    chars = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    last = np.cumsum(size) - 1
    state = np.full(len(chars), STATES.index("M"), np.int64)
    state[last - size + 1] = STATES.index("B")
    state[last] = np.where(size == 1, STATES.index("S"), STATES.index("E"))
    owner = np.repeat(text, size)
    new = owner[1:] != owner[:-1]
    first = state[np.concatenate([[True], new])]
    step = 1 << 26 | state[:-1][~new] << 24 | state[1:][~new]
    return np.unique(np.concatenate([state << 24 | chars, step, 2 << 26 | first << 24]), return_counts=True)


def positions(counts: DataFrame) -> Positions:
    """The model of `position_counts`, with one added to each count of a character."""
    emit: dict[str, list[int]] = {}
    step, start = np.zeros((4, 4)), np.zeros(4)
    for kind, state, symbol, n in counts.select("kind", "state", "symbol", "n").collect():
        if kind == "emit":
            emit.setdefault(symbol, [0] * 4)[STATES.index(state)] += n
        elif kind == "step":
            step[STATES.index(state), STATES.index(symbol)] += n
        else:
            start[STATES.index(state)] += n
    return Positions.of(emit, step, start)


def runs(texts: DataFrame, text_col: str = "text", pattern: str = HAN_RUN) -> DataFrame:
    """run: the stretches of each text in which words are looked for (Han characters; or another pattern)."""
    return texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0))).alias("run"))


def substrings(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """word, n, left, right: substrings of the runs with the characters next to them (empty at a run's ends)."""
    at = F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at")
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))).alias("size")
    # equal runs are one, with a count
    rows = found.where("run <> ''").groupBy("run").agg(F.count(F.lit(1)).alias("times")).select("run", "times", at).select("run", "times", "at", size)
    before = F.when(F.col("at") > 1, F.substring("run", F.col("at") - 1, F.lit(1))).otherwise("")
    after = F.substring("run", F.col("at") + F.col("size"), F.lit(1))
    return rows.select(F.substring("run", F.col("at"), F.col("size")).alias("word"), before.alias("left"), after.alias("right"), "times").groupBy("word", "left", "right").agg(F.sum("times").alias("n"))


def candidates(found: DataFrame, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, branching: float = BRANCHING) -> DataFrame:
    """word, n, cohesion, branching of runs: single characters (with neither), and longer substrings that pass the limits."""
    counted = substrings(found, longest)
    each = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    def entropy(side: str) -> DataFrame:
        # each end of a run is a neighbour of its own
        own = counted.groupBy("word", side).agg(F.sum("n").alias("k"))
        free = F.when(F.col(side) == "", F.col("k")).otherwise(0)
        spread = F.sum(F.when(F.col(side) == "", 0.0).otherwise(F.col("k") * F.log("k")))
        return own.groupBy("word").agg((F.log(F.sum("k")) - spread / F.sum("k")).alias(side), F.sum(free).alias(f"{side}_free"))

    total = counted.where(F.length("word") == 1).agg(F.sum("n").alias("total"))
    long = each.where(F.length("word") > 1)
    cuts = long.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("cut"))
    cuts = cuts.select("word", "n", F.substring("word", F.lit(1), F.col("cut")).alias("a"), F.substring("word", F.col("cut") + 1, F.length("word")).alias("b"))
    part = lambda name: each.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    pmi = cuts.join(part("a"), "a").join(part("b"), "b").crossJoin(F.broadcast(total)).groupBy("word").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))).alias("cohesion"))
    judged = long.join(pmi, "word").join(entropy("left"), "word").join(entropy("right"), "word").withColumn("branching", F.least("left", "right"))
    words = judged.where((F.col("cohesion") >= cohesion) & (F.col("branching") >= branching)).select("word", "n", "cohesion", "branching")
    none = F.lit(None).cast("double")
    single = counted.where(F.length("word") == 1).groupBy("word").agg(F.sum("n").alias("n"))
    return words.unionByName(single.select("word", "n", none.alias("cohesion"), none.alias("branching")))


def expected(run: str, weight: Mapping[str, float], longest: int) -> tuple[float, dict[str, float]]:
    """Log likelihood of a run, and how often each word is expected in its cuts; (-inf, {}) if no cut has words only."""
    n = len(run)
    inside = [[(k, w) for k in range(1, min(longest, n - i) + 1) if (w := weight.get(run[i : i + k])) is not None] for i in range(n)]
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    for i in range(n):
        if forward[i] > -np.inf:
            for k, w in inside[i]:
                forward[i + k] = np.logaddexp(forward[i + k], forward[i] + w)
    for i in range(n - 1, -1, -1):
        for k, w in inside[i]:
            backward[i] = np.logaddexp(backward[i], w + backward[i + k])
    if forward[n] == -np.inf:
        return -math.inf, {}
    uses: dict[str, float] = {}
    for i in range(n):
        for k, w in inside[i]:
            p = forward[i] + w + backward[i + k] - forward[n]
            if p > -40:
                uses[run[i : i + k]] = uses.get(run[i : i + k], 0.0) + math.exp(p)
    return float(forward[n]), uses


def refine(found: DataFrame, words: DataFrame, rounds: int = 4, least: float = 1.0, max_words: int = MAX_WORDS) -> tuple[dict[str, int], list[float]]:
    """words: word, n. The lexicon (words and their expected uses, rounded, 1 at least) and the corpus's log likelihood in each round.
    Words whose uses fall under `least` go after the last round, single characters never, so that every run keeps a cut."""
    first = words.orderBy(F.length("word") > 1, F.desc("n"), "word").limit(max_words).collect()
    uses = {r.word: float(r.n) for r in first}
    # equal runs are one, with a count
    runs_ = found.where("run <> ''").groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    told: list[float] = []
    for _ in range(rounds):
        total = sum(uses.values())
        held = found.sparkSession.sparkContext.broadcast({w: math.log(n / total) for w, n in uses.items() if n > 0})

        def step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            weight = held.value
            longest = max(map(len, weight), default=1)
            out: dict[str, float] = {}
            for batch in batches:
                for run, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    like, own = expected(run, weight, longest)
                    if own:
                        out[""] = out.get("", 0.0) + times * like
                    for w, n in own.items():
                        out[w] = out.get(w, 0.0) + times * n
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.float64())], names=["word", "n"])

        got = {r.word: r.n for r in runs_.mapInArrow(step, "word string, n double").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        told.append(got.pop("", 0.0))
        uses = {w: got.get(w, 0.0) for w in uses}
        held.unpersist()
    return {w: max(1, round(n)) for w, n in uses.items() if n >= least or len(w) == 1}, told
