"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed subwords (byte n-grams of two to four
within words, word ends marked by blanks). Embeddings and softmax are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows. Because the
softmax is linear, embedding and projection fold into one table of a score per bucket and
language before the corpus is scored. A temperature fitted on rows kept aside calibrates the
probabilities; a row whose best calibrated probability lies below `min_confidence` is rejected.

Defined results: a null text, or one without any letter (Unicode's categories L), is `und` with score
0.0, rejected. Of languages that score alike the first by name is taken.
With no labelled row at all every text is `und`; an empty table has an empty result. A null doc_id is scored but never learned
from and never held out. Repeated rows are scored alike. Extra columns are ignored by
`predict` and kept by `keep_confident`. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import arrow_batch, numbered, pick, position, slices

LETTER = regex.compile(r"\p{L}")
GAP = b"    "  # between texts: no n-gram that counts spans it
STEP = 1 << 18


@dataclass(frozen=True)
class Settings:
    """max_docs bounds the rows learned from, whatever the corpus holds; buckets and dim
    bound the model."""

    max_docs: int = 3000
    buckets: int = 1 << 15
    dim: int = 16
    steps: int = 2000
    rate: float = 4.0
    batch: int = 16
    kept_aside: float = 0.25
    min_confidence: float = 0.4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # one row per bucket and a row of zeros for what does not count
    bias: np.ndarray
    temperature: float
    settings: Settings


def _byte_map() -> bytes:
    out = bytearray(b" " * 256)
    for b in range(256):
        if 65 <= b <= 90:
            out[b] = b + 32
        elif 97 <= b <= 122 or b >= 128:
            out[b] = b
    return bytes(out)


BYTES = _byte_map()


def _buckets(a: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of each n-gram that starts in a[:len(a) - 3]; `buckets` for those that span
    words or hold no letter."""
    m = len(a) - 3
    x = a.astype(np.uint32)
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ x[k : k + m]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h &= np.uint32(buckets - 1)
    blank = a == 32
    if n == 2:
        out = blank[:m] & blank[1 : 1 + m]
    else:
        out = blank[1 : 1 + m].copy()
        for k in range(2, n - 1):
            out |= blank[k : k + m]
    h[out] = buckets
    return h


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, blanks between, and where each begins."""
    parts = [t.translate(BYTES) for t in texts]
    starts = np.cumsum([0] + [len(p) + 1 + len(GAP) for p in parts[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)
    return np.frombuffer(b" " + (GAP + b" ").join(parts) + GAP, np.uint8), starts


def counts_of(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and how often each occurs."""
    a, _ = _joined([text.encode()])
    total = np.zeros(buckets + 1, np.int64)
    for at in range(0, len(a) - 3, STEP):
        for n in (2, 3, 4):
            total += np.bincount(_buckets(a[at : at + STEP + 3], n, buckets), minlength=buckets + 1)
    ids = np.nonzero(total[:-1])[0]
    return ids, total[ids]


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Calibrated probabilities, a row per text."""
    a, starts = _joined(texts)
    sums = np.zeros((len(texts), len(model.langs)), np.float64)
    seen = np.zeros(len(texts), np.int64)
    for at in range(0, len(a) - 3, STEP):
        seg = a[at : at + STEP + 3]
        first = int(np.searchsorted(starts, at, "right")) - 1
        last = int(np.searchsorted(starts, at + len(seg) - 3, "left"))
        cuts = np.maximum(starts[first:last] - at, 0)
        for n in (2, 3, 4):
            h = _buckets(seg, n, model.settings.buckets)
            sums[first:last] += np.add.reduceat(model.table[h], cuts, axis=0)
            seen[first:last] += np.add.reduceat((h != model.settings.buckets).astype(np.int64), cuts)
    return _softmax((sums / np.maximum(seen, 1)[:, None] + model.bias) / model.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], s: Settings) -> Model | None:
    """rows: language, buckets, counts. They are sorted first, so that the order in which
    Spark delivers them does not matter."""
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    langs = tuple(sorted({r[0] for r in rows}))
    if not langs:
        return None
    rng = np.random.default_rng(s.seed)
    y = np.array([langs.index(r[0]) for r in rows])
    x = [(r[1], (r[2] / r[2].sum()).astype(np.float32)) for r in rows]
    order = rng.permutation(len(rows))
    aside = order[: int(len(rows) * s.kept_aside)] if len(rows) >= 40 else order[:0]
    train = order[len(aside) :]
    emb = rng.normal(0, 0.3, (s.buckets, s.dim)).astype(np.float32)
    w, b = np.zeros((s.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = max(1, -(-s.steps * s.batch // len(train)))  # as many steps, however few the rows
    for epoch in range(epochs):
        rate = s.rate * (1 - epoch / epochs)
        rng.shuffle(train)
        for i in range(0, len(train), s.batch):
            some = train[i : i + s.batch]
            mean = np.stack([x[k][1] @ emb[x[k][0]] for k in some])
            g = _softmax(mean @ w + b)
            g[np.arange(len(some)), y[some]] -= 1
            g = (g / len(some)).astype(np.float32)
            back = g @ w.T
            w -= rate * mean.T @ g
            b -= rate * g.sum(0)
            for k, d in zip(some, back, strict=True):
                emb[x[k][0]] -= rate * x[k][1][:, None] * d
    check = aside if len(aside) else train
    z = np.stack([x[k][1] @ emb[x[k][0]] for k in check]) @ w + b
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in np.geomspace(0.5, 5, 60)}
    table = np.vstack([emb @ w, np.zeros((1, len(langs)), np.float32)]).astype(np.float32)
    return Model(langs, table, b, float(min(loss, key=loss.get)), s)


def train(docs: DataFrame, eligible: Column, s: Settings = Settings(), id_col="doc_id", text_col="text", lang_col="lang") -> Model | None:
    """Learns from s.max_docs different eligible rows at most, as many of each language: those with the least hashes of doc_id and
    text. Executors turn the whole texts into counts of at most s.buckets buckets, so that what reaches the driver is bounded."""
    rows = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    rows = rows.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not per_lang:
        return None
    if len(per_lang) > 1000:
        raise ValueError(f"{len(per_lang)} languages; lang is not a language column")
    each = max(1, s.max_docs // len(per_lang))
    share = F.create_map(*[F.lit(v) for lang, n in per_lang.items() for v in (lang, min(1.0, each / n))])
    # about twice as many by their hashes alone; of these, without repeats, the first of each language
    mark = F.xxhash64("doc_id", "text", F.lit(s.seed))
    few = rows.withColumn("mark", mark).where(F.pmod("mark", F.lit(1 << 30)) < 2 * share[F.col("lang")] * (1 << 30))
    few = few.groupBy("lang", "mark").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 30)), "mark")
    sampled = few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(lang, *counts_of(t, s.buckets)) for lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if LETTER.search(t)]
            yield arrow_batch([[f[0] for f in found], [f[1].astype(np.int32).tobytes() for f in found], [f[2].astype(np.int32).tobytes() for f in found]], schema)

    got = sampled.mapInArrow(count, "lang string, ids binary, counts binary").collect()
    return fit([(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int32)) for r in got], s)


def judge(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and calibrated probability of each text."""
    langs, probs = ["und"] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
    if some:
        p = scores([texts[i].encode() for i in some], model)
        for i, k, v in zip(some, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            langs[i], probs[i] = model.langs[k], v
    return langs, probs


def predict(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score, accepted; the model goes out as a broadcast whose size is
    (buckets + 1) x languages x 4 bytes."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.from_numpy_dtype("int64")), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    least = model.settings.min_confidence if model else 1.0
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, probs = judge(batch.column(1).to_pylist(), held.value)
            fields = schema.set(0, pa.field("doc_id", batch.column(0).type))
            yield arrow_batch([batch.column(0), langs, probs, [p >= least and x != "und" for p, x in zip(probs, langs, strict=True)]], fields)

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def keep_confident(docs: DataFrame, model: Model | None, text_col="text") -> DataFrame:
    """The rows of docs, all columns, whose language is accepted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    least = model.settings.min_confidence if model else 1.0
    at, rows = position(docs, text_col), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            langs, probs = judge(part.column(at).to_pylist(), held.value)
            yield part.filter(pa.array([p >= least and x != "und" for p, x in zip(probs, langs, strict=True)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def may_learn(id_col: str = "doc_id") -> Column:
    """Rows outside the held-out third: crc32(doc_id as text) mod 3 is not 1."""
    return F.coalesce(remainder(id_col) != 1, F.lit(False))
