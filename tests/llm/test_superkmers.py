"""Substring dedup against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import superkmers as S

BLANK = " \t\n\v\f\r"


def split(t):
    return [x for x in "".join(" " if c in BLANK else c for c in t or "").split(" ") if x]


def kept(texts, window):
    seen = Counter()
    for t in texts:
        w = split(t)
        seen.update(tuple(w[p : p + window]) for p in range(len(w) - window + 1))
    out = []
    for t in texts:
        w, gone = split(t), set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute(rows, window=35):
    return sorted(((d, n, gone, hashlib.sha256(left.encode()).hexdigest()) for (d, _), (n, gone, left) in zip(rows, kept([t for _, t in rows], window))), key=repr)


def generated(seed, n=80, vocabulary=400):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["é", "中文", "x y"]
    some = lambda k: rng.choices(vocab, k=k)
    passages = [some(k) for k in (34, 35, 36, 60, 120, 8, 20)]
    rows = []
    for i in range(n):
        w = some(rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(passages) + w[at:]
        rows.append((i, "".join(x + rng.choice([" ", "\n", " \t "]) for x in w)))
    base = some(200)
    for i in range(n // 2):  # near copies
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(200)] = rng.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, rows[5][1]) for i in range(4)] + [(3000, "a " * 300), (3001, "a b " * 100), (3002, "a " * 34), (3003, "a " * 35), (None, None), (None, ""), (None, rows[7][1]), (5, rows[5][1])]
    return rows


def got(df, window=35):
    return sorted(map(tuple, S.scan(df, window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = generated(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


@pytest.mark.parametrize("seed,part,pool", [(0, 4000, 8 << 20), (1, 3, 8 << 20), (2, 3, 2000), (3, 1, 200)])
@pytest.mark.parametrize("vocabulary", [2, 400])
def test_hot_buckets(spark, monkeypatch, seed, part, pool, vocabulary):
    """Nearly every shingle hot, buckets in many parts, and pools that must be brought down in between."""
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "LEAST", 2)
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "POOL", pool)
    rows = generated(seed, 40, vocabulary)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert S.hot_slots(df.select("text"))
    assert got(df) == brute(rows)


@pytest.mark.parametrize("window", [4, 7, 100])
def test_other_windows(spark, window):
    rows = generated(4, 30, 6)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), window) == brute(rows, window)
    with pytest.raises(ValueError, match="at least"):
        S.scan(spark.createDataFrame(rows, "doc_id long, text string"), window=3)


def test_super_kmers_hold_every_window_once():
    rng = random.Random(5)
    texts = [[b"%d" % rng.randrange(9) for _ in range(rng.choice([0, 3, 34, 35, 36, 200]))] for _ in range(40)]
    hot = np.zeros(1 << S.TABLE, bool)
    hot[::2] = True
    for flags in (None, hot, ~hot):
        text, start, _, begin, end = S.super_kmers(texts, 35, flags)
        seen = Counter((t, s + i) for t, s, b, e in zip(text, start, begin, end) for i in range(e - b - 34))
        assert seen == {(t, p): 1 for t, ws in enumerate(texts) for p in range(len(ws) - 34)}
        flat = [w for ws in texts for w in ws]
        firsts = np.cumsum([0] + [len(ws) for ws in texts])
        for t, s, b, e in zip(text, start, begin, end):
            assert flat[b:e] == texts[t][s : s + e - b] and firsts[t] + s == b


def test_equal_windows_share_a_minimiser():
    rng = random.Random(6)
    passage = [b"p%d" % rng.randrange(5) for _ in range(80)]
    texts = [[b"x%d" % rng.randrange(50) for _ in range(rng.randrange(30))] + passage for _ in range(20)]
    where = {}
    text, start, value, begin, end = S.super_kmers(texts, 35)
    for t, s, v, b, e in zip(text, start, value, begin, end):
        for i in range(e - b - 34):
            where.setdefault(tuple(texts[t][s + i : s + i + 35]), set()).add(int(v))
    assert all(len(v) == 1 for v in where.values())


def test_windows_of_equal_hash_are_told_apart_by_their_words(monkeypatch):
    monkeypatch.setattr(S, "_mixed", lambda x: np.zeros(len(x), np.uint64))
    packed = [b"a b c d e", b"b c d e", b"x b c d"]
    owner, place, number = S._windows(packed, 4)
    assert owner.tolist() == [0, 0, 1, 2] and place.tolist() == [0, 1, 0, 0]
    assert number[1] == number[2] and len(set(number.tolist())) == 3


def test_known_windows_count_for_others():
    row = lambda p, known, d: (1, None, d, 0, known, p)
    rows = [row(b"a b c d e", 2, None), row(b"b c d e", None, b"x" * 12), row(b"a b c d", None, b"y" * 12)]
    table = pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), S._SCHEMA)], schema=S._SCHEMA)
    told, left = S.reduced(table, 4)
    assert sorted(told) == [(b"x" * 12, 0, 1), (b"y" * 12, 0, 1)]
    assert left.column("known").to_pylist() == [3, 1, 1]


def test_remove_keeps_other_columns(spark):
    line = " ".join(f"v{k}" for k in range(40))
    rows = [(1, f"one  two\n{line} three", 5, "x"), (2, f"{line}  four", 6, "y"), (3, "stays \n as it is", 99, "z"), (None, None, None, None), (4, "", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, Text string").select("*", F.lit(1).alias("doc_id"))
    out = S.remove(df)
    assert out.columns == ["doc_id", "text", "n_chars", "Text", "doc_id"] and out.schema["n_chars"].dataType.simpleString() == "bigint"
    want = [(1, "one two three", 13, "x", 1), (2, "four", 4, "y", 1), (3, rows[2][1], 99, "z", 1), (None, None, None, None, 1), (4, "", 0, "", 1)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(empty) == [] and S.remove(empty).collect() == []
