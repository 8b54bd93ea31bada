"""Learned segmentation: counts, Viterbi against all paths, expectations against all cuts, likelihood, F1 on held-out text."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.segment import DEFAULT, STATES, Cutter, Positions, segmented
from corvane.functions.text import word_tokens
from corvane.operators import lexicon as L
from corvane.plans.engine import Engine, Settings

DATA = "/root/testdata/sf0.01"


def model(seed=0):
    rng = np.random.default_rng(seed)
    return Positions.of({c: rng.integers(0, 9, 4) for c in "abcde"}, rng.integers(0, 9, (4, 4)), rng.integers(0, 9, 4))


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_all_paths(seed):
    m, rng = model(seed), random.Random(seed)
    runs = ["".join(rng.choices("abcdex", k=rng.randrange(0, 7))) for _ in range(40)] + ["a", "", "x" * 6]
    for run, got in zip(runs, m.states(runs)):
        if not run:
            assert got == ""
            continue

        def score(path):
            total = m.start[path[0]]
            for i, s in enumerate(path):
                total += m.emit.get(run[i], m.other)[s] + (m.step[path[i - 1], s] if i else 0)
            return total

        best = max(score(p) for p in itertools.product(range(4), repeat=len(run)) if p[-1] > 1)
        assert score([STATES.index(s) for s in got]) == pytest.approx(best) and best > -math.inf
    cut = m.cut(runs)
    assert ["".join(c) for c in cut] == runs and m.states([]) == [] and m.states(["", ""]) == ["", ""]
    assert m.cut(["ab" * 5000])[0] and m.cut(runs) == [m.cut([r])[0] for r in runs]


def test_position_counts(spark):
    rows = spark.createDataFrame([(["ab", "c", "defg"],), ([],), (None,), (["", "x"],), (["yz"],)], "w array<string>")
    got = {(r.kind, r.state, r.symbol): r.n for r in L.position_counts(rows, F.col("w")).collect()}
    assert {k: n for k, n in got.items() if k[0] == "step"} == {("step", *p): 1 for p in ("ES", "SB", "BM", "MM", "ME")} | {("step", "B", "E"): 2}
    assert {k: n for k, n in got.items() if k[0] == "start"} == {("start", "B", ""): 2, ("start", "S", ""): 1}
    assert got["emit", "M", "e"] == got["emit", "S", "x"] == got["emit", "E", "z"] == 1 and sum(n for k, n in got.items() if k[0] == "emit") == 10


def f1(got, want):
    def spans(words):
        ends = np.cumsum([len(w) for w in words])
        return set(zip([0, *ends[:-1].tolist()], ends.tolist()))

    hits = sum(len(spans(g) & spans(w)) for g, w in zip(got, want))
    return 2 * hits / (sum(map(len, got)) + sum(map(len, want)))


HAN = {ord(c): chr(0x4E00 + i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def test_words_of_held_out_text_are_found(spark):
    """Texts in which blanks stand between words, learned from two thirds, and cut without their blanks in the last. Letters stand for
    Han characters; there are few of them, so their places alone tell little, and much together with the words that are known."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'").select("doc_id", word_tokens(F.lower("text")).alias("w"))
    rows = docs.where("doc_id % 3 > 0").select(F.filter("w", lambda w: w.rlike("^[a-z0-9]+$")).alias("w"))
    han = lambda w: w.translate(HAN)
    counts = L.position_counts(rows.select(F.transform("w", lambda w: F.translate(w, "".join(map(chr, HAN)), "".join(HAN.values()))).alias("w")), F.col("w"))
    learned = L.positions(counts)
    known = {han(r.w): r["count"] for r in rows.select(F.explode("w").alias("w")).groupBy("w").count().collect()}
    held = [[han(w) for w in r.w if w.isascii()] for r in docs.where("doc_id % 3 = 0").collect()]
    held = [h[:60] for h in held if h]
    runs = ["".join(h) for h in held]
    pairs = f1([[r[i : i + 2] for i in range(0, len(r), 2)] for r in runs], held)
    alone = f1(learned.cut(runs), held)
    both, without = (f1(Cutter(known, m).many(runs), held) for m in (learned, None))
    print(f"F1: pairs {pairs:.3f}, places alone {alone:.3f}, words and pairs {without:.3f}, words and places {both:.3f}")
    assert alone > 2 * pairs and both > 0.5 and both >= without


def test_unknown_runs_go_to_the_model(spark):
    counts = spark.createDataFrame([(["甲乙", "丙丁戊", "己"] * 5,)], "w array<string>")
    learned = L.positions(L.position_counts(counts, F.col("w")))
    text = "原告甲乙丙丁戊己人民法院。x1"
    assert Cutter(DEFAULT, learned)(text) == ["原告", "甲乙", "丙丁戊", "己", "人民法院", "。", "x1"]
    assert Cutter(DEFAULT)(text)[1:3] == ["甲乙", "乙丙"]
    rows = spark.createDataFrame([(0, text), (1, None), (2, "")], "i int, t string").repartition(1)
    got = {r.i: r.w for r in rows.select("i", segmented(F.col("t"), DEFAULT, learned).alias("w")).collect()}
    assert got == {0: Cutter(DEFAULT, learned)(text), 1: [], 2: []}
    e = Engine(spark, Settings(lexicon=DEFAULT, positions=learned)).add(spark.createDataFrame([("a", text), ("b", "丙丁")], "doc_id string, text string"))
    assert e.search("丙丁戊").first().doc_id == "a"


def cuts(run):
    for marks in itertools.product((0, 1), repeat=len(run) - 1):
        out, at = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                out.append(run[at:i])
                at = i
        yield [*out, run[at:]]


def test_expectations_equal_all_cuts():
    weight = {w: math.log(p) for w, p in {"a": 0.2, "b": 0.3, "ab": 0.2, "ba": 0.1, "aba": 0.2}.items()}
    for run in ("a", "ab", "abab", "abaab", "bbabaab"):
        total, uses = 0.0, Counter()
        for cut in cuts(run):
            if all(w in weight for w in cut):
                p = math.exp(sum(weight[w] for w in cut))
                total += p
                for w in cut:
                    uses[w] += p
        like, got = L.expected(run, weight, 3)
        assert like == pytest.approx(math.log(total)) and got == pytest.approx({w: p / total for w, p in uses.items()})
    assert L.expected("ax", weight, 3) == (-math.inf, {})


def test_lexicon_from_texts_without_blanks(spark):
    rng = random.Random(2)
    chars = [chr(0x4E00 + i) for i in range(60)]
    words = ["".join(rng.sample(chars, rng.choice([2, 2, 3]))) for _ in range(40)] + chars[:6]
    texts = ["".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(3, 12))) + "。" for _ in range(1500)]
    runs = L.runs(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("abc",)], "text string").repartition(3))
    found = L.candidates(runs, longest=4, cohesion=0.5, branching=0.5)
    own = {r.word for r in found.collect()}
    assert {w for w in words[:20]} <= own
    learned, told = L.refine(runs, found, rounds=5)
    assert all(b >= a - 1e-6 for a, b in zip(told, told[1:])) and told[-1] > told[0]
    assert all(c in learned for c in set("".join(words)))
    top = sorted((w for w in learned if len(w) > 1), key=learned.get)[-15:]
    assert len(set(top) & set(words)) >= 13
    # the cut of held-out text is better than by single characters
    held = [rng.choices(words, k=8) for _ in range(200)]
    cutter = Cutter(learned)
    assert f1([cutter("".join(h)) for h in held], held) > 0.7


def test_nothing_to_learn_from(spark):
    runs = L.runs(spark.createDataFrame([(None,), ("abc",)], "text string"))
    assert L.candidates(runs).collect() == [] and L.refine(runs, L.candidates(runs), 2) == ({}, [0.0, 0.0])
    empty = L.positions(L.position_counts(spark.createDataFrame([], "w array<string>"), F.col("w")))
    assert empty.cut(["ab", ""]) in ([["ab"], []], [["a", "b"], []])


def test_an_engine_learns_words_of_its_documents(spark):
    rng = random.Random(5)
    chars = [chr(0x5000 + i) for i in range(80)]
    words = ["".join(rng.sample(chars, rng.choice([2, 3]))) for _ in range(30)]
    docs = [(f"d{i}", "。".join("".join(rng.choices(words, k=6)) for _ in range(8))) for i in range(60)]
    e = Engine(spark, Settings(lexicon=DEFAULT))
    assert e.learn_words() == 0
    table = spark.createDataFrame(docs, "doc_id string, text string")
    e.add(table)
    before = {r.term for r in e.index.postings.select("term").distinct().collect()}
    n = e.learn_words(cohesion=0.5, branching=0.5)
    assert n >= 25 and len(set(words) & set(e.settings.lexicon)) >= 25 and set(DEFAULT) <= set(e.settings.lexicon)
    e.add(table)
    after = {r.term for r in e.index.postings.select("term").distinct().collect()}
    assert len(after & set(words)) > len(before & set(words)) and len(after & set(words)) >= 25
    asked = docs[7][1].split("。")[0]
    assert any(r.doc_id == "d7" for r in e.search(asked, 5).collect())


def test_words_and_positions_are_taken_in_slices(monkeypatch):
    import pyarrow as pa

    from corvane.functions.segment import in_slices
    from corvane.operators import lexicon

    seen = []
    got = in_slices(pa.array(["abc", None, "de", "f" * 50, "", "g"]), lambda some: seen.append(sum(len(t or "") for t in some)) or [[t or ""] for t in some], pa.list_(pa.string()), 6)
    assert got.to_pylist() == [["abc"], [""], ["de"], ["f" * 50], [""], ["g"]] and len(seen) > 2 and sorted(seen)[-2] <= 6
    codes, n = lexicon._position_codes(pa.array([["中文😀", "", None, "x"], [], None, ["中文"]]))
    kinds = codes >> 26
    assert (n[kinds == 0].sum(), n[kinds == 1].sum(), n[kinds == 2].sum()) == (6, 4, 2)


def test_equal_runs_are_one_before_they_are_cut(spark):
    from corvane.operators import lexicon

    found = lexicon.substrings(spark.createDataFrame([("原告",)] * 40, "run string"), 2)
    assert {(r.word, r.left, r.right, r.n) for r in found.collect()} == {("原", "", "告", 40), ("告", "原", "", 40), ("原告", "", "", 40)}
    assert "times" in found._jdf.queryExecution().optimizedPlan().toString()
