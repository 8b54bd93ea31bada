import hashlib
import random
import re

import pytest

from corvane.llm import decontaminate as D
from corvane.sources import shared as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    hit.update(range(p, p + n))
                    who |= found
        out.append((d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def generated(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(rng.choice([2, 5, 40]))] + ["É", "ß1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(None, text(12)), (3, text(15)), (50, None), (51, "..."), (52, text(5000))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(20)] + [(None, None), (70, ""), (71, "!!!")]
    for i, t in items:
        docs.append((100 + (i or 0), text(5) + " " + (t or "").upper().replace(" ", "\n--") + " " + text(5)))
    return docs + docs[:3], items


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block_words", [400_000, 3000])
def test_equals_brute_force(spark, seed, block_words):
    docs, items = generated(seed)
    d, b = tables(spark, docs, items)
    got = D.hits(d, b, block_words=block_words).drop("longest").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def test_long_items_without_short_ones(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(40))) for i in range(20)]
    docs = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(300)) + " " + items[i][1][: 20 + 9 * i]) for i in range(20)]
    assert sorted(map(tuple, D.hits(*tables(spark, docs, items)).drop("longest").collect()), key=repr) == brute(docs, items)


def test_empty_tables_and_extra_columns(spark):
    d, b = tables(spark, [(1, "a b c")], [(1, "a b c")])
    assert [tuple(r)[1:4] for r in D.hits(d, b.limit(0)).collect()] == [(3, 0, 0)]
    assert D.hits(d.limit(0), b).collect() == []
    more = D.hits(d.selectExpr("*", "1 n_hit", "2 as words"), b.selectExpr("*", "3 doc_id"))
    assert [tuple(r)[1:4] for r in more.collect()] == [(3, 3, 1)]


def test_clean_removes_spans_and_drops_what_is_mostly_benchmark(spark):
    item = " ".join(f"q{i}" for i in range(12))
    filler = " ".join(f"f{i}" for i in range(30))
    docs = [(1, f"{filler}, {item.upper()}! End é."), (2, item), (3, filler), (4, None), (5, "")]
    d, b = tables(spark, docs, [(1, item)])
    df = d.selectExpr("doc_id", "text", "length(text) as n_chars", "'x' as lang")
    got = {r.doc_id: r for r in D.clean(df, b).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].text == f"{filler}, ! End é." and got[1].n_chars == len(got[1].text) and got[3].text == filler and got[4].text is None
    assert {r.n_hit for r in D.hits(D.clean(df, b), b).collect()} == {0}
    assert set(r.doc_id for r in D.clean(df, b, max_coverage=1.0).collect()) == {1, 2, 3, 4, 5}


def test_repeated_items_and_blocks_one_at_a_time(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, text(200)) for i in range(40)]
    docs = [(i, f"{text(20)} {items[i][1] if i % 2 else text(60)} {text(150)} {items[-i][1][:90]}") for i in range(20)]
    d, b = tables(spark, docs, items + items[:1] * 400)
    assert D.pieces_of(b, block_words=3000)[1] == 4  # 8,000 words of different items
    want = brute(docs, items)
    assert sorted(map(tuple, D.hits(d, b, block_words=3000).drop("longest").collect()), key=repr) == want
    df = d.selectExpr("doc_id", "text", "length(text) as n_chars", "'x' as lang")
    one, more = (sorted(map(tuple, D.clean(df, b, block_words=k).collect())) for k in (400_000, 3000))
    assert one == more and 0 < len(one) < len(docs)


@pytest.mark.parametrize("blocks", [1, 20])
def test_blocks_read_few_documents_and_find_the_same(spark, blocks):
    """Many documents, few of which hold a passage; what is written aside follows these, not the corpus."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(40))) for i in range(100)] + [(200, "short item of five words"), (201, None)]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(400)] + [(None, None), (500, "")]
    for k in range(0, 400, 40):
        docs[k] = (k, docs[k][1] + " " + " ".join(items[k // 40][1].split()[5:25]) + " " + docs[k][1])
    docs[7] = (7, docs[7][1] + " Short item, of five words!")
    d, b = tables(spark, docs, items)
    size = 400_000 if blocks == 1 else 4 * 4000 // (3 * blocks)
    before = S.shared_paths()
    got = D.hits(d, b, block_words=size)
    assert sorted(map(tuple, got.drop("longest").collect()), key=repr) == brute(docs, items)
    if blocks > 1:
        aside = [spark.read.parquet(p).count() for p in S.shared_paths() - before if "decontaminate" in p]
        assert aside and max(aside) <= 13
    cleaned = {r.doc_id: r.text for r in D.clean(d, b, block_words=size).collect()}
    whole = {r.doc_id: r.text for r in D.clean(d, b).collect()}
    assert cleaned == whole and len(cleaned) == len({x for x, _ in docs})


def test_the_screen_lets_every_window_pass(spark):
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 4, 9, 10, 30])))) for i in range(60)]
    pieces, _ = D.pieces_of(tables(spark, [(1, "x")], items)[1])
    screen = D.screen_of(pieces, 10)
    for _, t in items:
        w = t.split()
        n = min(10, len(w))
        assert all(screen.passes("start " + " ".join(w[p : p + n]).upper() + " end") for p in range(len(w) - n + 1))
    assert not screen.passes(None) and not screen.passes("") and not screen.passes(" ".join(f"v{i}" for i in range(50)))
