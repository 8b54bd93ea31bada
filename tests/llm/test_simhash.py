import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import simhash as S


def brute_fp(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    fps = [brute_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return sorted(((d, fps[i], best.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 200, 400]))) for _ in range(n)]
    rows = list(enumerate(base))
    for i in range(60):
        w = base[rng.randrange(8)].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, base[3].upper()) for i in range(10)] + [(3000, ""), (3001, None), (3002, " \t\n"), (3003, " "), (None, base[5]), (None, "lonely words with no id"), (5, base[5]), (3004, "Ünï Ä x y")]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_spark_hashes_alike(spark):
    for t in ("a b c d", "ü", "", "x" * 100):
        assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(t.encode(), 42)


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.components(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


@pytest.mark.parametrize("radius", [0, 2, 4])
@pytest.mark.parametrize("tile_rows", [8, 4096])
def test_links_of_clustered_fingerprints(spark, radius, tile_rows):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, k)) for c in centres for k in range(9) for _ in range(15)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200, np.uint64)} | {0, 2**64 - 1, 1, 3, 7}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    points = spark.createDataFrame([(f,) for f in signed], "fp long")
    trees = {r.node: r.root for r in S.connected(S.links(points, len(signed), radius, tile_rows)).collect()}
    a = np.array(signed, np.int64).view(np.uint64)
    up = {f: f for f in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, f in enumerate(signed):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = root(f), root(signed[j])
            up[max(x, y)] = min(x, y)
    assert {f: trees.get(f, f) for f in signed} == {f: root(f) for f in signed}


def test_plan_finds_every_near_pair():
    """Whatever the size: two fingerprints within the radius agree on the fields of some table."""
    rng = np.random.default_rng(5)
    for n in (10, 10**7, 10**9, 10**12):
        tables = S.plan(n, 4)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(all(not diff >> s & ((1 << w) - 1) for s, w in t) for t in tables)
        assert n >> min(sum(w for _, w in t) for t in tables) <= 2000 or len(tables) >= 70


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000 + i, 500) for i in range(300)]
    got = {r.node: r.root for r in S.connected(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 500: 500, **{1000 + i: 500 for i in range(300)}}


def test_dedup_keeps_one_of_each(spark):
    rows = corpus(1)
    df = table(spark, rows).selectExpr("doc_id", "text", "'x' as fp", "1 as component_id")
    kept = S.dedup(df).collect()
    want = brute_components(rows)
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {c for _, _, c in want if c is not None}
    assert [r.text for r in kept if r.doc_id is None] == ["lonely words with no id"]
    assert kept[0].fp == "x"


def test_rows_without_ids_that_differ_all_stay(spark):
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    kept = S.dedup(table(spark, [(None, t) for t in texts + texts[:5]])).collect()
    assert sorted(r.text for r in kept) == sorted(texts)


def test_empty(spark):
    assert S.components(table(spark, []).limit(0)).collect() == [] and S.dedup(table(spark, []).limit(0)).collect() == []


def all_pairs(fps, radius):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]).sum(1) <= radius):
            up[max(root(i), root(int(j)))] = min(root(i), root(int(j)))
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("split", [None, 900])
def test_forest_of_several_blocks(split):
    """Clusters over many blocks, noise between; a tile of two sides has links between the sides only."""
    rng = np.random.default_rng(7)
    fps = [rng.integers(0, 1 << 63, 4, np.uint64) for _ in range(700)]
    for size in (1200, 40, 3):
        centre = rng.integers(0, 1 << 63, 4, np.uint64)
        for _ in range(size):
            own = centre.copy()
            for b in rng.choice(256, 24, replace=False):
                own[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
            fps.append(own)
    fps = np.array(fps)[rng.permutation(len(fps))]
    child, parent = S.forest(fps, 40, split)
    distance = np.bitwise_count(fps[child] ^ fps[parent]).sum(1)
    assert (distance <= 40).all() and (split is None or all((c < split) != (p < split) for c, p in zip(child, parent)))
    up = list(range(len(fps)))

    def root(up, i):
        while up[i] != i:
            i = up[i]
        return i

    for c, p in zip(child.tolist(), parent.tolist()):
        x, y = root(up, c), root(up, p)
        assert x != y
        up[max(x, y)] = min(x, y)
    if split is None:
        assert [root(up, i) for i in range(len(fps))] == all_pairs(fps, 40)
        return
    want = list(range(len(fps)))
    for i in range(split):
        for j in np.flatnonzero(np.bitwise_count(fps[split:] ^ fps[i]).sum(1) <= 40):
            x, y = root(want, i), root(want, split + int(j))
            want[max(x, y)] = min(x, y)
    assert [root(up, i) for i in range(len(fps))] == [root(want, i) for i in range(len(fps))]


def test_similar_sets_share_one_of_their_rarest_shingles():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 200, 1000]:
        for _ in range(20):
            counts = rng.integers(0, 50, 1 << 8)
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            out = int(rng.integers(0, len(a) // 4 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                assert len(np.intersect1d(S._rarest(a, counts, 0.8), S._rarest(b, counts, 0.8)))
    assert len(S._rarest(np.zeros(0, np.uint64), np.zeros(2), 0.8)) == 0


@pytest.mark.parametrize("tile_rows", [8, 4096])
def test_candidates_hold_every_similar_pair(spark, tile_rows):
    rows = near_copies(9)
    marked = S.sets_marked(table(spark, rows), S.SIMILAR)
    keys = {r.doc_id: bytes(r.fp)[:32] for r in marked.collect()}
    trees = {bytes(r.node): bytes(r.root) for r in S.connected(S.candidates(marked.drop("doc_id").dropDuplicates(["fp"]), S.SIMILAR, tile_rows)).collect()}
    mine, want = [trees.get(keys[i], keys[i]) for i, _ in rows], jaccard_roots(rows)
    assert all(mine[i] == mine[want[i]] for i in range(len(rows)))


def test_counts_of_shingles(spark):
    rows = near_copies(4)
    got = S.shingle_counts(table(spark, rows), S.SIMILAR)
    want = np.zeros(S.BUCKETS, np.int64)
    for _, t in rows:
        for h in set(S._shingles(t, 5, 42).tolist()):
            want[h % S.BUCKETS] += 1
    assert (got == want).all()


def test_similar_texts_go_and_others_stay(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    rows = list(enumerate(base))
    for i in range(10):
        w = base[i].split()
        for at in (40, 150, 260):
            w[at] = "other"
        rows.append((100 + i, " ".join(w)))
        half = base[10 + i].split()[:150] + [f"x{rng.randrange(5000)}" for _ in range(150)]
        rows.append((200 + i, " ".join(half)))
    rows += [(None, base[0]), (None, "a text of its own without a name"), (300, ""), (301, None)]
    kept = S.dedup(table(spark, rows), S.SIMILAR).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [*range(30), *range(200, 210), 300]
    assert [r.text for r in kept if r.doc_id is None] == ["a text of its own without a name"]


def jaccard_roots(rows):
    """The least index reachable through pairs of a Jaccard similarity of 0.8, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def near_copies(seed):
    """At all similarities, on both sides of 0.8; with lines that repeat; short and of unequal size."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for n in (9, 12, 40, 200, 600):
        for _ in range(8):
            w = text(n)
            rows += [w, w[: n * 4 // 5], w[: n * 9 // 10], w[: n * 7 // 10]]
            for changes in range(1, 1 + max(2, n // 30)):
                own = list(w)
                for at in rng.sample(range(n), changes):
                    own[at] = "changed"
                rows.append(own)
    for _ in range(10):  # one repeated line takes most of the shingles, but few of the distinct ones
        line, own, other = text(8), text(60), text(60)
        rows += [line * 40 + own, line * 40 + other, own, line * 3 + own, own[:-2] + line * 90]
    rows = [" ".join(w) for w in rows] + ["", None, " "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(2))
def test_similar_equals_jaccard_of_all_pairs(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: r.component_id for r in S.components(table(spark, rows), S.SIMILAR).collect()}
    want = jaccard_roots(rows)
    assert [got[i] for i, _ in rows] == want
    assert {r.doc_id for r in S.dedup(table(spark, rows), S.SIMILAR).collect()} == set(want)


@pytest.mark.parametrize("tile_rows", [3, 512])
def test_verified_in_cut_tiles(spark, tile_rows):
    rows = near_copies(5)
    df = table(spark, rows)
    marks = S.fingerprints(df, 5, lanes=4, distinct=True)
    keys = {r.doc_id: bytes(r.fp) for r in marks.collect()}
    one = marks.select(F.substring("fp", 1, 32).alias("node"), F.lit(b"x").alias("root")).distinct()
    trees = {bytes(r.node): bytes(r.root) for r in S.connected(S.verified(df, marks.select("fp").distinct(), one, S.SIMILAR, tile_rows=tile_rows)).collect()}
    mine, want = [trees.get(keys[i], keys[i]) for i, _ in rows], jaccard_roots(rows)
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(rows)) for j in range(i))
