"""SimHash near-duplicates: fingerprints, exact links within a Hamming radius, components.

Fingerprint: A-Z are lowered, words are runs of anything but blanks, shingles are `width`
words, repeats included; bit i is set if it is set in over half of the shingles' XXH64.

Links: distinct fingerprints only are compared, so a group of equal texts is one point. Two
fingerprints within radius r agree on at least b - r of b bit fields, so each tile is made of
fingerprints that agree on some b - r fields (b grows with the number of fingerprints, which
keeps tiles small). A tile is compared exactly, block by block, with numpy exclusive-or and
bit counts, and block pairs whose population counts differ by more than the radius are
skipped. Tiles beyond `tile_rows` are cut by population count and hash, and only the pairs of
cuts whose population counts lie within the radius are dealt out, so no task gets an
unbounded tile. A tile yields a forest (a row per fingerprint at most), never its pairs.

Similar texts (`SIMILAR`) are those whose sets of shingles have a Jaccard similarity of four fifths
or more. So wide a radius leaves no fields that must agree, but the sets themselves do: of sets with
that similarity the rarest fifth and one more of the shingles of each hold one of the other's, whatever
the order that all sets are sorted in. So a tile is made of the texts that hold a shingle among their
rarest, by the counts of a table of fixed size over the whole corpus; tiles are compared as above,
with fingerprints of several lanes of 64 bits over distinct shingles, and a radius that such a pair is
beyond less than once in 10^12 times. Texts that candidate links hold together are then compared
by their very shingles (`verified`), and only pairs that have the similarity are links. A text is in
as many tiles as a fifth of its shingles, whatever the size of the corpus.

Components: rounds of minimum-label hooking and shortcutting over the forests, as DataFrames
that are written to the shared folder each round.

Defined results: a null or blank text has fingerprint 0, linked like any other. A null doc_id
never names a component unless all of its component's are null. Repeated rows come back
repeated, alike. Extra columns are ignored by `components`, kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import arrow_batch, drop_path, drop_since, materialize, pick, position, settled, shared_paths, slices, written

BLOCK = 512
BITS = 64
SLOTS = 1 << 22  # of a bit table of digests
BUCKETS = 1 << 18  # of the table of shingle counts
LEVEL = 8  # population counts to a level, where fingerprints have several lanes


def _shingles(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:z], seed) for a, z in zip(starts[:n].tolist(), last.tolist())), "<u8", n)


def _majority(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """lanes x 64 bits: the shingles' XXH64 and, for further lanes, values mixed from it."""
    n = len(hashes)
    total = np.zeros((lanes, BITS), np.int64)
    for at in range(0, n, 1 << 14):
        some = hashes[at : at + (1 << 14)]
        for lane in range(lanes):
            total[lane] += np.unpackbits((_mixed(some, lane) if lane else some).view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]


def _mixed(x: np.ndarray, lane: int) -> np.ndarray:
    """A bijection of 64-bit values, another one for each lane."""
    x = x + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    return int(_majority(_shingles(text, width, seed), 1)[0])


def _digest(distinct: np.ndarray) -> bytes:
    """Of a sorted set of shingles."""
    return xxhash.xxh3_128_digest(distinct.tobytes())


def _marks(texts: list[str | None], width: int, seed: int, lanes: int, distinct: bool) -> pa.Array:
    hashes = (_shingles(t, width, seed) for t in texts)
    if not distinct:
        return _column([_majority(h, lanes) for h in hashes], lanes)
    return pa.array([_key(h, lanes) for h in map(np.unique, hashes)], pa.binary())


def _key(distinct: np.ndarray, lanes: int) -> bytes:
    return _majority(distinct, lanes).tobytes() + _digest(distinct)


def _rarest(distinct: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """As many of the rarest shingles as a set of the similarity `least` cannot do without, all of them."""
    n = len(distinct)
    take = n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0
    order = np.lexsort((distinct, counts[distinct & np.uint64(len(counts) - 1)]))
    return distinct[order[:take]]


def _column(fps: list[np.ndarray] | np.ndarray, lanes: int) -> pa.Array:
    """Rows of lanes as Spark has them: one lane as a signed long, more as bytes."""
    if lanes == 1:
        return pa.array(np.array(fps, np.uint64).reshape(-1).view(np.int64))
    return pa.array([f.tobytes() for f in fps], pa.binary())


def _lanes(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col="doc_id", text_col="text", lanes: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id, fp (64 bits as a signed long; several lanes as bytes), a row per row of docs. Of distinct
    shingles, fp is always bytes and ends with a digest of their set (16 bytes)."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = _marks(batch.column(1).to_pylist(), width, seed, lanes, distinct)
            yield arrow_batch([batch.column(0), fps], pa.schema([("doc_id", batch.column(0).type), ("fp", fps.type)]))

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType() if lanes == 1 and not distinct else T.BinaryType())]))


def plan(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Tables of bit fields (shift, width) to agree on. The number of fields is the least for
    which a tile of random fingerprints is expected to hold 2,000 at most."""
    for fields in range(max(2, radius + 1), BITS + 1):
        cuts = [BITS * i // fields for i in range(fields + 1)]
        spans = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(fields)]
        tables = [list(c) for c in combinations(spans, fields - radius)]
        if n >> min(sum(w for _, w in t) for t in tables) <= 2000 or len(tables) >= 70:
            return tables
    return []


def forest(fps: np.ndarray, radius: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exact comparison of one tile; indices (child, parent) of a spanning forest of its links.
    With split, only the first `split` fingerprints against the rest. What is in one tree already is
    not compared again, so a large group of near copies takes time in proportion to its size."""
    fps = fps.reshape(len(fps), -1)
    n, lanes = fps.shape
    pop = np.bitwise_count(fps).sum(1, dtype=np.int16)
    label = list(range(n))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    sides = [np.argsort(pop, kind="stable")] if split is None else [np.argsort(pop[:split], kind="stable"), split + np.argsort(pop[split:], kind="stable")]
    child, parent = [], []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        """Links between rows of a and of b; a row that is in both is no link."""
        differ = np.bitwise_count(fps[a, 0][:, None] ^ fps[b, 0][None, :])
        for lane in range(1, lanes):
            differ = differ + np.bitwise_count(fps[a, lane][:, None] ^ fps[b, lane][None, :]).astype(np.uint16)
        near = (differ <= radius) & (a[:, None] != b[None, :])
        if not near.any():
            return
        # the root of each column is kept up to date, so a row looks at new trees only
        rb = np.fromiter(map(root, b.tolist()), np.int64, len(b))
        for r in np.nonzero(near.any(1))[0].tolist():
            cols, now = np.nonzero(near[r])[0], root(int(a[r]))
            new = cols[rb[cols] != now]
            for c in new[np.unique(rb[new], return_index=True)[1]].tolist():
                x, y = root(int(a[r])), root(int(b[c]))
                if x != y:
                    label[max(x, y)] = min(x, y)
                    child.append(a[r])
                    parent.append(b[c])
            if len(new):
                rb[cols] = root(int(a[r]))

    left, right = sides[0], sides[-1]
    for i in range(0, len(left), BLOCK):
        a = left[i : i + BLOCK]
        for j in range(i if split is None else 0, len(right), BLOCK):
            b = right[j : j + BLOCK]
            if pop[b[0]] - pop[a[-1]] > radius:
                break
            if pop[a[0]] - pop[b[-1]] > radius:
                continue
            if len(a) + len(b) > BLOCK and child:
                ra, rb = (np.fromiter(map(root, x.tolist()), np.int64, len(x)) for x in (a, b))
                ids, sizes = np.unique(ra, return_counts=True)
                in_a, in_b = ra == ids[sizes.argmax()], rb == ids[sizes.argmax()]
                if in_a.sum() > 1 and in_b.sum() > 1:  # the largest tree of a, which goes on in b
                    compare(a, b[~in_b])
                    compare(a[~in_a], b[in_b])
                    continue
            compare(a, b)
    return np.array(child, np.int64), np.array(parent, np.int64)


def links(points: DataFrame, n: int, radius: int = 4, tile_rows: int = 4096) -> DataFrame:
    """points: fp, a row per distinct fingerprint of one lane. Returns (a, b): forests whose union
    links all that the radius links."""
    tables = plan(n, radius)

    def key(fields: list[tuple[int, int]]):
        out, width = F.lit(0).cast("long"), 0
        for shift, w in fields:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << w) - 1)), width))
            width += w
        return out

    keyed = points.select("fp", F.posexplode(F.array(*[key(t) for t in tables])).alias("t", "k")).withColumn("level", F.bit_count("fp"))
    return _compared(_dealt(keyed, radius, tile_rows), radius, 1)


def shingle_counts(docs: DataFrame, like: Like, text_col="text") -> np.ndarray:
    """How many texts hold the shingles of each of `BUCKETS` buckets; a table of this size reaches the driver."""
    width, seed = like.width, like.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            own = np.concatenate([np.unique(_shingles(t, width, seed)) for t in batch.column(0).to_pylist()])
            total += np.bincount((own & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield arrow_batch([some.astype(np.int32), total[some]], pa.schema([("bucket", pa.int32()), ("n", pa.int64())]))

    found = pick(docs, text_col).toDF("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def sets_marked(docs: DataFrame, like: Like, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fp (lanes and digest), level, rarest: a row per row of docs."""
    width, seed, lanes, least = like.width, like.seed, like.lanes, like.jaccard
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, like, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [np.unique(_shingles(t, width, seed)) for t in batch.column(1).to_pylist()]
            keys = [_key(s, lanes) for s in own]
            level = [int(np.bitwise_count(np.frombuffer(k, np.uint64, lanes)).sum()) // LEVEL for k in keys]
            rarest = [_rarest(s, held.value, least).view(np.int64) for s in own]
            yield arrow_batch([batch.column(0), keys, level, rarest], pa.schema([("doc_id", batch.column(0).type), ("fp", pa.binary()), ("level", pa.int32()), ("rarest", pa.list_(pa.int64()))]))

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("fp binary, level int, rarest array<long>").fields]))


def candidates(points: DataFrame, like: Like, tile_rows: int = 4096) -> DataFrame:
    """points: fp, level, rarest, a row per set. Returns (a, b), forests over the lanes of links of
    sets that share one of their rarest shingles and lie within the radius. Which shingles are shared is
    settled on 16 bytes each; fingerprints move for these alone."""
    own = points.select(F.xxhash64("fp").alias("id"), F.substring("fp", 1, like.lanes * BITS // 8).alias("fp"), "level")
    held = points.select(F.explode("rarest").alias("k"), F.xxhash64("fp").alias("id"))
    shared = held.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    keyed = held.join(shared, "k").join(own, "id").select(F.lit(0).alias("t"), "k", "level", "fp")
    return _compared(_dealt(materialize(keyed, "simhash-keyed"), like.radius // LEVEL + 1, tile_rows), like.radius, like.lanes)


def _dealt(keyed: DataFrame, reach: int, tile_rows: int, weight: Column | None = None) -> DataFrame:
    """keyed: t, k (the tile), level (grows with the population count), fp. Returns tile, two, side,
    fp, the rows of a tile side by side. Tiles beyond tile_rows (or weight) are cut by level and hash;
    the pairs of cuts within `reach` levels become tiles of two sides."""
    counts = keyed.groupBy("t", "k", "level").agg(F.sum(F.lit(1) if weight is None else weight).alias("count"))
    large = (
        counts.groupBy("t", "k")
        .agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", F.ceil(F.col("count") / tile_rows).cast("int")))).alias("cuts"))
        .where(F.col("n") > tile_rows)
        .select("t", "k", "cuts")
    )
    joined = keyed.join(large, ["t", "k"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts")[F.col("level")]).cast("int")
    others = F.expr(
        f"flatten(transform(sequence(level - {reach}, level + {reach}), p -> if(cuts[p] is null, array(), "
        "transform(sequence(0, cuts[p] - 1), c -> struct(p as p, c as c)))))"
    )
    pair = F.col("other").isNotNull()
    dealt = (
        joined.withColumn("me", F.struct(F.col("level").alias("p"), mine.alias("c")))
        .withColumn("other", F.explode_outer(F.when(F.col("cuts").isNotNull(), others)))
        .select(
            "t", "k", F.when(pair, F.least("me", "other")).alias("lo"), F.when(pair, F.greatest("me", "other")).alias("hi"),
            F.when(pair, (F.col("me") > F.col("other")).cast("int")).otherwise(0).alias("side"), "fp",
        )
    )
    tile = F.xxhash64("t", "k", "lo.p", "lo.c", "hi.p", "hi.c")
    dealt = dealt.select(tile.alias("tile"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("two"), "side", "fp")
    return dealt.repartition(F.col("tile")).sortWithinPartitions("tile", "side")


def _compared(dealt: DataFrame, radius: int, lanes: int) -> DataFrame:
    """(a, b): a forest of each tile."""
    kind = dealt.schema["fp"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now, out_a, out_b = None, [], []

        def end() -> None:
            if sum(len(h[0]) for h in held) > 1:
                two, side, fps = (np.concatenate(c) for c in zip(*held, strict=True))
                x, y = forest(fps, radius, int((side == 0).sum()) if two[0] else None)
                if len(x):
                    out_a.append(fps[x])
                    out_b.append(fps[y])
            held.clear()

        def made() -> Iterator[pa.RecordBatch]:
            if out_a:
                a, b = _column(np.concatenate(out_a), lanes), _column(np.concatenate(out_b), lanes)
                out_a.clear()
                out_b.clear()
                yield arrow_batch([a, b], pa.schema([("a", a.type), ("b", b.type)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            tile, two, side = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            fps = _lanes(batch.column(3))
            cuts = np.concatenate(([0], np.nonzero(np.diff(tile))[0] + 1, [len(tile)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if tile[lo] != now:
                    end()
                now = tile[lo]
                held.append((two[lo:hi].copy(), side[lo:hi].copy(), fps[lo:hi].copy()))
            yield from made()
        end()
        yield from made()

    return dealt.mapInArrow(run, T.StructType([T.StructField(n, kind) for n in ("a", "b")]))


def similar(sets: list[np.ndarray], least: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same as `forest` for sorted sets of shingles, linked at a Jaccard similarity of `least`."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(token, kind="stable")]
    held = np.bincount(token, minlength=1)
    first = np.cumsum(held) - held
    label = np.arange(n)  # of its tree, kept up to date
    child, parent = [], []
    for x in range(n if split is None else split):
        # those of the other side, or after x, of a fitting size, in other trees
        may = (sizes >= least * sizes[x] - 1) & (sizes * least <= sizes[x] + 1) & (label != label[x])
        may[: x + 1 if split is None else split] = False
        if not may.any():
            continue
        shared = np.zeros(n, np.int64)
        own = token[bounds[x] : bounds[x + 1]]
        for at in range(0, len(own), 1024):
            k = held[own[at : at + 1024]]
            start = first[own[at : at + 1024]] - (np.cumsum(k) - k)
            shared += np.bincount(holders[np.arange(k.sum()) + np.repeat(start, k)], minlength=n)
        for y in np.flatnonzero(may & (shared / np.maximum(1, sizes[x] + sizes - shared) >= least)).tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                child.append(x)
                parent.append(y)
    return np.array(child, np.int64), np.array(parent, np.int64)


def verified(docs: DataFrame, keys: DataFrame, trees: DataFrame, like: Like, text_col="text", tile_rows: int = 512) -> DataFrame:
    """keys: fp, a row per set of shingles, with its digest; trees: node, root of candidates, without.
    Returns (a, b), forests of the links of sets within a tree that have the similarity: all pairs of a
    tree are compared, in tiles of about tile_rows sets of 1,000 shingles on a side."""
    width, seed, least = like.width, like.seed, like.jaccard
    lane_bytes = like.lanes * BITS // 8
    grouped = keys.select("fp", F.substring("fp", 1, lane_bytes).alias("node")).join(trees, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    several = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    members = materialize(grouped.join(several, "root").select(F.substring("fp", lane_bytes + 1, 16).alias("digest"), "fp", F.xxhash64("root").alias("k")), "simhash-candidates")
    # a bit table of a fixed size lets few texts but the members' through to the join
    slot = F.pmod(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int"), F.lit(SLOTS))
    table = np.zeros(SLOTS, bool)
    table[members.select(slot.alias("s")).distinct().toArrow().column("s").to_numpy()] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(table).tobytes())

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in slices(batches, "text"):
            texts = batch.column(0).to_pylist()
            digests = [_digest(np.unique(_shingles(t, width, seed))) for t in texts]
            at = [int.from_bytes(d[:3], "big") % SLOTS for d in digests]
            some = [i for i, s in enumerate(at) if bits[s >> 3] >> (7 - (s & 7)) & 1]
            yield arrow_batch([[digests[i] for i in some], [texts[i] for i in some]], pa.schema([("digest", pa.binary()), ("text", pa.string())]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [np.unique(_shingles(t, width, seed)) for t in batch.column(2).to_pylist()]
            yield arrow_batch([batch.column(0), batch.column(1), [len(o) for o in own], [o.tobytes() for o in own]], pa.schema([("k", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("set", pa.binary())]))

    texts = pick(docs, text_col).toDF("text").mapInArrow(passed, "digest binary, text string")
    # equal sets are one, whatever the number of their texts
    texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(members, "digest").select("k", "fp", "text")
    found = materialize(texts.mapInArrow(sets, "k long, key binary, n long, set binary"), "simhash-sets")
    # sizes of a linked pair differ by a factor of 1 / least at most, so by a level at most
    level = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / float(np.log(1.01 / least))).cast("int")
    keyed = found.select(F.lit(0).alias("t"), "k", level.alias("level"), F.struct("key", "n", "set").alias("fp"))
    dealt = _dealt(keyed, 1, tile_rows, 1 + F.col("fp.n") / 1000)
    dealt = dealt.select("tile", "two", "side", "fp.key", "fp.set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bool, int, bytes, np.ndarray]] = []
        now = None
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

        def end() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                x, y = similar([r[3] for r in rows], least, sum(r[1] == 0 for r in rows) if rows[0][0] else None)
                yield arrow_batch([[rows[i][2] for i in x.tolist()], [rows[i][2] for i in y.tolist()]], schema)
            rows.clear()

        for batch in batches:
            for tile, two, side, key, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != now:
                    yield from end()
                now = tile
                rows.append((two, side, key, np.frombuffer(own, np.uint64)))
        yield from end()

    return dealt.mapInArrow(run, "a binary, b binary")


def connected(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is the least node
    reachable. Each round hooks every root under the least root next to it and then shortens
    the chains; the rounds end when no edge joins two trees."""
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").distinct(), f"{label}-edges")
    # level by level: a star of each round maps nodes to smaller nodes; what is left are edges between stars
    stars: list[DataFrame] = []
    while not now.isEmpty():
        near = now.select("a", "b").union(now.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        hook, last = written(near.select(F.col("a").alias("node"), F.least("a", "b").alias("up")), f"{label}-hook")
        while True:  # pointer jumping; up <= node, so there are no cycles
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            moved = hook.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved"))
            moved, next_ = written(moved, f"{label}-jump")
            drop_path(spark, last)
            hook, last = moved.select("node", "up"), next_
            if moved.where("moved").isEmpty():
                break
        stars.append(hook)
        side = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        other = hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = now.join(side, "a").join(other, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now, next_ = written(left, f"{label}-left")
        drop_path(spark, path)
        path = next_
    if not stars:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField(n, kind) for n in ("node", "root")]))
    out = stars[0].select("node", F.col("up").alias("root"))
    for star in stars[1:]:
        out = out.join(star.select(F.col("node").alias("root"), F.col("up").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out


@dataclass(frozen=True)
class Like:
    """What counts as alike: shingles of `width` words, fingerprints of lanes x 64 bits, linked at
    `radius` differing bits; with `jaccard`, these are candidates, and links are sets of shingles of such
    a similarity."""

    width: int = 4
    radius: int = 4
    lanes: int = 1
    seed: int = 42
    jaccard: float | None = None


#: Nearly equal texts; every link is found.
EXACT = Like()
#: Texts whose sets of shingles of five words have a Jaccard similarity of 0.8 or more. At 0.8 sets of
#: equal size stand at an angle of 0.152 pi, so 256 bits differ in 39 on average (deviation 5.7), and in
#: 48 (6.2) for the smallest such sets, of 4 and 5 shingles, whose bits differ with probability 3/16. By the binomial
#: distribution more than 104 of these differ with probability 2e-16; unrelated texts differ in 128 (8) bits.
SIMILAR = Like(width=5, radius=104, lanes=4, jaccard=0.8)


def classes(docs: DataFrame, like: Like = EXACT, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, fp for each row of docs; fp, root for each fingerprint. Tables, and the only ones that stay."""
    spark = docs.sparkSession
    if like.jaccard is None:
        rows = materialize(fingerprints(docs, like.width, like.seed, id_col, text_col), "simhash")
    else:
        marked = materialize(sets_marked(docs, like, id_col, text_col), "simhash")
        rows = marked.select("doc_id", "fp")

    def found() -> DataFrame:
        if like.jaccard is None:
            points = materialize(rows.select("fp").distinct(), "simhash-points")
            near = links(points, points.count(), like.radius)
        else:
            points = materialize(marked.groupBy("fp").agg(F.first("level").alias("level"), F.first("rarest").alias("rarest")), "simhash-points")
            near = settled(spark, lambda: connected(candidates(points, like), "simhash-near"), "simhash-near-trees")
            near = verified(docs, points.select("fp"), near, like, text_col)
        trees = connected(near, "simhash")
        return points.select("fp").join(trees, points.fp == trees.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))

    return rows, settled(spark, found, "simhash-classes")


def components(docs: DataFrame, like: Like = EXACT, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable through links)."""
    rows, found = classes(docs, like, id_col, text_col)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = materialize(found.join(first, "fp"), "simhash-members")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    known = member.join(least, "root").select("fp", "component_id")
    fp = F.col("fp") if like.jaccard is None else F.substring("fp", 1, like.lanes * BITS // 8)
    return rows.join(known, "fp").select("doc_id", fp.alias("fp"), "component_id")


def dedup(docs: DataFrame, like: Like = EXACT, id_col="doc_id", text_col="text") -> DataFrame:
    """One row of each component, all columns: that with the least doc_id, rows without one
    last. Of rows that share it (repeated rows, null ids) one stays, the first by text."""
    there = shared_paths()
    rows, found = classes(docs, like, id_col, text_col)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(found, "fp")
    best = least.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("k"))
    keep, kept = written(best.select(F.col("k.first").alias("__id"), F.col("k.fp").alias("__fp")), "simhash-keep")
    names = docs.columns
    cols = [f"__c{i}" for i in range(len(names))]
    key, text = (cols[position(docs, c)] for c in (id_col, text_col))
    safe = docs.toDF(*cols)
    odd, odds = written(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("__odd")), "simhash-odd")
    # ids of rows that go are few, as a rule: a small table is broadcast by Spark, which leaves the texts where they are
    ids = rows.where("doc_id is not null").select(F.col("doc_id").alias("__id"))
    lost = ids.join(keep.where("__id is not null").select("__id"), "__id", "left_anti").select("__id").unionByName(odd.where("__odd is not null").select(F.col("__odd").alias("__id")))
    gone, path = written(lost.distinct(), "simhash-gone")
    kind = rows.schema["fp"].dataType
    drop_since(docs.sparkSession, there, kept, odds, path)
    single = safe.where(F.col(key).isNotNull()).join(gone, safe[key] == gone["__id"], "left_anti")
    if odd.isEmpty():
        return single.toDF(*names)
    # ids that are null or shared do not name a row; these rows are matched by fingerprint too
    several = safe.where(F.col(key).isNull()).unionByName(safe.join(odd.where("__odd is not null"), safe[key] == F.col("__odd"), "left_semi"))
    schema = T.StructType([*several.schema.fields, T.StructField("__fp", kind)])
    at = cols.index(text)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            fps = _marks(batch.column(at).to_pylist(), like.width, like.seed, like.lanes, like.jaccard is not None)
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*cols, "__fp"])

    chosen = several.mapInArrow(marked, schema).join(keep.withColumnRenamed("__fp", "__kfp"), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__kfp")), "left_semi")
    again = chosen.groupBy("__fp", key).agg(F.min_by(F.struct(*cols), F.coalesce(F.col(text), F.lit(""))).alias("r")).select("r.*")
    return single.unionByName(again).toDF(*names)
