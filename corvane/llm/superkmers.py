"""Substring dedup: words covered by a window of words that starts in more than one place are removed.

Words are runs of anything but blanks, unchanged. A window is `window` consecutive words of one text; its
minimiser is the least of its shingles of MMER words by a hash, the leftmost of equals. Consecutive
windows with the same minimiser form a super-k-mer and travel as one packed string (their words, joined by
one space) to the minimiser's bucket, as equal windows do. There the windows of all super-k-mers of a
bucket are sorted and counted exactly: by a hash, and those of equal hash by their words. A bucket with one
super-k-mer holds no repeated window, so buckets are counted by their numbers first and such a one stays where it is.

Equal texts are one: a text is named by 96 bits of its SHA-256, is scanned once, and of a text that is
there twice or more every window is repeated. So a large group of exact copies is counted before it is shuffled.

Hot buckets. Shingles that occur too often (lines that many texts share) would make hot buckets. A first pass
counts all shingles of all texts in a table of 2^TABLE counters a task; a task reports counters that hold 2^-17
of its shingles (and LEAST, which matters for small tasks), so all that hold 2^-16 of the corpus's are known, 2^17 at most. These are ordered behind all others, so
that a window takes another shingle for its minimiser if it has one; what is left are windows that consist
of hot shingles only, and their buckets are dealt out in parts. A part tells which of its windows
are there twice and hands one of each different super-k-mer on to the whole bucket. Within a task memory is bounded by the different
super-k-mers of a bucket, not by its rows: rows beyond POOL are brought down to these in between.

Defined results: a null text has no words. Texts under `window` words lose nothing, copies or not. Rows that repeat, and
rows with null ids, are documents of their own. Empty tables give empty results. Where column names clash, exact
ones win; extra columns are ignored by `scan` and kept by `remove`. Nothing is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import arrow_batch, count_position, numbered, pick, position, slices

WINDOW, MMER = 35, 4
#: Counters of the table of shingles, and the share of all that makes one hot; as 2 to this power.
TABLE, SHARE = 20, 17
#: A shingle is not hot with fewer occurrences, and a task tells none that it has fewer of; rows of a part of a hot bucket.
HOT, LEAST, PART = 1000, 8, 1000
#: Bytes of one bucket's packed strings that are held before they are brought down to the different ones.
POOL = 8 << 20
#: Windows of a super-k-mer, as many as a mask has bits.
MOST = 62
_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), 77


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coded(flat: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    known: dict[bytes, int] = {}
    return np.fromiter(map(known.setdefault, flat, count()), np.int64, len(flat)), known


def shingles(flat: list[bytes]) -> np.ndarray:
    """A hash of the MMER words from each word on; 64 bits, of the words' bytes alone."""
    ids, known = _coded(flat)
    values = np.zeros(len(flat), np.uint64)
    values[list(known.values())] = np.fromiter((xxhash.xxh3_64_intdigest(w, _SEED) for w in known), np.uint64, len(known))
    values = values[ids]
    n = max(0, len(flat) - MMER + 1)
    total, power = np.zeros(n, np.uint64), np.uint64(1)
    for j in range(MMER):
        total = total + values[j : j + n] * power
        power = np.uint64(int(power) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
    return _mixed(total)


def least_at(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least of the `width` values from each place on."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        less = best[step:] < best[:-step]
        at = np.where(less, at[step:], at[:-step])
        best = np.where(less, best[step:], best[:-step])
        size += step
    return at


def super_kmers(texts: list[list[bytes]], window: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of texts that follow each other: index of the text, first window in it, its minimiser's hash, place of the first
    and behind the last word among all words."""
    flat = [w for ws in texts for w in ws]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    values = shingles(flat)
    order = values >> np.uint64(1)
    if hot is not None:
        order |= hot[values & np.uint64((1 << TABLE) - 1)].astype(np.uint64) << np.uint64(63)
    at = least_at(order, window - MMER + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(at))
    good = place + window <= (first + sizes)[owner[: len(at)]] if len(at) else np.zeros(0, bool)
    place = place[good]
    at = at[good]
    new = np.ones(len(place), bool)
    new[1:] = (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(place)))
    if len(length) and length.max() > MOST:
        parts = -(-length // MOST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, left = np.repeat(start, parts) + inner * MOST, np.repeat(length, parts) - inner * MOST
        length = np.minimum(left, MOST)
    begin = place[start]
    text = owner[begin] if len(begin) else begin
    return text, begin - first[text] if len(text) else begin, values[at[start]] if len(start) else np.zeros(0, np.uint64), begin, begin + length + window - 1


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 24))


def _counted(rows: DataFrame) -> DataFrame:
    """slot, n: counters of shingles that hold a large share of a task's; slot null has the number of all."""
    size = 1 << TABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for batch in slices(batches, "text"):
            texts = [words(t) for t in batch.column(0).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            slots = _slot(shingles([w for ws in texts for w in ws]))
            end = np.repeat(np.cumsum(sizes), sizes)[: len(slots)]
            np.add.at(table, slots[np.arange(len(slots)) + MMER <= end], 1)
        total = int(table.sum())
        if total:
            told = np.flatnonzero(table >= max(LEAST, total >> SHARE))
            kind = pa.schema([("slot", pa.int32()), ("n", pa.int64())])
            yield arrow_batch([[*told.tolist(), None], [*table[told].tolist(), total]], kind)

    return rows.select("text").mapInArrow(run, "slot int, n long")


def hot_slots(rows: DataFrame) -> dict[int, int]:
    """Counters that are hot and what they hold: at most 2^SHARE, as each holds that share of all."""
    told = _counted(rows).groupBy("slot").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("slot").isNull(), F.col("n"))).over(Window.partitionBy())
    found = told.where(f"n >= {HOT} or slot is null").withColumn("total", total).where(f"slot is not null and n >= shiftright(total, {SHARE})").collect()
    return {r.slot: r.n for r in found}


_PACKED = T.StructType().add("k", T.LongType()).add("bucket", T.LongType()).add("digest", T.BinaryType()).add("start", T.IntegerType()).add("known", T.LongType()).add("packed", T.BinaryType())
_SCHEMA = pa.schema([("k", pa.int64()), ("bucket", pa.int64()), ("digest", pa.binary()), ("start", pa.int32()), ("known", pa.int64()), ("packed", pa.binary())])


def _parts(hot: dict[int, int]) -> np.ndarray:
    """Of each counter the number of parts of its buckets, 0 if it isn't hot."""
    parts = np.zeros(1 << TABLE, np.int64)
    if hot:
        parts[list(hot)] = [-(-n // PART) for n in hot.values()]
    return parts


def _slot(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64((1 << TABLE) - 1)).astype(np.int64)


def _long(column: pa.Array, window: int) -> list[list[bytes]]:
    """The words of texts that have a window."""
    found = [words(t) for t in column.to_pylist()]
    return [ws if len(ws) >= window else [] for ws in found]


def _shared(texts: DataFrame, window: int, hot: dict[int, int]) -> DataFrame:
    """digest, shared: of each different text the buckets, hot ones apart, to which another super-k-mer goes. It is settled on the
    buckets' numbers alone, so that only what may hold a repeated window is packed and moved."""
    held = texts.sparkSession.sparkContext.broadcast(hot)
    schema = pa.schema([("digest", pa.binary()), ("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(held.value)
        for batch in slices(batches, "text"):
            text, _, value, _, _ = super_kmers(_long(batch.column(1), window), window, parts > 0)
            cold = parts[_slot(value)] == 0
            digests = batch.column(0).take(pa.array(text[cold]))
            yield arrow_batch([digests, pa.array(value[cold].view(np.int64))], schema)

    keys = texts.mapInArrow(run, "digest binary, k long")
    several = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    return keys.join(several, "k", "left_semi").groupBy("digest").agg(F.collect_set("k").alias("shared"))


def _travelling(texts: DataFrame, window: int, hot: dict[int, int]) -> DataFrame:
    """The super-k-mers that are not alone in their bucket. k is where they go: the bucket, of a hot one a part; bucket is set for the hot."""
    held = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(held.value)
        for batch in slices(batches, "text"):
            own = _long(batch.column(1), window)
            text, start, value, begin, end = super_kmers(own, window, parts > 0)
            several = parts[_slot(value)] > 0
            lists = batch.column(3)
            keys, of = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pa.compute.list_parent_indices(lists).to_numpy()
            if len(keys):
                # a text's buckets are looked up among its own
                name = lambda t, v: _mixed(v + _mixed(t.astype(np.uint64) * _BASE))
                several |= np.isin(name(text, value), name(of, keys))
            text, start, value, begin, end = text[several], start[several], value[several], begin[several], end[several]
            flat = [w for ws in own for w in ws]
            joined = b" ".join(flat)
            at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)))
            packed = [joined[a:z] for a, z in zip(at[begin].tolist(), (at[end] - 1).tolist())]
            many = parts[_slot(value)]
            # the part goes by the text and place, so that copies of one super-k-mer spread
            digests = batch.column(0).to_pylist()
            salt = np.fromiter((int.from_bytes(d[:8], "little") for d in digests), np.uint64, len(digests))[text]
            salt = _mixed(salt + start.astype(np.uint64)) % np.maximum(many, 1).astype(np.uint64)
            k = np.where(many > 0, _mixed(value + salt * _BASE), value).view(np.int64)
            bucket = pa.array(value.view(np.int64), mask=many == 0)
            names = batch.column(0).take(pa.array(text))
            yield arrow_batch([pa.array(k), bucket, names, pa.array(start.astype(np.int32)), pa.nulls(len(k), pa.int64()), pa.array(packed, pa.binary())], _SCHEMA)

    return texts.join(_shared(texts, window, hot), "digest", "left").mapInArrow(run, _PACKED)


def _windows(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of packed strings, one after the other: the string, the place in it, and a number that equal
    windows, and only these, share."""
    parts = [p.split(b" ") for p in packed]
    flat = [w for ws in parts for w in ws]
    ids, _ = _coded(flat)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = sizes - window + 1
    owner = np.repeat(np.arange(len(parts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(sizes) - sizes, n) + place
    power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(ids), _BASE, np.uint64))))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)])))
    # hashes at different places are compared by bringing each to the place of the last
    key = (prefix[begin + window] - prefix[begin]) * power[len(ids) - begin]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = begin[order[1:]][same], begin[order[:-1]][same]
    if all(np.array_equal(ids[a + j], ids[b + j]) for j in range(window)):
        number = np.empty(len(order), np.int64)
        number[order] = np.concatenate(([0], np.cumsum(~same))) if len(order) else 0
        return owner, place, number
    table = np.lib.stride_tricks.sliding_window_view(ids, window)[begin]
    return owner, place, np.unique(table, axis=0, return_inverse=True)[1].reshape(-1)


def reduced(rows: pa.Table, window: int) -> tuple[list, pa.Table]:
    """Of super-k-mers, those of a bucket all there: (digest, start, mask of the windows that turn out to be
    there twice) for each, and a table with a row for each different one. known: the windows that are known
    to be there twice, all of a text that is null."""
    packed = rows.column("packed").to_pylist()
    known = np.array([x or 0 for x in rows.column("known").to_pylist()], np.int64)
    digests, starts = rows.column("digest").to_pylist(), rows.column("start").to_pylist()
    ids, seen = _coded(packed)
    firsts = np.unique(ids)
    copies = np.bincount(ids, minlength=len(ids))
    kinds = [packed[i] for i in firsts.tolist()]
    owner, place, number = _windows(kinds, window)
    bit = np.int64(1) << place
    before = known[firsts][owner] & bit != 0
    many = copies[firsts][owner] > 1
    weight = np.bincount(number, np.where(before | many, 2, 1))
    twice = weight[number] > 1
    mask = np.zeros(len(firsts), np.int64)
    np.bitwise_or.at(mask, owner[twice], bit[twice])
    spread = np.zeros(len(packed), np.int64)
    spread[firsts] = mask
    fresh = spread[ids] & ~known
    told = [(digests[i], starts[i], m) for i, m in zip(np.flatnonzero(fresh).tolist(), fresh[fresh != 0].tolist()) if digests[i] is not None]
    left = rows.take(pa.array(firsts))
    alone = copies[firsts] == 1
    names = [d if one else None for d, one in zip(left.column("digest").to_pylist(), alone.tolist())]
    left = left.set_column(2, "digest", pa.array(names, pa.binary())).set_column(4, "known", pa.array(mask))
    return told, left


def _marks(found: list) -> pa.Table:
    """Rows that say what is known of a text; they go on by the text."""
    k = [int.from_bytes(d[:8], "little", signed=True) for d, _, _ in found]
    digests, starts, masks = map(list, zip(*found))
    n = len(found)
    return pa.table([pa.array(k, pa.int64()), pa.nulls(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(masks, pa.int64()), pa.nulls(n, pa.binary())], schema=_SCHEMA)


def _several(rows: pa.Table, last: bool) -> pa.Table:
    """Without super-k-mers that are alone in their bucket: theirs are no repeated windows."""
    k = rows.column("k").to_numpy()
    end = np.append(k[1:] != k[:-1], True)
    alone = end & np.append(True, end[:-1])
    kept = ~alone | rows.column("known").is_valid().to_numpy()
    return rows.filter(pa.array(kept if last else kept | rows.column("bucket").is_valid().to_numpy()))


def _count(rows: DataFrame, window: int, last: bool) -> DataFrame:
    """Rows of super-k-mers that are sorted by k to marks (known has the windows that are there twice, packed is null). But for
    the last pass, the different super-k-mers of hot buckets come along, to be counted with those of the bucket's other parts.
    Marks pass through."""

    def whole(table: pa.Table) -> Iterator[pa.Table]:
        some = _several(table, last)
        if not len(some):
            return
        found, left = reduced(some, window)
        if found:
            yield _marks(found)
        if not last:
            on = left.filter(left.column("bucket").is_valid())
            yield on.set_column(0, "k", on.column("bucket"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        pending, limit = _SCHEMA.empty_table(), POOL
        for batch in batches:
            table = pa.Table.from_batches([batch]).cast(_SCHEMA)
            mark = table.column("packed").is_null()
            yield table.filter(mark)
            pending = pa.concat_tables([pending, table.filter(pa.compute.invert(mark))])
            if not len(pending):
                continue
            k = pending.column("k").to_numpy()
            if end := int(np.flatnonzero(k != k[-1])[-1] + 1) if k[0] != k[-1] else 0:
                yield from whole(pending.slice(0, end))
                pending, limit = pending.slice(end).combine_chunks(), POOL
            if pending.nbytes > limit:  # of one bucket
                found, pending = reduced(pending, window)
                limit = max(POOL, 2 * pending.nbytes)
                if found:
                    yield _marks(found)
        if len(pending):
            yield from whole(pending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            yield from table.combine_chunks().to_batches()

    return rows.mapInArrow(run, _PACKED)


def _marked(texts: DataFrame, window: int, hot: dict[int, int]) -> DataFrame:
    """digest, marks (start and known) of different texts that hold windows which other places have too."""
    spark = texts.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda rows: rows.repartition(parts, "k").sortWithinPartitions("k")
    found = _count(dealt(_travelling(texts, window, hot)), window, not hot)
    if hot:
        found = _count(dealt(found), window, True)
    return found.groupBy("digest").agg(F.collect_list(F.struct("start", "known")).alias("marks"))


def covered(n: int, starts: np.ndarray, known: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows marked lie over."""
    edge = np.zeros(n + 1, np.int64)
    row, bit = np.nonzero((known[:, None] >> np.arange(MOST)) & 1)
    np.add.at(edge, starts[row] + bit, 1)
    np.add.at(edge, starts[row] + bit + window, -1)
    return np.cumsum(edge[:n]) > 0


def _judged(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """digest, n_words, n_removed, kept_sha256 and, with text, kept (null where nothing goes) of each different text."""
    texts = rows.groupBy(_digest(F.col("text")).alias("digest")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    marked = texts.join(_marked(texts, window, hot_slots(rows)), "digest", "left")
    out = [("digest", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            marks = batch.column(3)
            inside = marks.flatten()
            starts, known = (inside.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(marks), 0).to_numpy(zero_copy_only=False)
            end = np.cumsum(sizes)
            made = []
            for text, copies, a, z in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), (end - sizes).tolist(), end.tolist()):
                ws = words(text)
                kept = ws
                if len(ws) >= window:
                    if copies > 1:
                        kept = []
                    elif z > a:
                        kept = [w for w, gone in zip(ws, covered(len(ws), starts[a:z].astype(np.int64), known[a:z], window).tolist()) if not gone]
                left = b" ".join(kept)
                made.append((len(ws), len(ws) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if with_text and len(kept) < len(ws) else None))
            yield arrow_batch([batch.column(0), *map(list, zip(*made))], pa.schema(out))

    kinds = T.StructType().add("digest", T.BinaryType()).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType()).add("kept", T.StringType())
    return marked.mapInArrow(run, kinds)


def scan(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that are left, joined by one space), a row per row of docs."""
    _check(window)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    judged = _judged(rows.select("text"), window, False)
    return rows.select("doc_id", _digest(F.col("text")).alias("digest")).join(judged, "digest").select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, text_col="text", n_chars_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs, with texts cut to the words that are left, joined by one space; texts that lose nothing stay as they are to the last
    blank. n_chars, if it is a column of whole numbers, is set anew with the text."""
    _check(window)
    safe, at, size = numbered(docs), position(docs, text_col), count_position(docs, n_chars_col)
    text = f"c{at}"
    judged = _judged(safe.select(F.coalesce(text, F.lit("")).alias("text")), window, True).select("digest", "kept")
    joined = safe.withColumn("digest", _digest(F.coalesce(text, F.lit("")))).join(judged, "digest")
    cells = {text: F.when(F.col(text).isNotNull(), F.coalesce("kept", text))}
    if size is not None:
        cells[f"c{size}"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(safe.schema[size].dataType)).otherwise(F.col(f"c{size}"))
    return joined.select(*[cells.get(c, F.col(c)).alias(c) for c in safe.columns]).toDF(*docs.columns)


def _check(window: int) -> None:
    if window < MMER:
        raise ValueError(f"a window has {MMER} words at least")
