"""Chunks of at most so many bytes that never split a character and overlap.

`chunks` folds over the text's bytes with built-in expressions: each step looks at one slice, so
a step's cost does not depend on the text's length, and what is gathered is copied once in `STEPS` steps. `chunks_arrow` gives
the same rows from Python workers, in time that grows with the length alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.index import CUT_BYTES, cut_by_bytes

MAX_BYTES, OVERLAP = 512, 50
MARKS = (b"\n", b"\r", b".", b"!", b"?")
#: Steps of the fold that are taken at a time.
STEPS = 256
CONTINUATION = bytes(range(0x80, 0xC0))


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(size: int, overlap: int, start_pos: bool) -> str:
    """SQL for the chunks' (start, end and, if asked for, bytes of the chunks before) in bytes of column __b, of __n bytes. w: the slice that a
    step looks at, a character per byte; safe: where it ends without splitting a character; stop:
    behind the last break up to there; e: the chunk's length; back: where the next one begins."""
    half, cont = size // 2, r"[\\x80-\\xBF]"
    first, more, before, kind = ("'sum', 0, ", "'sum', s.sum + e, ", ", 'before', s.sum", ",before:int") if start_pos else ("", "", "", "")
    whole = lambda n: f"length(regexp_replace(substring(w, 1, {n} + 1), '{cont}+\\\\z', '')) - 1"
    forward = f"{size} + length(regexp_extract(substring(w, {size} + 1, 4), '^{cont}*', 0))"
    step = _let(
        "w", f"decode(substring(__b, s.pos + 1, {size} + 4), 'ISO-8859-1')",
        _let("safe", f"if(s.pos + {size} >= __n, __n - s.pos, if({whole(size)} > 0, {whole(size)}, {forward}))",
            _let("stop", r"length(regexp_extract(substring(w, 1, safe), '(?s)^.*[\\n\\r.!?]', 0))",
                _let("e", f"if(s.pos + safe < __n and stop > {half}, stop, safe)",
                    _let("back", f"if({overlap} > 0 and s.pos + e < __n and e > {overlap}, {whole(f'e - {overlap}')}, 0)",
                        f"named_struct('pos', s.pos + if(back > 0, back, e), {more}'out', array_append(s.out, named_struct('start', s.pos, 'end', s.pos + e{before})))")))),
    )
    steps, kinds = f"(cast(ceil(__n / {max(1, half - overlap - 3)}D) as int) + 1)", f"array<struct<start:int,end:int{kind}>>"
    carried = "'sum', o.sum, " if start_pos else ""
    run = f"""aggregate(
        sequence(1, least({STEPS}, {steps})),
        named_struct('pos', o.pos, {carried}'out', cast(array() as {kinds})),
        (s, i) -> if(s.pos >= __n, s, {step}))"""
    # an array grows by being copied, so chunks are gathered by the run and runs by the text
    kept = "'sum', r.sum, " if start_pos else ""
    return f"""flatten(aggregate(
        sequence(1, cast(ceil({steps} / {STEPS}D) as int)),
        named_struct('pos', 0, {first}'outs', cast(array() as array<{kinds}>)),
        (o, j) -> if(o.pos >= __n, o, {_let("r", run, f"named_struct('pos', r.pos, {kept}'outs', array_append(o.outs, r.out))")}),
        o -> o.outs))"""


def chunks(docs: DataFrame, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", start_pos: bool = False) -> DataFrame:
    """doc_id, chunk_index, content, byte_offset and, if asked for, start_pos (as `with_start_pos` has it, without its
    shuffle). Null and empty texts have no chunks."""
    size = max(max_bytes, 1)
    if size < 2 * (overlap + 4):
        return chunks_arrow(docs, max_bytes, overlap, id_col, text_col, start_pos)
    coded = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("__b"))
    cut = coded.withColumn("__n", F.octet_length("__b")).where("__n > 0").select("doc_id", "__b", F.posexplode(F.expr(_fold(size, overlap, start_pos))).alias("chunk_index", "at"))
    content = F.decode(F.expr("substring(__b, at.start + 1, at.end - at.start)"), "UTF-8").alias("content")
    return cut.select("doc_id", "chunk_index", content, F.col("at.start").alias("byte_offset"), *([F.col("at.before").alias("start_pos")] if start_pos else []))


def _whole(part: bytes) -> int:
    """Bytes of `part` before its last character's first byte: where it can be cut in front of that."""
    return len(part.rstrip(CONTINUATION)) - 1


def spans(b: bytes, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk of UTF-8 bytes, by the same slices as the fold."""
    size, start = max(max_bytes, 1), 0
    while rest := len(b) - start:
        part = b[start : start + size + 4]
        if rest <= size:
            length = rest
        else:
            # a first character that is longer than a chunk is one all the same
            length = _whole(part[: size + 1]) or size + len(part[size:]) - len(part[size:].lstrip(CONTINUATION))
            if length < rest:
                stop = 1 + max(part.rfind(mark, 0, length) for mark in MARKS)
                length = stop if stop > size // 2 else length
        yield start, start + length
        step = 0
        if 0 < overlap < length < rest:
            step = max(0, _whole(part[: length - overlap + 1]))
        start += step or length


def chunks_arrow(docs: DataFrame, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", start_pos: bool = False) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["chunk_index", "content", "byte_offset", *(["start_pos"] if start_pos else [])]
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(", ".join(f"{n} {'string' if n == 'content' else 'int'}" for n in names)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_by_bytes(batch, 1, CUT_BYTES):
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                # a text that is one chunk is it as it stands; only the others are looked at one by one
                whole, rest = np.flatnonzero((sizes > 0) & (sizes <= max(max_bytes, 1))), np.flatnonzero(sizes > max(max_bytes, 1))
                at, nth, content, begin, ahead = [], [], [], [], []
                for row, b in zip(rest.tolist(), part.column(1).take(pa.array(rest)).cast(pa.binary()).to_pylist(), strict=True):
                    before = 0
                    for k, (a, z) in enumerate(spans(b, max_bytes, overlap)):
                        at.append(row)
                        nth.append(k)
                        content.append(b[a:z])
                        begin.append(a)
                        ahead.append(before)
                        before += z - a
                none = pa.array(np.zeros(len(whole), np.int32))
                of = np.concatenate([whole, np.array(at, np.int64)])
                order = pa.array(np.argsort(of, kind="stable"))
                both = lambda short, long: pa.concat_arrays([short, long]).take(order)  # noqa: B023, E731
                texts = both(part.column(1).take(pa.array(whole)).cast(pa.string()), pa.array(content, pa.binary()).cast(pa.string()))
                cells = [both(none, pa.array(nth, pa.int32())), texts, both(none, pa.array(begin, pa.int32())), both(none, pa.array(ahead, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of).take(order)), *cells[: len(names)]], names=["doc_id", *names])

    return rows.mapInArrow(run, schema)


def with_start_pos(cut: DataFrame) -> DataFrame:
    """Adds start_pos, the bytes of the chunks before; as chunks overlap it runs ahead of byte_offset."""
    before = W.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    return cut.withColumn("start_pos", F.coalesce(F.sum(F.octet_length("content")).over(before), F.lit(0)).cast("int"))
