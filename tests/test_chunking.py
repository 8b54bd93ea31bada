import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators.chunking import chunks, chunks_arrow, spans, with_start_pos

TEXTS = [
    "A" * 1500,
    "",
    None,
    "Retrieval augmented generation answers questions from documents.",
    "这是用于验证中文 UTF-8 分块边界安全性的法律文书内容。" * 220,
    "😀" * 700,
    "ab.\n" * 400,
    "é\u0085" * 600,
    "x" * 511 + "é" + "y" * 600,
    "no breaks " * 200 + "end.",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_rule(text, size=512, overlap=50):
    """By what the rule says of all places at once: where characters begin, and where breaks are."""
    b = (text or "").encode()
    begins = {i for i in range(len(b)) if not 0x80 <= b[i] < 0xC0} | {len(b)}
    breaks = {i + 1 for i, c in enumerate(b) if c in b"\n\r.!?"}
    out, at = [], 0
    while at < len(b):
        whole = [i for i in begins if at < i <= at + size]
        end = max(whole) if whole else min(i for i in begins if i > at)
        if end < len(b):
            end = max([i for i in breaks if at + size // 2 < i <= end], default=end)
        out.append((at, end))
        shared = [i for i in begins if at < i <= end - overlap] if 0 < overlap < end < len(b) else []
        at = max(shared, default=end)
    return out


def test_golden_byte_ranges(spark):
    got = with_start_pos(chunks(rows(spark, TEXTS[:1]))).orderBy("chunk_index").collect()
    assert [(r.byte_offset, r.byte_offset + len(r.content)) for r in got] == [(0, 512), (462, 974), (924, 1436), (1386, 1500)]
    assert [r.start_pos for r in got] == [0, 512, 1024, 1536]


@pytest.mark.parametrize(("size", "overlap"), [(512, 50), (128, 20), (40, 30), (1, 0)])
def test_native_equals_arrow_equals_the_rule(spark, size, overlap):
    texts = TEXTS if size > 1 else TEXTS[3:4]
    native = sorted(map(tuple, chunks(rows(spark, texts), size, overlap).collect()))
    assert native == sorted(map(tuple, chunks_arrow(rows(spark, texts), size, overlap).collect()))
    want = [(i, k, (t or "").encode()[a:z].decode(), a) for i, t in enumerate(texts) for k, (a, z) in enumerate(by_rule(t, size, overlap))]
    assert native == want


@settings(max_examples=200, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(min_size=0, max_size=300), st.integers(1, 64), st.integers(0, 70))
def test_spans_never_split_characters(text, size, overlap):
    b = text.encode()
    got = list(spans(b, size, overlap))
    assert got == by_rule(text, size, overlap)
    covered = set()
    for a, z in got:
        b[a:z].decode()
        covered.update(range(a, z))
    assert covered == set(range(len(b)))


def test_partitioning_does_not_matter(spark):
    df = rows(spark, TEXTS)
    want = sorted(map(tuple, chunks(df).collect()))
    for n in (1, 7):
        assert sorted(map(tuple, chunks(df.repartition(n)).collect())) == want


@pytest.mark.parametrize(("size", "overlap"), [(512, 50), (40, 30)])
def test_start_pos_without_a_shuffle(spark, size, overlap):
    df = rows(spark, TEXTS)
    want = sorted(tuple(r) for r in with_start_pos(chunks(df, size, overlap)).collect())
    for way in (chunks, chunks_arrow):
        got = way(df, size, overlap, start_pos=True)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("unit", ["Some words here, and an end. ", "汉字没有标点", "a"])
def test_long_texts_in_time(spark, unit):
    """4 MB: both forms give the same rows, and the fold does not take the square of the length."""
    import time

    one = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr(f"repeat('{unit}', {4_000_000 // len(unit.encode())})").alias("text"))
    start = time.perf_counter()
    got = chunks(one, start_pos=True).agg(F.count(F.lit(1)), F.sum(F.xxhash64("chunk_index", "content", "byte_offset", "start_pos").cast("decimal(38,0)"))).first()
    assert time.perf_counter() - start < 20
    assert got == chunks_arrow(one, start_pos=True).agg(F.count(F.lit(1)), F.sum(F.xxhash64("chunk_index", "content", "byte_offset", "start_pos").cast("decimal(38,0)"))).first()


def test_short_and_long_texts_in_turn(spark):
    texts = ["short", None, "é" * 300, "", "x. " * 400, "z", "é" * 256, "é" * 256 + "y", "last"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in chunks_arrow(docs, start_pos=True).collect()]
    assert got == [tuple(r) for r in chunks(docs, start_pos=True).collect()] and len({g[0] for g in got}) == 21
    assert [tuple(r) for r in chunks_arrow(docs, 1, 0).collect()] == [(i, k, c, len(t[:k].encode())) for i, t in enumerate(texts * 3) for k, c in enumerate(t or "")]
