"""The engine's functions by name, for SQL: lex_tokens, pdf_text, case_number, court, judgment_date, ..."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.functions.segment import DEFAULT, Cutter, in_slices
from corvane.operators.vector import EmbeddingProvider, HashingProvider
from corvane.sources.pdf import text_of

#: SQL bodies over one text; they are inlined by Catalyst, no Python runs.
TEXT_FUNCTIONS = {
    "ascii_lower": ("string", "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
    "word_tokens": ("array<string>", r"regexp_extract_all(coalesce(t, ''), '[A-Za-z0-9\\x{80}-\\x{10FFFF}]+', 0)"),
    "court_level": ("string", "CASE WHEN coalesce(t, '') = '' THEN '' WHEN contains(t, '最高') THEN '最高' WHEN contains(t, '高级') THEN '高级' WHEN contains(t, '中级') THEN '中级' ELSE '基层' END"),
}
COSINE = """CASE WHEN size(a) = size(b) AND size(a) > 0 AND sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) >= 1e-12
    THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) ELSE 0D END"""


def register(spark: SparkSession, lexicon: Iterable[str] = DEFAULT, embedding: EmbeddingProvider | None = None) -> list[str]:
    """Registers temporary functions; returns their names."""
    for name, (kind, body) in TEXT_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {COSINE}")
    held, provider = spark.sparkContext.broadcast(Cutter(lexicon)), embedding or HashingProvider()

    @F.arrow_udf("array<string>")
    def lex_tokens(texts: pa.Array) -> pa.Array:
        return in_slices(texts, held.value.many, pa.list_(pa.string()))

    @F.arrow_udf("string")
    def pdf_text(contents: pa.Array) -> pa.Array:
        return in_slices(contents, lambda some: map(text_of, some), pa.string())

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda some: provider.embed([t or "" for t in some]), pa.list_(pa.float64()))

    for name, f in (("lex_tokens", lex_tokens), ("pdf_text", pdf_text), ("embed", embed)):
        spark.udf.register(name, f)
    return [*TEXT_FUNCTIONS, "cosine", "lex_tokens", "pdf_text", "embed"]
