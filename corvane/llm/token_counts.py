"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, content, n_tokens): `content` is the SHA-256 of the
text as it is encoded (null: empty), `tokenizer` the SHA-256 of the tokenizer's file and its
library's version. Contents that have no stored count are encoded once each, whatever the
number of their copies, and appended; then every row is joined to its count. A run that is
broken off leaves the cache as it was or with more counts, never with wrong ones.

Which rows to encode is settled on digests alone: of each missing content the row with the
least doc_id is taken, and the texts move once, spread by doc_id and content, so a text with
thousands of copies does not gather anywhere.

Defined results: a null or empty text has 0 bytes and 0 tokens. Null or repeated doc_ids do no
harm; repeated rows come back repeated. Empty tables give empty results. Extra columns are
ignored. Whole texts are encoded, without truncation, padding or added special tokens.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import arrow_batch, fresh_path, materialize, pick, slices

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"


@lru_cache(4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return lambda texts: [len(e) for e in found.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    version = tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__
    return hashlib.sha256(Path(path).read_bytes() + version.encode()).hexdigest()


def stored(docs: DataFrame, cache_path: str, tokenizer: str) -> DataFrame:
    """content, n_tokens of the cache; appends that ran at one time may have left a content twice."""
    try:
        cache = docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException:  # there is none yet
        return docs.sparkSession.createDataFrame([], "content binary, n_tokens long")
    return cache.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def content(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def encode_misses(docs: DataFrame, rows: DataFrame, cache_path: str, tokenizer_path: str, tokenizer: str) -> None:
    """Appends the counts of contents of rows that the cache lacks."""
    lacking = rows.groupBy("content").agg(F.min("doc_id").alias("first")).join(stored(docs, cache_path, tokenizer), "content", "left_anti")
    lacking = lacking.select(F.col("content").alias("__content"), F.col("first").alias("__first"))
    # the side that is built holds digests only; texts stream past it unsorted
    texts = docs.withColumn("content", content()).join(
        lacking.hint("shuffle_hash"), (F.col("content") == F.col("__content")) & F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi"
    )
    schema = pa.schema([("content", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(tokenizer_path)
        for batch in slices(batches, "text"):
            new: dict[bytes, str] = {}
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.setdefault(key, text or "")
            yield arrow_batch([list(new), count(list(new.values()))], schema)

    counted = texts.select("text", "content").mapInArrow(run, "content binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. Without cache_path the run has a cache of its own
    in the shared folder, empty at first."""
    cache_path = cache_path or fresh_path(docs.sparkSession, "token-cache")
    own = pick(docs, id_col, text_col).toDF("doc_id", "text")
    rows = own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), content().alias("content"))
    rows = materialize(rows, "token-rows")
    tokenizer = tokenizer_digest(tokenizer_path)
    encode_misses(own, rows, cache_path, tokenizer_path, tokenizer)
    # a table of its own, so that Spark may split the rows of a content with very many copies
    counts = rows.join(materialize(stored(docs, cache_path, tokenizer), "token-counts"), "content")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
