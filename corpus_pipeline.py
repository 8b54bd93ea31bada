"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, extra ones too, whatever their names. Between stages the rows are written as
Parquet and read again.

Defined results: null and empty texts, and those without letters, go in the first stage. Repeated
rows and rows without ids are documents like any other: equal and near-equal texts leave one row, that
with the least doc_id, rows without one last. Empty tables give empty results. n_chars is set anew where a
stage changes a text, if it is a column of whole numbers; else it stays as it is. Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, decontaminate, langid, secrets, simhash
from corvane.llm.common import drop_path, drop_since, fresh_path, shared_paths, table
from corvane.llm.queries import RANKS


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model rejects texts without letters and those whose
    best calibrated probability is below 0.4."""
    return langid.keep_confident(docs, langid.train(docs, langid.may_learn()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of shingles of five words have a Jaccard similarity of
    0.8 or more, directly or through others."""
    return simhash.dedup(docs, simhash.SIMILAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those of which over half is such go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, ids and offsets of every document."""
    return bpe.encode(docs, RANKS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_spans),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder, and go when the next stage's are there; a stage's
    own intermediate tables go with its end."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        there, path = shared_paths(), fresh_path(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        drop_since(spark, there, path)
        if last:
            drop_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
