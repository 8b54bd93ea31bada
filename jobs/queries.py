"""The jobs as queries: each runs twice into a folder of its own, which stays."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans.oracle import CHUNKS, MANY, SCORED, STATS, TOK, tokens
from corvane.sources.shared import shared_dir
from jobs import evidence, index_feed


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def job1_index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "index_feed")
    for _ in range(2):
        index_feed.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return index_feed.postings(spark, f"{at}/out")


def job2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "evidence")
    for _ in range(2):
        evidence.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "labels")), at)
    return evidence.evidence(spark, at)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_index_feed": job1_index_feed, "job2_evidence": job2_evidence}

#: Of documents that share an id the least text.
_ONCE = "once AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL{} GROUP BY doc_id)"
_CLEAN = " AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"


def _cut(which: str) -> str:
    """The chunks of such documents, c, and their tokens, tok; a chunk is named by doc_id and chunk_index."""
    own = CHUNKS.replace("WITH RECURSIVE d AS", f"WITH RECURSIVE {_ONCE.format(which)}, d AS").replace("FROM documents", "FROM once", 2).replace("min(text) AS text FROM once", "min(text) AS text FROM documents")
    return own + f", tok AS (SELECT (doc_id, chunk_index) AS doc_id, {tokens('content')} AS t FROM c)"


_STATS = STATS[len(TOK) :]
ORACLE = {
    "job1_index_feed": _cut("") + _STATS + " SELECT term, post.doc_id[1] AS doc_id, post.doc_id[2] AS chunk_index, tf, dl FROM post JOIN st ON st.doc_id = post.doc_id",
    "job2_evidence": _cut(_CLEAN)
    + _STATS
    + f", {MANY}, {SCORED}, nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id[1] ORDER BY round(s, 9) DESC, doc_id[2]) AS n FROM sc), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS r FROM nth WHERE n <= 2) "
    "SELECT query_id, CAST(r AS INTEGER) AS rank, rk.doc_id[1] AS doc_id, rk.doc_id[2] AS chunk_index, content, round(s, 6) AS score, lang "
    "FROM rk JOIN c ON c.doc_id = rk.doc_id[1] AND c.chunk_index = rk.doc_id[2] JOIN documents ON documents.doc_id = rk.doc_id[1] WHERE r <= 10",
}
