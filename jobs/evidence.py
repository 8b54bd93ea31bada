"""Finds the passages of a corpus that answer a table of standing questions.

    python -m jobs.evidence --documents PATH --questions PATH --labels PATH --out DIR [--config jobs/evidence.json]

Documents (doc_id, text, lang) but those labelled toxic are cut into chunks and indexed; each question (item_id, text) is
ranked over them by BM25 and keeps its best chunks, at most so many of one document. Below `out`:

    evidence   lang / query_id, rank, doc_id, chunk_index, content, score: Parquet
    questions  query_id, n_evidence, best_score, doc_ids: a row per question, those without evidence too, as CSV
    log        what was read and written, as JSON

A run takes the place of the one before, and the same input gives the same rows: ties go by document and chunk. Questions
without an id are left out, as are documents without id or text; of rows that repeat an id the least text counts.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import word_index_tokens
from corvane.operators import bm25
from corvane.operators.chunking import chunks
from corvane.operators.index import KEY, Index, counted, tokenised
from corvane.sources.shared import drop_since, materialize, shared_paths

log = logging.getLogger("jobs.evidence")
CONFIG = Path(__file__).with_suffix(".json")


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def _once(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """The row with the least text of each id."""
    found = rows.where(F.col(key).isNotNull() & F.col("text").isNotNull()).groupBy(key).agg(F.min(F.struct("text", *more)).alias("r"))
    return found.select(key, "r.*")


def find(docs: DataFrame, questions: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """query_id, rank, doc_id, chunk_index, content, score, lang."""
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    clean = _once(docs.select("doc_id", "text", "lang"), "doc_id", "lang").join(toxic, "doc_id", "left_anti")
    # tables: the index reads the chunks' terms several times, and the best chunks are looked up at the end
    kept = materialize(clean, "evidence-documents")
    cut = materialize(chunks(kept, config["max_bytes"], config["overlap"]).select(*KEY, "content"), "evidence-chunks")
    index = Index.of(materialize(counted(tokenised(cut)), "evidence-index"))
    asked = _once(questions.select("item_id", "text"), "item_id").select(F.col("item_id").alias("query_id"), word_index_tokens(F.col("text")).alias("terms"))
    best = materialize(bm25.search(index, asked, config["k"], per_document=config["per_document"]), "evidence-best")
    return best.join(cut, list(KEY)).join(kept.select("doc_id", "lang"), "doc_id").select("query_id", "rank", *KEY, "content", F.round("bm25_score", 6).alias("score"), "lang")


def run(spark: SparkSession, documents: str, questions: str, labels: str, out: str, config: dict | None = None) -> dict:
    """Writes evidence, questions and log; what the log says."""
    config = config or settings()
    docs, asked, marks = (spark.read.parquet(p) for p in (documents, questions, labels))
    there = shared_paths()
    found = materialize(find(docs, asked, marks, config), "evidence-found")
    found.repartitionByRange("lang", "query_id", "rank").sortWithinPartitions("lang", "query_id", "rank").write.partitionBy("lang").mode("overwrite").parquet(f"{out}/evidence")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"].cast("string"))
    each = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.max("score").alias("best_score"), F.array_join(ids, " ").alias("doc_ids"))
    named = asked.where("item_id is not null").select(F.col("item_id").alias("query_id")).distinct()
    each = named.join(each, "query_id", "left").na.fill({"n_evidence": 0})
    each.repartitionByRange("query_id").sortWithinPartitions("query_id").write.mode("overwrite").option("header", True).csv(f"{out}/questions")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    told = n(docs, "documents").crossJoin(n(marks.where("toxic = 1"), "toxic")).crossJoin(n(asked, "questions")).crossJoin(n(found, "evidence"))
    told.coalesce(1).write.mode("overwrite").json(f"{out}/log")
    drop_since(spark, there)
    said = spark.read.schema(told.schema).json(f"{out}/log").first().asDict()
    log.info("read %s, %s, %s; wrote %s: %s", documents, questions, labels, out, said)
    return said


def evidence(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/evidence").select("query_id", "rank", *KEY, "content", "score", "lang")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "questions", "labels", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("evidence").getOrCreate()
    try:
        run(spark, a.documents, a.questions, a.labels, a.out, settings(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
