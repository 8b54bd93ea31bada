"""Hybrid ranking: BM25 and cosine candidates, each divided by its best, summed by weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import contains_any

BM25_WEIGHT, VECTOR_WEIGHT = 0.4, 0.6
# Questions about a place, and the terms that judgments use for one.
LOCATION_WORDS = "哪里 哪儿 何处 在哪".split()
LOCATION_TERMS = "住所地 住址 所在地 地址 坐落于".split()


def depth(k: int) -> int:
    """Candidates of each side."""
    return max(2 * k, 10)


def asks_place(query: Column) -> Column:
    return contains_any(query, LOCATION_WORDS)


def expand_terms(query: Column, terms: Column) -> Column:
    """Terms with those for a place behind them, if the query asks for one; none twice."""
    more = F.filter(F.array(*[F.lit(t) for t in LOCATION_TERMS]), lambda t: ~F.array_contains(terms, t))
    return F.when(asks_place(query), F.concat(terms, more)).otherwise(terms)


def fuse(bm25: DataFrame, vector: DataFrame, k: int | None = None, weights: Sequence[float] = (BM25_WEIGHT, VECTOR_WEIGHT), keys: Sequence[str] = ("query_id", "doc_id", "chunk_index")) -> DataFrame:
    """bm25: keys, bm25_score; vector: keys, vector_score. Adds final_score and rank. A side's best
    is 0 at least, so negative cosines stay negative. Union and sum take one shuffle where a full
    outer join takes two; both sides hold candidates only."""
    none = F.lit(None).cast("double")
    both = bm25.select(*keys, "bm25_score", none.alias("vector_score")).unionByName(vector.select(*keys, none.alias("bm25_score"), "vector_score"))
    merged = both.groupBy(*keys).agg(F.coalesce(F.max("bm25_score"), F.lit(0.0)).alias("bm25_score"), F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("vector_score"))
    query = W.partitionBy(keys[0])
    part = lambda c: F.when(F.max(c).over(query) > 0, F.col(c) / F.max(c).over(query)).otherwise(0.0)
    scored = merged.withColumn("final_score", weights[0] * part("bm25_score") + weights[1] * part("vector_score"))
    ranked = scored.withColumn("rank", F.row_number().over(query.orderBy(F.desc(F.round("final_score", 9)), *keys[1:])))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def fallback(bm25: DataFrame, k: int, keys: Sequence[str] = ("query_id", "doc_id", "chunk_index")) -> DataFrame:
    """Without vectors: the score is BM25's own, undivided."""
    order = W.partitionBy(keys[0]).orderBy(F.desc(F.round("bm25_score", 9)), *keys[1:])
    out = bm25.select(*keys, "bm25_score", F.lit(0.0).alias("vector_score"), F.col("bm25_score").alias("final_score"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
