"""What follows a search: filters, facets, a cap per document, summaries, context."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.metadata import court_level
from corvane.functions.text import contains_any, latin1, two_places

ALL = "全部"
KEY_VARIABLE = "CORVANE_API_KEY"
# Words of questions about all documents; the labels and texts of summaries, result
# lines and contexts.
AGGREGATE_WORDS = "这些案件 所有案件 全部案件 各案件 各个案件 每个案件 这些文档 所有文档 全部文档 各文档 这些文件 所有文件 哪些案件 汇总 统计 总共 一共".split()
LABELS = {"case_number": "案号", "court": "法院", "case_type": "类型", "date": "日期", "procedure": "程序", "litigants": "当事人"}
ROLLUP_TAIL = "\n（以上为全部 %d 个已导入文档的元数据汇总）\n"
RESULT_LINE = "【%d】%s  相关度: %s  (BM25: %s | 向量: %s)"
HEADER = "以下是与用户问题相关的文档内容：\n\n"
SOURCE_LINE = "【来源 %d】%s (相关度: %s)\n"
PREVIEW = 200
#: What a summary of all documents may take of a prompt, in bytes.
ROLLUP_BYTES = 1 << 20


def filtered(results: DataFrame, metadata: DataFrame, case_type: str = ALL, level: str = ALL, year: str = ALL) -> DataFrame:
    """Rows whose document meets every active filter; documents without metadata meet none.
    level: 最高, 高级, 中级 or 基层, with or without 人民法院."""
    active = []
    if case_type != ALL:
        active.append(F.col("case_type") == case_type)
    if level != ALL:
        wanted = level.removesuffix("人民法院")
        own = court_level(F.col("court"))
        active.append(own == "基层" if wanted == "基层" else F.col("court").contains(wanted))
    if year != ALL:
        active.append(F.substring("date", 1, 4) == year)
    if not active:
        return results
    meets = active[0]
    for a in active[1:]:
        meets = meets & a
    return results.join(metadata.where(meets).select("doc_id"), "doc_id", "left_semi").select(*results.columns)


def year_facet(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """The years of the results' documents, sorted."""
    dates = metadata.join(results.select("doc_id").distinct(), "doc_id", "left_semi").where(F.length("date") >= 4)
    return dates.select(F.substring("date", 1, 4).alias("year")).distinct().orderBy("year")


def asks_aggregate(query: Column) -> Column:
    return contains_any(query, AGGREGATE_WORDS)


def per_doc_cap(results: DataFrame, limit: int = 2, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first `limit` rows of each document, by rank."""
    order = W.partitionBy(*by).orderBy("rank")
    return results.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def summary_line() -> Column:
    """`- id | label: value | ...` of what is there."""
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f" | {label}: "), F.col(c))).otherwise("") for c, label in LABELS.items()]
    return F.concat(F.lit("- "), F.col("doc_id").cast("string"), *parts)


def _known() -> Column:
    return (F.col("case_number") != "") | (F.col("court") != "") | (F.col("date") != "")


def rollup_lines(metadata: DataFrame) -> DataFrame:
    """doc_id, line: one for each document with metadata, however many there are."""
    return metadata.where(_known()).select("doc_id", summary_line().alias("line"))


def metadata_rollup(metadata: DataFrame, max_bytes: int = ROLLUP_BYTES) -> DataFrame:
    """One row for one prompt: the lines of the documents with metadata, by id, as far as they fit into
    max_bytes, and the number of all of them. `rollup_lines` has every line."""
    lines = rollup_lines(metadata)
    # a line takes 5 bytes at least, so no more can fit; the first by id are found without sorting all
    first = lines.orderBy("doc_id").limit(max_bytes // 5)
    upto = F.sum(F.octet_length("line") + 1).over(W.orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0))
    fitting = first.withColumn("upto", upto).where(F.col("upto") <= max_bytes)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    body, all_ = fitting.agg(text.alias("body")), lines.agg(F.count(F.lit(1)).alias("n_docs"))
    tail = F.format_string(ROLLUP_TAIL, F.col("n_docs"))
    # one row each
    return body.crossJoin(all_).select(F.when(F.col("n_docs") > 0, F.concat("body", tail)).otherwise("").alias("summary"), "n_docs")


def metadata_summary(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: a line for each document of the results, in the order of their best ranks."""
    first = results.groupBy("doc_id").agg(F.min("rank").alias("rank"))
    lines = first.join(metadata.where(_known()), "doc_id").select("rank", summary_line().alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return lines.agg(body.alias("summary"))


def result_lines(results: DataFrame) -> DataFrame:
    """rank, line, preview: the first 200 characters, `...` behind if the content has over 200 bytes."""
    line = F.format_string(RESULT_LINE, F.col("rank"), F.col("doc_id").cast("string"), *(two_places(F.col(c)) for c in ("final_score", "bm25_score", "vector_score")))
    preview = F.concat(F.substring("content", 1, PREVIEW), F.when(F.octet_length("content") > PREVIEW, "...").otherwise(""))
    return results.select("rank", line.alias("line"), preview.alias("preview"))


def _head(content: Column, n: Column) -> Column:
    """The first n bytes, less a character that they would split."""
    byte = latin1(F.encode(content, "UTF-8"))
    kept = F.substring(byte, F.lit(1), n)
    split = F.substring(byte, n + 1, F.lit(1)).rlike(r"[\x80-\xBF]")
    return F.decode(F.encode(F.when(split, F.regexp_replace(kept, r"[\xC0-\xFF][\x80-\xBF]*\z", "")).otherwise(kept), "ISO-8859-1"), "UTF-8")


def build_context(results: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """One row: the results' contents by rank, four bytes a token, cut where the budget ends. The
    number of results is the search's k."""
    budget = max_tokens * 4
    before = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    sized = results.select("rank", "doc_id", "content", "final_score", F.octet_length("content").alias("n"))
    placed = sized.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int")).where(F.col("before") < budget)
    text = F.when(F.col("before") + F.col("n") > budget, F.concat(_head(F.col("content"), F.lit(budget) - F.col("before")), F.lit("..."))).otherwise(F.col("content"))
    head = F.format_string(SOURCE_LINE, F.row_number().over(W.orderBy("rank")), F.col("doc_id").cast("string"), two_places(F.col("final_score")))
    entry = F.concat(head, text, F.lit("\n\n"))
    entries = F.array_sort(F.collect_list(F.struct("rank", "entry")))
    return placed.select("rank", entry.alias("entry")).agg(F.concat(F.lit(HEADER), F.array_join(F.transform(entries, lambda x: x["entry"]), "")).alias("context"))


def is_api_key(key: Column) -> Column:
    """Begins with sk-, has 20 characters or more, letters, digits and hyphens only."""
    return F.coalesce(key.rlike(r"\Ask-[a-zA-Z0-9\-]*\z") & (F.octet_length(key) >= 20), F.lit(False))


def key_from_environment(*names: str) -> str:
    """The first of these variables that is set and not blank; the empty string if none is."""
    return next((v for n in names or (KEY_VARIABLE,) if (v := os.environ.get(n, "").strip())), "")


def check_api_key(key: str) -> bool:
    return len(key) >= 20 and bool(re.fullmatch(r"sk-[a-zA-Z0-9\-]*", key))
