"""The engine's operators as queries over the driver's tables, each over whole tables.

Documents stand for chunks where chunking is not the point (chunk_index 0). Judgments are composed
from orders and customers by one SQL expression that both engines read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import metadata as meta
from corvane.functions.segment import lexicon_lines, segmented, with_user_words
from corvane.functions.text import STOP_WORDS, contains_any, index_tokens, word_index_tokens, word_tokens
from corvane.functions.vectors import cosine
from corvane.operators import bm25, hybrid, lexicon, prompts, results, vector
from corvane.operators.chunking import chunks
from corvane.operators.index import Index, corpus_stats, counted, counted_words, doc_freq, postings, tokenised
from corvane.operators.index import chunk_stats as index_lengths
from corvane.operators.stored import StoredIndex
from corvane.plans.engine import Engine
from corvane.plans.sql import register
from corvane.sources import files
from corvane.sources.shared import fresh_path, materialize
from corvane.sources.tables import table
from corvane.streaming.events import texts

QUERY = "the thanedble attion ononble erstly ononble"
K = 10


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "lang")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d)
    return rows.select("doc_id", F.lit(0).alias("chunk_index"), word_index_tokens(F.col("text")).alias("tokens"))


def _whole(docs: DataFrame) -> DataFrame:
    """Documents as chunks."""
    return docs.select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))


def _index(spark: SparkSession, d: str) -> Index:
    """A table in the shared folder; postings, lengths and statistics read it in turn."""
    return Index.of(materialize(counted(_tokens(spark, d)), "index"))


def _one_query(spark: SparkSession, text: str = QUERY) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, query string").withColumn("terms", word_index_tokens(F.col("query")))


def _benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), word_index_tokens(F.col("text")).alias("terms"))


def _six(c: str):
    return F.round(c, 6)


# ---- sources, chunks, tokens, index

def pages_text(spark, d):
    return files.text_status(table(spark, d, "pages"), "page_id", "html")


def import_tally(spark, d):
    rows = _docs(spark, d)
    status = files.text_status(rows, "doc_id", "text").withColumn("diagnostic", F.lit(""))
    return files.import_tally(files.import_log(status.join(rows, "doc_id"), chunks(rows)))


def chunk_table(spark, d):
    return chunks(_docs(spark, d))


def chunk_offsets(spark, d):
    return chunks(_docs(spark, d), start_pos=True).select("doc_id", "chunk_index", "start_pos", "byte_offset")


def tokens_filtered(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def term_freq(spark, d):
    return postings(_tokens(spark, d)).select("term", "doc_id", "tf")


def doc_frequency(spark, d):
    return doc_freq(postings(_tokens(spark, d)))


def chunk_stats(spark, d):
    return index_lengths(_tokens(spark, d)).select("doc_id", "dl")


def corpus_statistics(spark, d):
    idx = _index(spark, d)
    return corpus_stats(idx.chunk_stats).crossJoin(idx.size().select("terms")).select("n", F.round("avgdl", 6).alias("avgdl"), "terms")


def postings_lookup(spark, d):
    idx = _index(spark, d)
    return idx.doc_length(idx.lookup("ononble", "thanedble")).select("term", "doc_id", "tf", "dl")


# ---- ranking

def bm25_topk(spark, d):
    found = bm25.search(_index(spark, d), _one_query(spark), K)
    return found.select("doc_id", "rank", _six("bm25_score").alias("bm25_score"))


def bm25_multi_query(spark, d):
    found = bm25.search(_index(spark, d), _benchmark_queries(spark, d), 5)
    return found.select("query_id", "doc_id", _six("bm25_score").alias("bm25_score"))


def bm25_score_single(spark, d):
    idx = _index(spark, d)
    one = idx.lookup("ononble").agg(F.min("doc_id").alias("doc_id")).withColumn("chunk_index", F.lit(0))
    return bm25.score(idx, _one_query(spark), one).select("doc_id", _six("bm25_score").alias("bm25_score"))


def bm25_chunks(spark, d):
    idx = Index.of(materialize(counted(tokenised(chunks(_docs(spark, d)))), "index"))
    found = bm25.search(idx, _one_query(spark), K)
    return found.select("doc_id", "chunk_index", _six("bm25_score").alias("bm25_score"))


def _stored(spark, d, **options) -> StoredIndex:
    return StoredIndex(spark, fresh_path(spark, "stored-index"), **options)


def bm25_pruned(spark, d):
    """The benchmark as queries against an index on disk, blocks skipped by their bounds."""
    return bm25.search_pruned(_stored(spark, d).add(counted_words(_whole(_docs(spark, d))), 1), _benchmark_queries(spark, d), 5).found.select("query_id", "doc_id", _six("bm25_score").alias("bm25_score"))


def _grown(spark, d) -> StoredIndex:
    """An index of three batches, the last of which replaces a fifth of the documents."""
    index, rows = _stored(spark, d), _docs(spark, d)
    again = F.concat(F.lit("replaced "), F.col("doc_id").cast("string"), F.lit("x again")).alias("text")
    for batch, part in enumerate((rows.where("doc_id % 3 < 2"), rows.where("doc_id % 3 = 2"), rows.where("doc_id % 5 = 0").select("doc_id", again)), 1):
        index.add(counted_words(_whole(part)), batch)
    return index


def stored_doc_freq(spark, d):
    return _grown(spark, d).doc_freq


def stored_stats(spark, d):
    index = _grown(spark, d)
    return index.corpus_stats.crossJoin(index.size().select("terms", "docs")).select("n", F.round("avgdl", 6).alias("avgdl"), "terms", "docs")


def stored_lookup(spark, d):
    return _grown(spark, d).index().lookup("ononble", "replaced").select("term", "doc_id", "tf", "dl")


def cosine_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id = 0").select("embedding").first()[0]
    return vector.top_k(v, asked, K).select("vec_id", _six("similarity").alias("similarity"))


def vector_multi_query(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vector.search(v, asked, 5).select("query_id", "vec_id", _six("similarity").alias("similarity"))


def vectors_missing(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"))
    cut = _docs(spark, d).select("doc_id", F.lit(0).alias("chunk_index"))
    return vector.missing(cut, have).select("doc_id")


def _sides(spark, d):
    words = bm25.search(_index(spark, d), _one_query(spark), hybrid.depth(K)).drop("rank")
    v = table(spark, d, "embeddings")
    near = vector.top_k(v, v.where("vec_id = 0").select("embedding").first()[0], hybrid.depth(K))
    return words, near.select(F.lit(0).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("similarity").alias("vector_score"))


def hybrid_topk(spark, d):
    found = hybrid.fuse(*_sides(spark, d), k=K)
    return found.select("doc_id", "rank", *(_six(c).alias(c) for c in ("bm25_score", "vector_score", "final_score")))


def hybrid_fallback(spark, d):
    words = bm25.search(_index(spark, d), _one_query(spark), hybrid.depth(K)).drop("rank")
    return hybrid.fallback(words, K).select("doc_id", "rank", *(_six(c).alias(c) for c in ("bm25_score", "vector_score", "final_score")))


#: Questions composed from customers, for the tests of intent and expansion.
QUESTION = """(CASE c_custkey % 5 WHEN 0 THEN '这个案子发生在哪里 ' WHEN 1 THEN '汇总 所有案件 ' WHEN 2 THEN '原告住在何处 住址 ' WHEN 3 THEN '统计判决 ' ELSE 'where is the office ' END || c_name)"""


def _questions(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.expr(QUESTION).alias("query"))


def expand_terms(spark, d):
    terms = F.split("query", " ")
    return _questions(spark, d).select("query_id", F.array_join(hybrid.expand_terms(F.col("query"), terms), " ").alias("terms"))


def intents(spark, d):
    q = F.col("query")
    return _questions(spark, d).select("query_id", hybrid.asks_place(q).alias("asks_place"), results.asks_aggregate(q).alias("asks_aggregate"), prompts.is_legal(q).alias("is_legal"))


# ---- judgments

CN = "translate(CAST({} AS STRING), '0123456789', '〇一二三四五六七八九')"
CN_SMALL = (
    "(CASE WHEN {0} < 10 THEN translate(CAST({0} AS STRING), '123456789', '一二三四五六七八九') WHEN {0} = 10 THEN '十' "
    "WHEN {0} < 20 THEN '十' || translate(CAST({0} - 10 AS STRING), '123456789', '一二三四五六七八九') WHEN {0} % 10 = 0 THEN "
    "translate(substring(CAST({0} AS STRING), 1, 1), '123456789', '一二三四五六七八九') || '十' ELSE translate(substring(CAST({0} AS STRING), 1, 1), '123456789', '一二三四五六七八九') "
    "|| '十' || translate(substring(CAST({0} AS STRING), 2, 1), '123456789', '一二三四五六七八九') END)"
)
COURT = "(CASE o_custkey % 6 WHEN 0 THEN '中国最高人民法院' WHEN 1 THEN '广东省高级人民法院' WHEN 2 THEN '北京市第一中级人民法院' WHEN 3 THEN '上海市浦东新区人民法院' WHEN 4 THEN '不服南京市秦淮区人民法院' ELSE '某某机关' END)"
NUMBER = "('（' || CAST(year(o_orderdate) AS STRING) || '）京' || CAST(o_custkey % 1000 AS STRING) || (CASE o_orderkey % 7 WHEN 0 THEN '民初' WHEN 1 THEN '刑终' WHEN 2 THEN '行再' WHEN 3 THEN '知民申' WHEN 4 THEN '破监' WHEN 5 THEN '执复' ELSE '国赔' END) || CAST(o_orderkey AS STRING) || '号')"
PARTIES = "(CASE o_orderkey % 4 WHEN 0 THEN '原告：张某某，男。被告：李某，女。' WHEN 1 THEN '公诉机关：某检察院。' WHEN 2 THEN '原告赵某。' ELSE '申请人某公司，上诉。' END)"
DATED = (
    "(CASE o_orderkey % 3 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) || '年' || CAST(month(o_orderdate) AS STRING) || '月' || CAST(day(o_orderdate) AS STRING) || '日' "
    "WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING) "
    "ELSE " + CN.format("year(o_orderdate)") + " || '年' || " + CN_SMALL.format("month(o_orderdate)") + " || '月' || " + CN_SMALL.format("day(o_orderdate)") + " || '日' END)"
)
JUDGMENT = f"({COURT} || ' 民事判决书 ' || (CASE WHEN o_orderkey % 11 = 0 THEN '无案号' ELSE {NUMBER} END) || ' ' || {PARTIES} || ' 审判员 ' || {DATED})"


def _judgments(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(JUDGMENT).alias("text"))


def _metadata(spark, d):
    return meta.with_metadata(_judgments(spark, d)).drop("text")


def case_number(spark, d):
    return _metadata(spark, d).select("doc_id", "case_number")


def court(spark, d):
    return _metadata(spark, d).select("doc_id", "court", meta.court_level(F.col("court")).alias("court_level"))


def judgment_date(spark, d):
    return _metadata(spark, d).select("doc_id", "date")


def case_type(spark, d):
    return _metadata(spark, d).select("doc_id", "case_type", "procedure")


def litigants(spark, d):
    return _metadata(spark, d).select("doc_id", "litigants")


def doc_metadata(spark, d):
    return meta.doc_metadata(_judgments(spark, d))


def _results(spark, d):
    """A result for each order, in place of a search's."""
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("rank"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("final_score"))


def _best(spark, d, k=20):
    """The k dearest orders, as many results as a search has."""
    o = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(k)
    return o.select(F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("final_score"))


def filter_conj(spark, d):
    return results.filtered(_results(spark, d), meta.doc_metadata(_judgments(spark, d)), "民事", "高级人民法院", "1995").select("doc_id", "rank")


def year_facet(spark, d):
    return results.year_facet(_results(spark, d), meta.doc_metadata(_judgments(spark, d)))


def per_doc_cap(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("rank"))
    return results.per_doc_cap(line)


def metadata_rollup(spark, d):
    return results.metadata_rollup(meta.doc_metadata(_judgments(spark, d)))


def rollup_lines(spark, d):
    return results.rollup_lines(meta.doc_metadata(_judgments(spark, d)))


def metadata_summary(spark, d):
    found = _best(spark, d)
    return results.metadata_summary(found, meta.doc_metadata(_judgments(spark, d).join(found.select("doc_id"), "doc_id", "left_semi")))


def _hits(rows):
    """Documents as results: ranked by their ids, with scores made from these."""
    return rows.select((F.col("doc_id") + 1).cast("int").alias("rank"), "doc_id", F.col("text").alias("content"), (F.col("doc_id") / 8 + 1).alias("final_score"), F.lit(0.25).alias("bm25_score"), F.lit(0.75).alias("vector_score"))


def result_lines(spark, d):
    return results.result_lines(_hits(_docs(spark, d)))


def build_context(spark, d):
    """Of as many results as a search has."""
    return results.build_context(_hits(_docs(spark, d).orderBy("doc_id").limit(20)))


def legal_route(spark, d):
    t = F.col("text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" 判决"))).otherwise(F.col("text")).alias("text"))
    return rows.select("conv_id", "turn", prompts.is_legal(t).alias("is_legal"), prompts.system_prompt(t).alias("system"))


def prompt(spark, d):
    rows = table(spark, d, "conversations")
    c = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" 判决"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", prompts.prompt(F.col("role"), c, F.when(F.col("conv_id") % 2 == 0, "元数据").otherwise("")).alias("prompt"))


def request_body(spark, d):
    rows = table(spark, d, "region")
    body = prompts.request_body(F.col("r_name"), F.col("r_name"))
    return rows.select("r_regionkey", F.get_json_object(body, "$.messages[1].content").alias("user"), F.get_json_object(body, "$.stream").alias("stream"), F.get_json_object(body, "$.max_tokens").alias("max_tokens"))


#: A line of an event stream for each event.
SSE = """(CASE event_id % 5 WHEN 0 THEN ': ping' WHEN 1 THEN 'data: [DONE]' WHEN 2 THEN 'data: {bad' ELSE 'data: {"choices":[{"delta":{"content":"' || event_type || ' "}}]}' END)"""


def sse_concat(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.expr(SSE).alias("line"))
    return prompts.sse_text(rows, by="user_id")


def stream_texts(spark, d):
    """Each user's events as one event stream, cut every 37 bytes, wherever that is, and read as a stream with state."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.expr(SSE).alias("line")).where("line <> 'data: [DONE]'")
    whole = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), F.lit("data: [DONE]"), F.lit("data: not heard"))
    streams = rows.groupBy("user_id").agg(F.encode(whole, "UTF-8").alias("b"))
    cut = streams.select(F.col("user_id").alias("stream_id"), "b", F.explode(F.expr("sequence(0L, (octet_length(b) - 1) div 37)")).alias("seq"))
    pieces = cut.select("stream_id", "seq", F.expr("substring(b, cast(seq * 37 + 1 as int), 37)").alias("piece"))
    at = fresh_path(spark, "stream-texts")
    pieces.repartition(4, F.pmod(F.hash("stream_id", "seq"), F.lit(97))).write.parquet(f"{at}/pieces")
    stream = texts(spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/pieces"))
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    # a state store for each core is enough here; the number stays with the checkpoint
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        stream.writeStream.format("parquet").option("path", f"{at}/texts").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    found = spark.read.schema(stream.schema).parquet(f"{at}/texts")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return found.groupBy(F.col("stream_id").alias("user_id")).agg(F.array_join(parts, "").alias("text"), F.max("ended").alias("ended"))


def parse_delta(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(SSE).alias("line"))
    return rows.select("event_id", prompts.line_delta(F.col("line")).alias("text"))


KEYS = "(CASE c_custkey % 4 WHEN 0 THEN 'sk-' || c_name || '-0123456789' WHEN 1 THEN 'sk-0123456789abcdef' || CAST(c_custkey + 1000 AS STRING) WHEN 2 THEN 'sk-' || CAST(c_custkey AS STRING) ELSE c_name || c_name END)"


def api_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", results.is_api_key(F.expr(KEYS)).alias("valid"))


def stop_word_share(spark, d):
    """Tokens before and after the filters, by language."""
    rows = _docs(spark, d).select("lang", word_tokens(F.col("text")).alias("t"))
    return rows.groupBy("lang").agg(F.sum(F.size("t")).alias("n_tokens"), F.sum(F.size(index_tokens(F.col("t")))).alias("n_indexed"))


def marked_documents(spark, d):
    """Documents that hold one of a list of words."""
    return _docs(spark, d).where(contains_any(F.col("text"), ["password", "license", "Copyright"])).select("doc_id")


# ---- files

NAMED = "'/in/' || CAST(doc_id AS STRING) || (CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.json' ELSE '' END)"


def _files(spark, d):
    return _docs(spark, d).select(F.expr(NAMED).alias("path"), F.encode("text", "UTF-8").alias("content"))


def file_texts(spark, d):
    return files.parse(_files(spark, d)).select("doc_id", "status", "source", "text")


def file_chunks(spark, d):
    return chunks(files.parse(_files(spark, d)).where("status = 'Success'"))


def _stream(body, filters: bytes) -> object:
    return F.concat(F.lit(b"obj << /Filter [" + filters + b"] >>\nstream\n"), body, F.lit(b"\nendstream\nendobj\n"))


def pdf_texts(spark, d):
    """Parts as PDFs: literals, hexadecimal strings, arrays, moves, UTF-16, and streams packed in each way."""
    text = lambda c: F.col(c).cast("binary")
    shown = F.concat(F.lit(b"BT ("), text("p_name"), F.lit(b") Tj 0 -20 Td [("), text("p_brand"), F.lit(b") -30 ("), text("p_type"), F.lit(b")] TJ T* <"), F.hex(text("p_brand")).cast("binary"), F.lit(rb"> Tj (\101\(\)) ' ET"))
    wide = F.concat(F.lit(b"BT <FEFF"), F.hex(F.encode(F.lit("中文😀"), "UTF-16BE")).cast("binary"), F.lit(b"> Tj ET"))
    packed = zlib.compress(b"BT (packed) Tj ET")
    more = F.when(F.col("p_partkey") % 3 == 0, _stream(F.lit(packed), b"/FlateDecode")).when(F.col("p_partkey") % 3 == 1, _stream(F.lit(base64.a85encode(packed) + b"~>"), b"/ASCII85Decode /FlateDecode"))
    more = more.otherwise(_stream(F.lit(base64.a85encode(b"BT (packed) Tj ET") + b"~>"), b"/ASCII85Decode"))
    content = F.concat(F.lit(b"%PDF-1.4\n1 0 "), _stream(shown, b""), F.lit(b"2 0 "), _stream(wide, b""), F.lit(b"3 0 "), more, F.lit(b"%%EOF"))
    found = files.parse(table(spark, d, "part").select(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), content.alias("content")))
    return found.select("doc_id", "status", "source", "text")


# ---- words, index, vectors

MORE_STOP_WORDS = ("ononble", "thanedble")
WORD_LINES = "(CASE n_nationkey % 4 WHEN 0 THEN '# ' || n_name WHEN 1 THEN '  ' || replace(n_name, ' ', '_') || ' ' || CAST(n_nationkey AS STRING) || ' n ' WHEN 2 THEN replace(n_name, ' ', '_') || chr(9) || '7' ELSE replace(n_name, ' ', '_') END)"


def more_stop_words(spark, d):
    tokens = word_index_tokens(F.col("text"), [*STOP_WORDS, *MORE_STOP_WORDS])
    return _docs(spark, d).select("doc_id", F.array_join(tokens, " ").alias("tokens"))


def user_words(spark, d):
    return lexicon_lines(table(spark, d, "nation").select(F.expr(WORD_LINES).alias("value")))


def index_cleared(spark, d):
    return _index(spark, d).clear().size()


def vectors_added(spark, d):
    """A tenth of the vectors once more, turned round and under other ids, and who is next to the first one's opposite."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    more = v.where("vec_id % 10 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    asked = [-x for x in v.where("vec_id = 0").select("embedding").first()[0]]
    return vector.top_k(vector.add(v, more), asked, K).select("vec_id", _six("similarity").alias("similarity"))


def vectors_current(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"))
    cut = _docs(spark, d).where("doc_id % 3 > 0").select("doc_id", F.lit(0).alias("chunk_index"))
    return vector.current(cut, have).select("doc_id")


def vector_misses(spark, d):
    """The different contents that have to be asked for, when those of a third of the documents are stored."""
    rows = _docs(spark, d).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    model = vector.model_of(vector.HashingProvider())
    stored = vector.embed_contents(vector.misses(rows.where("doc_id % 3 = 0"), None, model), vector.HashingProvider(), model)
    return vector.misses(rows, materialize(stored, "vectors"), model)


def sql_functions(spark, d):
    """Functions that are registered for SQL."""
    register(spark)
    body = F.concat(F.lit("BT ("), F.expr("regexp_replace(substring_index(text, '.', 1), '[^A-Za-z ]', '')"), F.lit(") Tj ET"))
    pdf = F.concat(F.lit(b"%PDF-1.4\n1 0 "), _stream(F.encode(body, "UTF-8"), b""), F.lit(b"%%EOF"))
    return _docs(spark, d).withColumn("pdf", pdf).selectExpr("doc_id", "array_join(word_tokens(text), ' ') AS words", "ascii_lower(text) AS low", "array_join(lex_tokens(text), ' ') AS pieces", "pdf_text(pdf) AS shown", "size(embed(text)) AS dim")


#: Words that a user's file has, one of each nation, and texts of these and of words of the lexicon.
HAN_NUMBER = "translate(CAST({} AS STRING), '0123456789', '零壹贰叁肆伍陆柒捌玖')"
HAN_LINES = "('丙' || " + HAN_NUMBER.format("n_nationkey") + " || '丁' || ' ' || CAST(n_nationkey + 5 AS STRING) || ' nz')"
HAN_PARTS = ("'原告'", "'丙' || " + HAN_NUMBER.format("c_nationkey") + " || '丁'", "'审理'", "'丙' || " + HAN_NUMBER.format("(c_nationkey + 7) % 25") + " || '丁'", "'，'", "'被告'", "'ab9'", "'丙' || " + HAN_NUMBER.format("c_custkey % 25") + " || '丁'")


def user_words_cut(spark, d):
    """Texts without blanks, cut by a lexicon with a user's words."""
    words = with_user_words(lexicon_lines(table(spark, d, "nation").select(F.expr(HAN_LINES).alias("value"))))
    text = F.expr(" || ".join(HAN_PARTS))
    return table(spark, d, "customer").select("c_custkey", F.array_join(segmented(text, words), " ").alias("words"))


def segment_counts(spark, d):
    """How often characters begin, continue, end or are the words of documents."""
    rows = _docs(spark, d)
    return lexicon.position_counts(rows, word_tokens(F.col("text")))


def word_candidates(spark, d):
    """Words of the judgments, found by counts, cohesion and branching alone."""
    found = lexicon.candidates(lexicon.runs(_judgments(spark, d)), longest=4, least=20)
    return found.select("word", "n", _six("cohesion").alias("cohesion"), _six("branching").alias("branching"))


# ---- the engine as a whole

def _engine(spark, docs, **options) -> Engine:
    return Engine(spark, **options).add(docs)


def _named(found):
    return found.select("rank", "doc_id", "chunk_index", "content", *(_six(c).alias(c) for c in ("bm25_score", "vector_score", "final_score")))


def engine_search(spark, d):
    return _named(_engine(spark, _docs(spark, d)).search(QUERY, K))


class Silent:
    """A provider without vectors."""

    ready = True

    def embed(self, texts):
        return []


class Failing(Silent):
    def embed(self, texts):
        raise RuntimeError("no service")


class LateFailing(Silent):
    """Answers for the query, fails for the chunks, in the tasks."""

    def embed(self, texts):
        if texts != [QUERY]:
            raise RuntimeError("service lost")
        return [[1.0, 0.0]]


def engine_batches(spark, d):
    """The same search after the documents came in four batches, half of them with another text first."""
    e, rows = Engine(spark), _docs(spark, d)
    e.add(rows.where("doc_id % 2 = 0").select("doc_id", F.concat("text", F.lit(" "), F.lit(QUERY)).alias("text")))
    for part in range(3):
        e.add(rows.where(f"doc_id % 3 = {part}"))
    return _named(e.search(QUERY, K))


def engine_fallback(spark, d):
    """Whatever is wrong with the provider, words alone."""
    parts, e = [], _engine(spark, _docs(spark, d))
    for provider in (Silent(), Failing(), LateFailing()):
        e.embedding = provider
        found = _named(e.search(QUERY, K))
        parts.append(found.select(F.lit(type(provider).__name__).alias("provider"), "rank", "doc_id", "final_score"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def engine_replaced(spark, d):
    """Chunks after every fifth document came again with another text, and a repeated id with two."""
    again = _docs(spark, d).where("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("replaced "), F.col("doc_id").cast("string")).alias("text"))
    twice = again.unionByName(again.select("doc_id", F.concat("text", F.lit(" and more")).alias("text")))
    return _engine(spark, _docs(spark, d)).add(twice).chunks.select("doc_id", "chunk_index", "content")


def engine_reloaded(spark, d):
    """Chunks that have vectors after the engine was stored and read by one whose provider is gone."""
    path = fresh_path(spark, "engine-saved")
    e = _engine(spark, _docs(spark, d), embedding=vector.HashingProvider())
    e.sync_vectors()
    e.save(path)
    gone = Failing()
    gone.model = vector.model_of(e.embedding)
    return Engine(spark, embedding=gone).load(path).sync_vectors().select("doc_id", "chunk_index", F.size("vec").alias("dim"))


def engine_answer(spark, d):
    """The results that an answer rests on, filtered, and the years to choose from."""
    found = _engine(spark, _judgments(spark, d)).answer("民事判决书 审判员", case_type="民事")
    years = found.years.agg(F.array_join(F.array_sort(F.collect_list("year")), " ").alias("years"))
    return found.results.select("rank", "doc_id", _six("final_score").alias("final_score")).crossJoin(years)


def engine_prompt(spark, d):
    """What a service is asked and answers, and what is said without one."""
    e = _engine(spark, _judgments(spark, d), chat=prompts.EchoProvider())
    asked = e.answer("民事判决书 审判员", case_type="民事")
    e.chat = None
    return spark.createDataFrame([(asked.prompt, asked.text, e.answer("民事判决书 审判员").text)], "prompt string, reply string, without string")


def engine_doc_ids(spark, d):
    """All documents, and whether they have metadata."""
    e = _engine(spark, _judgments(spark, d))
    return e.all_documents().join(e.doc_ids().withColumn("known", F.lit(True)), "doc_id", "left").na.fill({"known": False})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pages_text": pages_text, "import_tally": import_tally, "chunks": chunk_table, "chunk_offsets": chunk_offsets, "tokens_filtered": tokens_filtered, "term_freq": term_freq,
    "doc_freq": doc_frequency, "chunk_stats": chunk_stats, "corpus_stats": corpus_statistics, "postings_lookup": postings_lookup, "bm25_topk": bm25_topk, "bm25_multi_query": bm25_multi_query,
    "bm25_score_single": bm25_score_single, "bm25_chunks": bm25_chunks, "cosine_pairs": cosine_pairs, "vector_topk": vector_topk, "vector_multi_query": vector_multi_query,
    "vectors_missing": vectors_missing, "hybrid_topk": hybrid_topk, "hybrid_fallback": hybrid_fallback, "expand_terms": expand_terms, "intents": intents, "case_number": case_number,
    "court": court, "judgment_date": judgment_date, "case_type": case_type, "litigants": litigants, "doc_metadata": doc_metadata, "filter_conj": filter_conj, "year_facet": year_facet,
    "per_doc_cap": per_doc_cap, "metadata_rollup": metadata_rollup, "metadata_summary": metadata_summary, "result_lines": result_lines, "build_context": build_context,
    "legal_route": legal_route, "prompt": prompt, "request_body": request_body, "sse_concat": sse_concat, "parse_delta": parse_delta, "api_keys": api_keys,
    "stop_word_share": stop_word_share, "marked_documents": marked_documents, "rollup_lines": rollup_lines, "file_texts": file_texts, "file_chunks": file_chunks, "pdf_texts": pdf_texts,
    "more_stop_words": more_stop_words, "user_words": user_words, "index_cleared": index_cleared, "vectors_added": vectors_added, "vectors_current": vectors_current, "engine_search": engine_search,
    "engine_fallback": engine_fallback, "engine_replaced": engine_replaced, "engine_reloaded": engine_reloaded, "engine_answer": engine_answer, "sql_functions": sql_functions, "engine_batches": engine_batches, "bm25_pruned": bm25_pruned, "stored_doc_freq": stored_doc_freq, "stored_stats": stored_stats,
    "stored_lookup": stored_lookup, "user_words_cut": user_words_cut, "segment_counts": segment_counts, "word_candidates": word_candidates,
    "vector_misses": vector_misses, "stream_texts": stream_texts, "engine_prompt": engine_prompt, "engine_doc_ids": engine_doc_ids,
}
