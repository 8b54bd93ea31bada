"""The same queries in DuckDB's SQL, written apart from the Spark code."""

from __future__ import annotations

from corvane.functions.text import LOWER, STOP_WORDS, UPPER
from corvane.operators import prompts
from corvane.operators.hybrid import LOCATION_TERMS, LOCATION_WORDS
from corvane.operators.results import AGGREGATE_WORDS, HEADER
from corvane.plans.queries import HAN_PARTS, JUDGMENT, KEYS, MORE_STOP_WORDS, NAMED, QUERY, QUESTION, SSE, WORD_LINES


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


WORDS = r"regexp_extract_all({}, '[A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+')"
INDEXED = (
    "list_filter(list_transform({}, lambda t: translate(t, '" + UPPER + "', '" + LOWER + "')), lambda t: NOT list_contains(" + _list(STOP_WORDS) + ", t) "
    "AND NOT regexp_full_match(t, '[0-9.]+') AND strlen(t) >= CASE WHEN strlen(t) = length(t) THEN 2 ELSE 3 END)"
)


def tokens(text: str) -> str:
    return INDEXED.format(WORDS.format(text))


TOK = f"tok AS (SELECT doc_id, {tokens('text')} AS t FROM documents)"
POST = TOK + ", post AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY term, doc_id)"
STATS = POST + ", st AS (SELECT doc_id, CAST(len(t) AS INTEGER) AS dl FROM tok), cs AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM st), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
ONE = f"q AS (SELECT CAST(0 AS BIGINT) AS query_id, unnest({tokens(chr(39) + QUERY + chr(39))}) AS term)"
MANY = f"q AS (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark)"
SCORED = (
    "sc AS (SELECT query_id, post.doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) AS s "
    "FROM (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY query_id, term) x JOIN post USING (term) JOIN dfs USING (term) JOIN st ON st.doc_id = post.doc_id, cs GROUP BY query_id, post.doc_id)"
)
RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS r FROM sc)"

CHUNKS = r"""WITH RECURSIVE d AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
r AS (
  SELECT doc_id, -1 AS k, 0 AS s, 0 AS e, 0 AS nx FROM d
  UNION ALL
  SELECT doc_id, k + 1, pos, e, CASE WHEN pos + e < n AND e > 50 AND back > 0 THEN pos + back ELSE pos + e END FROM (
    SELECT *, CAST(length(regexp_replace(substr(hx, 2 * pos + 1, 2 * (e - 49)), '([89AB][0-9A-F])+$', '')) // 2 - 1 AS INTEGER) AS back FROM (
      SELECT *, CASE WHEN pos + safe < n AND stop > 256 THEN stop ELSE safe END AS e FROM (
        SELECT *, CAST(length(regexp_extract(substr(hx, 2 * pos + 1, 2 * safe), '^(?:[0-9A-F]{2})*(?:0A|0D|2E|21|3F)')) // 2 AS INTEGER) AS stop FROM (
          SELECT r.doc_id, k, nx AS pos, hx, n,
                 CAST(CASE WHEN nx + 512 >= n THEN n - nx ELSE length(regexp_replace(substr(hx, 2 * nx + 1, 1026), '([89AB][0-9A-F])+$', '')) // 2 - 1 END AS INTEGER) AS safe
          FROM r JOIN d ON r.doc_id = d.doc_id WHERE nx < n))))),
c AS (SELECT r.doc_id, CAST(k AS INTEGER) AS chunk_index, decode(unhex(substr(hx, 2 * s + 1, 2 * e))) AS content, CAST(s AS INTEGER) AS byte_offset, e FROM r JOIN d ON r.doc_id = d.doc_id WHERE k >= 0)
"""

NEAR = (
    "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), "
    "near AS (SELECT b.vec_id AS doc_id, list_cosine_similarity(a.e, b.e) AS vs FROM v a, v b WHERE a.vec_id = 0 ORDER BY vs DESC, doc_id LIMIT {})"
)

#: The fields of a judgment by plain patterns; each text has one of each at most.
JUDGED = f"""j AS (SELECT o_orderkey AS doc_id, {JUDGMENT} AS t FROM orders),
f AS (SELECT doc_id, t,
  regexp_extract(t, '（\\d{{4}}）[^号]*号') AS case_number,
  regexp_extract(t, '([^\\x00-\\x7F。，、：]{{2,10}}人民法院)', 1) AS court,
  regexp_extract(t, '(\\d{{4}})[年-](\\d{{1,2}})[月-](\\d{{1,2}})', ['y', 'm', 'd']) AS a,
  regexp_extract(t, '([〇一二三四五六七八九]{{4}})年([一二三四五六七八九十]+)月([一二三四五六七八九十]+)日', ['y', 'm', 'd']) AS z FROM j),
num AS (SELECT CAST(n AS VARCHAR) AS n, CASE WHEN n < 10 THEN digit[n] WHEN n = 10 THEN '十' WHEN n < 20 THEN '十' || digit[n - 10] WHEN n % 10 = 0 THEN digit[n // 10] || '十' ELSE digit[n // 10] || '十' || digit[n % 10] END AS w
  FROM (SELECT unnest(range(1, 32)) AS n, ['一','二','三','四','五','六','七','八','九'] AS digit)),
g AS (SELECT f.doc_id, t, case_number, court,
  CASE WHEN a.y <> '' THEN a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0')
       WHEN z.y <> '' THEN translate(z.y, '〇一二三四五六七八九', '0123456789') || '-' || lpad(nm.n, 2, '0') || '-' || lpad(nd.n, 2, '0') ELSE '' END AS date,
  regexp_extract(case_number, '）[^民刑行知商国破法执]*([民刑行知商国破法执])', 1) AS ct, regexp_extract(case_number, '[初终再申复监赔特破]') AS pc
  FROM f LEFT JOIN num nm ON nm.w = z.m LEFT JOIN num nd ON nd.w = z.d),
m AS (SELECT doc_id, case_number, court, date,
  CASE ct WHEN '民' THEN '民事' WHEN '刑' THEN '刑事' WHEN '行' THEN '行政' WHEN '知' THEN '知识产权' WHEN '国' THEN '国家赔偿' WHEN '破' THEN '破产' WHEN '执' THEN '执行' ELSE '' END AS case_type,
  CASE doc_id % 4 WHEN 0 THEN '原告：张某某 诉 被告：李某，' WHEN 1 THEN '公诉机关' ELSE '' END AS litigants,
  CASE WHEN pc <> '' THEN CASE pc WHEN '初' THEN '一审' WHEN '终' THEN '二审（终审）' WHEN '再' THEN '再审' WHEN '申' THEN '申请再审' WHEN '监' THEN '检察监督' WHEN '复' THEN '复议' WHEN '赔' THEN '赔偿' WHEN '破' THEN '破产程序' END
       WHEN contains(t, '上诉') THEN '二审' WHEN contains(court, '最高') THEN '二审/再审' ELSE '' END AS procedure FROM g),
kept AS (SELECT * FROM m WHERE case_number <> '' OR court <> '' OR date <> '')"""
LINE = (
    "'- ' || CAST(doc_id AS VARCHAR) || CASE WHEN case_number <> '' THEN ' | 案号: ' || case_number ELSE '' END || CASE WHEN court <> '' THEN ' | 法院: ' || court ELSE '' END "
    "|| CASE WHEN case_type <> '' THEN ' | 类型: ' || case_type ELSE '' END || CASE WHEN date <> '' THEN ' | 日期: ' || date ELSE '' END "
    "|| CASE WHEN procedure <> '' THEN ' | 程序: ' || procedure ELSE '' END || CASE WHEN litigants <> '' THEN ' | 当事人: ' || litigants ELSE '' END || chr(10)"
)


def dear(k: int) -> str:
    return f"top AS (SELECT o_orderkey AS doc_id, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= {k})"


HITS = "h AS (SELECT CAST(doc_id + 1 AS INTEGER) AS rank, doc_id, text AS content, doc_id / 8 + 1 AS final_score FROM documents{})"


def has(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Documents of which a fifth has been replaced.
GROWN = STATS.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'replaced ' || CAST(doc_id AS VARCHAR) || 'x again' ELSE text END AS text FROM documents)", 1)
BLANK = r"regexp_full_match(coalesce(text, ''), '[ \t\n\r\f\v]*')"
#: The best chunks by words alone.
FOUND = CHUNKS + f", tok AS (SELECT (doc_id, chunk_index) AS doc_id, {tokens('content')} AS t FROM c)" + STATS[len(TOK) :] + f", {ONE}, {SCORED}, {RANKED} "
TURN = "CASE WHEN turn % 2 = 0 THEN text || ' 判决' ELSE text END"
LEGAL_TAIL = "请依次写出以下各节：\n## 一、案件概述\n## 二、法律分析\n## 三、结论\n## 四、参考来源"
GENERAL_TAIL = "请依据以上内容回答：\n1. 简明准确，分点作答\n2. 写明依据的来源编号\n3. 材料中没有的内容请直说"

ORACLE = {
    "pages_text": r"SELECT page_id, CASE WHEN regexp_full_match(coalesce(html, ''), '[ \t\n\r\f\v]*') THEN 'NoTextExtracted' ELSE 'Success' END AS status, "
    r"CASE WHEN regexp_full_match(coalesce(html, ''), '[ \t\n\r\f\v]*') THEN 'None' ELSE 'TextFile' END AS source, CAST(coalesce(strlen(html), 0) AS BIGINT) AS n_bytes FROM pages",
    "import_tally": CHUNKS + "SELECT count(DISTINCT doc_id) AS imported, count(*) AS chunks_added, CAST(0 AS BIGINT) AS ocr_imported, (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS errors FROM c",
    "chunks": CHUNKS + "SELECT doc_id, chunk_index, content, byte_offset FROM c",
    "chunk_offsets": CHUNKS + "SELECT doc_id, chunk_index, CAST(coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_pos, byte_offset FROM c",
    "tokens_filtered": f"WITH {TOK} SELECT doc_id, array_to_string(t, ' ') AS tokens FROM tok",
    "term_freq": f"WITH {POST} SELECT term, doc_id, tf FROM post",
    "doc_freq": f"WITH {POST} SELECT term, count(*) AS df FROM post GROUP BY term",
    "chunk_stats": f"WITH {TOK} SELECT doc_id, CAST(len(t) AS INTEGER) AS dl FROM tok",
    "corpus_stats": f"WITH {STATS} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM dfs) AS terms FROM cs",
    "postings_lookup": f"WITH {STATS} SELECT term, doc_id, tf, dl FROM post JOIN st USING (doc_id) WHERE term IN ('ononble', 'thanedble')",
    "bm25_topk": f"WITH {STATS}, {ONE}, {SCORED}, {RANKED} SELECT doc_id, CAST(r AS INTEGER) AS rank, round(s, 6) AS bm25_score FROM rk WHERE r <= 10",
    "bm25_multi_query": f"WITH {STATS}, {MANY}, {SCORED}, {RANKED} SELECT query_id, doc_id, round(s, 6) AS bm25_score FROM rk WHERE r <= 5",
    "bm25_score_single": f"WITH {STATS}, {ONE}, {SCORED} SELECT doc_id, round(s, 6) AS bm25_score FROM sc WHERE doc_id = (SELECT min(doc_id) FROM post WHERE term = 'ononble')",
    "bm25_chunks": CHUNKS
    + f", tok AS (SELECT (doc_id, chunk_index) AS doc_id, {tokens('content')} AS t FROM c)"
    + STATS[len(TOK) :]
    + f", {ONE}, {SCORED}, {RANKED} SELECT doc_id[1] AS doc_id, doc_id[2] AS chunk_index, round(s, 6) AS bm25_score FROM rk WHERE r <= 10",
    "cosine_pairs": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "vector_topk": f"WITH {NEAR.format(10)} SELECT doc_id AS vec_id, round(vs, 6) AS similarity FROM near",
    "vector_multi_query": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS x FROM v a, v b WHERE a.vec_id % 20 = 0) "
    "SELECT query_id, vec_id, round(x, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, vec_id) <= 5",
    "vectors_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "hybrid_topk": f"WITH {STATS}, {ONE}, {SCORED}, {RANKED}, {NEAR.format(20)}, w AS (SELECT doc_id, s FROM rk WHERE r <= 20), u AS (SELECT coalesce(w.doc_id, near.doc_id) AS doc_id, coalesce(s, 0) AS s, coalesce(vs, 0) AS vs FROM w FULL JOIN near ON w.doc_id = near.doc_id), "
    "mx AS (SELECT greatest(max(s), 0) AS ms, greatest(max(vs), 0) AS mv FROM u), z AS (SELECT doc_id, s, vs, 0.4 * CASE WHEN ms > 0 THEN s / ms ELSE 0 END + 0.6 * CASE WHEN mv > 0 THEN vs / mv ELSE 0 END AS fs FROM u, mx) "
    "SELECT doc_id, CAST(row_number() OVER (ORDER BY round(fs, 9) DESC, doc_id) AS INTEGER) AS rank, round(s, 6) AS bm25_score, round(vs, 6) AS vector_score, round(fs, 6) AS final_score FROM z QUALIFY rank <= 10",
    "hybrid_fallback": f"WITH {STATS}, {ONE}, {SCORED}, {RANKED} SELECT doc_id, CAST(r AS INTEGER) AS rank, round(s, 6) AS bm25_score, CAST(0 AS DOUBLE) AS vector_score, round(s, 6) AS final_score FROM rk WHERE r <= 10",
    "expand_terms": f"WITH q AS (SELECT c_custkey AS query_id, {QUESTION} AS q FROM customer) SELECT query_id, q || CASE WHEN {has('q', LOCATION_WORDS)} THEN "
    + " || ".join(f"CASE WHEN list_contains(string_split(q, ' '), '{t}') THEN '' ELSE ' {t}' END" for t in LOCATION_TERMS)
    + " ELSE '' END AS terms FROM q",
    "intents": f"WITH q AS (SELECT c_custkey AS query_id, {QUESTION} AS q FROM customer) SELECT query_id, {has('q', LOCATION_WORDS)} AS asks_place, {has('q', AGGREGATE_WORDS)} AS asks_aggregate, {has('q', prompts.LEGAL_WORDS)} AS is_legal FROM q",
    "case_number": f"WITH {JUDGED} SELECT doc_id, case_number FROM m",
    "court": f"WITH {JUDGED} SELECT doc_id, court, CASE WHEN court = '' THEN '' WHEN contains(court, '最高') THEN '最高' WHEN contains(court, '高级') THEN '高级' WHEN contains(court, '中级') THEN '中级' ELSE '基层' END AS court_level FROM m",
    "judgment_date": f"WITH {JUDGED} SELECT doc_id, date FROM m",
    "case_type": f"WITH {JUDGED} SELECT doc_id, case_type, procedure FROM m",
    "litigants": f"WITH {JUDGED} SELECT doc_id, litigants FROM m",
    "doc_metadata": f"WITH {JUDGED} SELECT doc_id, case_number, court, date, case_type, litigants, procedure FROM kept",
    "filter_conj": f"WITH {JUDGED} SELECT doc_id, CAST(doc_id AS INTEGER) AS rank FROM kept WHERE case_type = '民事' AND contains(court, '高级') AND date LIKE '1995%'",
    "year_facet": f"WITH {JUDGED} SELECT DISTINCT substr(date, 1, 4) AS year FROM kept WHERE length(date) >= 4",
    "per_doc_cap": "SELECT l_orderkey AS doc_id, l_linenumber AS rank FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 2",
    "metadata_rollup": f"WITH {JUDGED}, l AS (SELECT doc_id, {LINE} AS line FROM kept), u AS (SELECT *, sum(strlen(line)) OVER (ORDER BY doc_id) AS upto FROM l) "
    "SELECT (SELECT coalesce(string_agg(line, '' ORDER BY doc_id), '') FROM u WHERE upto <= 1048576) || chr(10) || '（以上为全部 ' || CAST(count(*) AS VARCHAR) || ' 个已导入文档的元数据汇总）' || chr(10) AS summary, count(*) AS n_docs FROM l",
    "rollup_lines": f"WITH {JUDGED} SELECT doc_id, rtrim({LINE}, chr(10)) AS line FROM kept",
    "metadata_summary": f"WITH {JUDGED}, {dear(20)} SELECT string_agg({LINE}, '' ORDER BY rank) AS summary FROM top JOIN kept USING (doc_id)",
    "result_lines": f"WITH {HITS.format('')} SELECT rank, '【' || CAST(rank AS VARCHAR) || '】' || CAST(doc_id AS VARCHAR) || '  相关度: ' || printf('%.2f', final_score) || '  (BM25: 0.25 | 向量: 0.75)' AS line, "
    "left(content, 200) || CASE WHEN strlen(content) > 200 THEN '...' ELSE '' END AS preview FROM h",
    "build_context": f"WITH {HITS.format(' ORDER BY doc_id LIMIT 20')}, p AS (SELECT *, hex(encode(content)) AS hx, strlen(content) AS n, coalesce(sum(strlen(content)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h), "
    "k AS (SELECT *, CAST(8000 - before AS BIGINT) AS room FROM p WHERE before < 8000), "
    "e AS (SELECT rank, '【来源 ' || CAST(rank AS VARCHAR) || '】' || CAST(doc_id AS VARCHAR) || ' (相关度: ' || printf('%.2f', final_score) || ')' || chr(10) || CASE WHEN n <= room THEN content ELSE decode(unhex("
    "CASE WHEN regexp_matches(substr(hx, 2 * room + 1, 1), '[89AB]') THEN regexp_replace(substr(hx, 1, 2 * room), '[C-F][0-9A-F]([89AB][0-9A-F])*$', '') ELSE substr(hx, 1, 2 * room) END)) || '...' END || chr(10) || chr(10) AS entry FROM k) "
    f"SELECT {quoted(HEADER)} || string_agg(entry, '' ORDER BY rank) AS context FROM e",
    "legal_route": f"WITH c AS (SELECT conv_id, turn, {TURN} AS t FROM conversations) SELECT conv_id, turn, {has('t', prompts.LEGAL_WORDS)} AS is_legal, CASE WHEN {has('t', prompts.LEGAL_WORDS)} THEN {quoted(prompts.LEGAL_SYSTEM)} ELSE {quoted(prompts.GENERAL_SYSTEM)} END AS system FROM c",
    "prompt": f"WITH c AS (SELECT conv_id, turn, role, {TURN} AS t, CASE WHEN conv_id % 2 = 0 THEN '【文档元数据】' || chr(10) || '元数据' || chr(10) || chr(10) ELSE '' END AS m FROM conversations) SELECT conv_id, turn, CASE WHEN {has('t', prompts.LEGAL_WORDS)} "
    f"THEN m || '【法律文档内容】' || chr(10) || t || {quoted(chr(10) * 2 + '【用户问题】' + chr(10))} || role || {quoted(chr(10) * 2 + LEGAL_TAIL)} ELSE t || {quoted(chr(10) * 2 + '用户问题：')} || role || {quoted(chr(10) * 2 + GENERAL_TAIL)} END AS prompt FROM c",
    "request_body": "SELECT r_regionkey, r_name AS user, 'true' AS stream, '2048' AS max_tokens FROM region",
    "sse_concat": f"WITH l AS (SELECT user_id, event_id, {SSE} AS line FROM events) SELECT user_id, string_agg(CASE WHEN line LIKE 'data: {{\"%' THEN json_extract_string(substr(line, 7), '$.choices[0].delta.content') ELSE '' END, '' ORDER BY event_id) AS text "
    "FROM l WHERE line LIKE 'data: {\"%' GROUP BY user_id",
    "stream_texts": f"WITH l AS (SELECT user_id, event_id, {SSE} AS line FROM events) SELECT user_id, string_agg(CASE WHEN line LIKE 'data: {{\"%' THEN json_extract_string(substr(line, 7), '$.choices[0].delta.content') ELSE '' END, '' ORDER BY event_id) AS text, "
    "'marker' AS ended FROM l WHERE line <> 'data: [DONE]' GROUP BY user_id",
    "parse_delta": f"WITH l AS (SELECT event_id, {SSE} AS line FROM events) SELECT event_id, CASE WHEN line LIKE 'data: {{\"%' THEN json_extract_string(substr(line, 7), '$.choices[0].delta.content') ELSE '' END AS text FROM l",
    "api_keys": f"SELECT c_custkey, regexp_full_match({KEYS}, 'sk-[a-zA-Z0-9-]*') AND strlen({KEYS}) >= 20 AS valid FROM customer",
    "stop_word_share": f"SELECT lang, CAST(sum(len({WORDS.format('text')})) AS BIGINT) AS n_tokens, CAST(sum(len({tokens('text')})) AS BIGINT) AS n_indexed FROM documents GROUP BY lang",
    "marked_documents": "SELECT doc_id FROM documents WHERE contains(text, 'password') OR contains(text, 'license') OR contains(text, 'Copyright')",
    "file_texts": f"SELECT substr({NAMED.replace('STRING', 'VARCHAR')}, 5) AS doc_id, CASE WHEN {BLANK} THEN 'NoTextExtracted' ELSE 'Success' END AS status, CASE WHEN {BLANK} THEN 'None' ELSE 'TextFile' END AS source, coalesce(text, '') AS text FROM documents",
    "file_chunks": CHUNKS + f"SELECT substr({NAMED.replace('STRING', 'VARCHAR')}, 5) AS doc_id, chunk_index, content, byte_offset FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE {BLANK})",
    "pdf_texts": "SELECT CAST(p_partkey AS VARCHAR) || '.pdf' AS doc_id, 'Success' AS status, 'NativePdf' AS source, concat_ws(chr(10), p_name, p_brand || ' ' || p_type, p_brand, 'A()', '中文😀', 'packed') AS text FROM part",
    "more_stop_words": f"SELECT doc_id, array_to_string(list_filter({tokens('text')}, lambda t: NOT list_contains({_list(MORE_STOP_WORDS)}, t)), ' ') AS tokens FROM documents",
    "user_words": f"WITH l AS (SELECT trim({WORD_LINES.replace('STRING', 'VARCHAR')}, ' ' || chr(9)) AS l FROM nation), p AS (SELECT regexp_split_to_array(l, '[ \\t]+') AS p FROM l WHERE l <> '' AND NOT starts_with(l, '#')) "
    "SELECT p[1] AS word, coalesce(TRY_CAST(p[2] AS INTEGER), 10) AS freq, coalesce(p[3], 'l') AS tag FROM p",
    "index_cleared": "SELECT CAST(0 AS BIGINT) AS terms, CAST(0 AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS docs",
    "vectors_added": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: -x) AS e FROM v), "
    "w AS (SELECT * FROM v UNION ALL SELECT vec_id + 1000000000, e FROM n WHERE vec_id % 10 = 0) SELECT w.vec_id, round(list_cosine_similarity(q.e, w.e), 6) AS similarity FROM n q, w WHERE q.vec_id = 0 ORDER BY list_cosine_similarity(q.e, w.e) DESC, w.vec_id LIMIT 10",
    "vectors_current": "SELECT vec_id AS doc_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0)",
    "engine_search": FOUND + "SELECT CAST(r AS INTEGER) AS rank, rk.doc_id[1] AS doc_id, rk.doc_id[2] AS chunk_index, content, round(s, 6) AS bm25_score, CAST(0 AS DOUBLE) AS vector_score, round(s, 6) AS final_score "
    "FROM rk JOIN c ON c.doc_id = rk.doc_id[1] AND c.chunk_index = rk.doc_id[2] WHERE r <= 10",
    "bm25_pruned": f"WITH {STATS}, {MANY}, {SCORED}, {RANKED} SELECT query_id, doc_id, round(s, 6) AS bm25_score FROM rk WHERE r <= 5",
    "stored_doc_freq": f"WITH {GROWN} SELECT term, CAST(df AS BIGINT) AS df FROM dfs",
    "stored_stats": f"WITH {GROWN} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM dfs) AS terms, (SELECT count(*) FROM documents) AS docs FROM cs",
    "stored_lookup": f"WITH {GROWN} SELECT term, doc_id, tf, dl FROM post JOIN st USING (doc_id) WHERE term IN ('ononble', 'replaced')",
    "engine_batches": FOUND + "SELECT CAST(r AS INTEGER) AS rank, rk.doc_id[1] AS doc_id, rk.doc_id[2] AS chunk_index, content, round(s, 6) AS bm25_score, CAST(0 AS DOUBLE) AS vector_score, round(s, 6) AS final_score "
    "FROM rk JOIN c ON c.doc_id = rk.doc_id[1] AND c.chunk_index = rk.doc_id[2] WHERE r <= 10",
    "engine_fallback": FOUND + "SELECT provider, CAST(r AS INTEGER) AS rank, rk.doc_id[1] AS doc_id, round(s, 6) AS final_score FROM rk, (SELECT unnest(['Silent', 'Failing', 'LateFailing']) AS provider) WHERE r <= 10",
    "engine_replaced": CHUNKS + "SELECT doc_id, chunk_index, content FROM c WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 0, 'replaced ' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 5 = 0",
    "engine_reloaded": CHUNKS + "SELECT doc_id, chunk_index, 64 AS dim FROM c",
    "engine_doc_ids": f"WITH {JUDGED} SELECT doc_id, doc_id IN (SELECT doc_id FROM kept) AS known FROM j",
    "engine_prompt": f"WITH {JUDGED}, tok AS (SELECT doc_id, {tokens('t')} AS t FROM j)" + STATS[len(TOK) :] + f", q AS (SELECT CAST(0 AS BIGINT) AS query_id, unnest({tokens(quoted('民事判决书 审判员'))}) AS term), {SCORED}, {RANKED}, "
    "hit AS (SELECT row_number() OVER (ORDER BY r) AS i, rk.doc_id, s, t AS content FROM rk JOIN kept USING (doc_id) JOIN j USING (doc_id) WHERE r <= 20 AND case_type = '民事'), "
    f"ctx AS (SELECT {quoted(HEADER)} || string_agg('【来源 ' || CAST(i AS VARCHAR) || '】' || CAST(doc_id AS VARCHAR) || ' (相关度: ' || printf('%.2f', s) || ')' || chr(10) || content || chr(10) || chr(10), '' ORDER BY i) AS c FROM hit), "
    f"sm AS (SELECT string_agg({LINE}, '' ORDER BY i) AS m FROM hit JOIN kept USING (doc_id)) "
    f"SELECT '【文档元数据】' || chr(10) || m || chr(10) || chr(10) || '【法律文档内容】' || chr(10) || c || {quoted(chr(10) * 2 + '【用户问题】' + chr(10))} || '民事判决书 审判员' || {quoted(chr(10) * 2 + LEGAL_TAIL)} AS prompt, "
    f"'## 四、参考来源' AS reply, {quoted(prompts.NOT_READY)} AS without FROM ctx, sm",
    "engine_answer": f"WITH {JUDGED}, tok AS (SELECT doc_id, {tokens('t')} AS t FROM j)" + STATS[len(TOK) :] + f", q AS (SELECT CAST(0 AS BIGINT) AS query_id, unnest({tokens(quoted('民事判决书 审判员'))}) AS term), {SCORED}, {RANKED}, best AS (SELECT * FROM rk WHERE r <= 20) "
    "SELECT CAST(r AS INTEGER) AS rank, doc_id, round(s, 6) AS final_score, (SELECT string_agg(DISTINCT substr(date, 1, 4), ' ' ORDER BY substr(date, 1, 4)) FROM best JOIN kept USING (doc_id)) AS years FROM best JOIN kept USING (doc_id) WHERE case_type = '民事'",
    "sql_functions": f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS words, translate(text, '{UPPER}', '{LOWER}') AS low, array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+(?:\\.[0-9]+)*|[^\\s]'), ' ') AS pieces, "
    "trim(regexp_replace(split_part(text, '.', 1), '[^A-Za-z ]', '', 'g')) AS shown, CAST(64 AS INTEGER) AS dim FROM documents",
    "vector_misses": "SELECT DISTINCT sha256(coalesce(text, '')) AS digest, text AS content FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 3 = 0)",
    "user_words_cut": f"SELECT c_custkey, {" || ' ' || ".join(HAN_PARTS).replace('STRING', 'VARCHAR')} AS words FROM customer",
    "segment_counts": f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), "
    "i AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM w), "
    "c AS (SELECT doc_id, p, k, substr(x, k, 1) AS c, CASE WHEN length(x) = 1 THEN 'S' WHEN k = 1 THEN 'B' WHEN k = length(x) THEN 'E' ELSE 'M' END AS s FROM (SELECT doc_id, p, x, unnest(range(1, length(x) + 1)) AS k FROM i)), "
    "f AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY p, k) AS nx, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS seq FROM c) "
    "SELECT 'emit' AS kind, s AS state, c AS symbol, count(*) AS n FROM f GROUP BY s, c UNION ALL SELECT 'step', s, nx, count(*) FROM f WHERE nx IS NOT NULL GROUP BY s, nx UNION ALL SELECT 'start', s, '', count(*) FROM f WHERE seq = 1 GROUP BY s",
    "word_candidates": f"WITH j AS (SELECT {JUDGMENT} AS t FROM orders), r AS (SELECT unnest(regexp_extract_all(t, '[\u3400-\u4dbf\u4e00-\u9fff\u3007\uf900-\ufaff]+')) AS run FROM j), "
    "s AS (SELECT substr(run, a, z) AS word, CASE WHEN a > 1 THEN substr(run, a - 1, 1) ELSE '' END AS l, substr(run, a + z, 1) AS r FROM (SELECT run, a, unnest(range(1, least(4, length(run) - a + 1) + 1)) AS z FROM (SELECT run, unnest(range(1, length(run) + 1)) AS a FROM r))), "
    "e AS (SELECT word, count(*) AS n FROM s GROUP BY word), u AS (SELECT sum(n) AS total FROM e WHERE length(word) = 1), "
    "m AS (SELECT word, min(ln(n * total / (na * nb))) AS cohesion FROM (SELECT x.word, CAST(x.n AS DOUBLE) AS n, CAST(a.n AS DOUBLE) AS na, CAST(b.n AS DOUBLE) AS nb, CAST(total AS DOUBLE) AS total FROM (SELECT word, n, unnest(range(1, length(word))) AS c FROM e WHERE n >= 20 AND length(word) > 1) x "
    "JOIN e a ON a.word = substr(x.word, 1, c) JOIN e b ON b.word = substr(x.word, c + 1), u) GROUP BY word), "
    "hl AS (SELECT word, ln(sum(k)) - sum(CASE WHEN l = '' THEN 0 ELSE k * ln(k) END) / sum(k) AS h FROM (SELECT word, l, CAST(count(*) AS DOUBLE) AS k FROM s GROUP BY word, l) GROUP BY word), "
    "hr AS (SELECT word, ln(sum(k)) - sum(CASE WHEN r = '' THEN 0 ELSE k * ln(k) END) / sum(k) AS h FROM (SELECT word, r, CAST(count(*) AS DOUBLE) AS k FROM s GROUP BY word, r) GROUP BY word) "
    "SELECT word, n, round(cohesion, 6) AS cohesion, round(least(hl.h, hr.h), 6) AS branching FROM e JOIN m USING (word) JOIN hl USING (word) JOIN hr USING (word) WHERE cohesion >= 2 AND least(hl.h, hr.h) >= 0.7 "
    "UNION ALL SELECT word, n, NULL, NULL FROM e WHERE length(word) = 1",
}
