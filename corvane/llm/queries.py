"""One query per training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, gif, html, langid, runs, secrets, sharding, simhash, superkmers, token_counts, warc
from corvane.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own that is empty at first, so that it shows the full cost."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), RANKS, arrays=False)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, langid.may_learn())
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(langid.remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.stored_features(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op11_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.scan(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.runs(table(spark, sf_dir, "documents"), plant=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html, op2_secrets, op3_decontaminate, op4_token_counts, op5_warc, op6_bpe, op7_langid, op8_simhash, op9_gif, op10_sharding, op11_superkmers, op12_runs)
    return {f.__name__: f for f in own}


#: Items' windows joined to documents' windows of the same length.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT rid, dw.n, p, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT rid, n, p FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""


#: Base32 of the SHA-1: each 5 hex digits are 4 symbols.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""


def _bpe_sql(ranks: str, special: str | None = None) -> str:
    """d (a row per document), r (its text, or what lies between special strings), pieces by the pattern, merges of each
    different piece by rank, and tokens (the ids of each r). The pattern's look-ahead is a mark before the last blank of
    a run that something follows."""
    blank = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    pattern = rf"[{blank}]+\x{{10FFFE}}|''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{blank}\p{{L}}\p{{N}}]+|[{blank}]+"
    parts = f"unnest(string_split(t, '{special}'))" if special else "t"
    return rf"""
WITH RECURSIVE ranks AS (SELECT hex(from_base64(b)) AS hx, id FROM read_csv('{ranks}', delim = ' ', header = false, quote = '', escape = '', columns = {{'b': 'VARCHAR', 'id': 'INTEGER'}})),
d AS (SELECT row_number() OVER () AS did, doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT row_number() OVER () AS rid, did, t FROM (SELECT did, {parts} AS t FROM d)),
pieces AS (
  SELECT rid, p, hex(encode(replace(x[p], chr(1114110), ''))) AS hx
  FROM (SELECT rid, x, unnest(range(1, len(x) + 1)) AS p FROM (SELECT rid, regexp_extract_all(regexp_replace(t, '([{blank}])([{blank}][^{blank}])', '\1' || chr(1114110) || '\2', 'g'), '{pattern}') AS x FROM r))),
m AS (
  SELECT hx, CASE WHEN hx IN (SELECT hx FROM ranks) THEN [hx] ELSE regexp_extract_all(hx, '..') END AS parts FROM (SELECT DISTINCT hx FROM pieces)
  UNION ALL
  SELECT hx, list_concat(list_append(parts[: k - 1], parts[k] || parts[k + 1]), parts[k + 2 :])
  FROM (SELECT m.hx, parts, min(CAST(id AS BIGINT) * 16777216 + i) % 16777216 AS k FROM (SELECT hx, parts, unnest(range(1, len(parts))) AS i FROM m) m JOIN ranks ON ranks.hx = parts[i] || parts[i + 1] GROUP BY m.hx, parts)),
merged AS (SELECT hx, arg_min(parts, len(parts)) AS parts FROM m GROUP BY hx),
coded AS (SELECT merged.hx, list(id ORDER BY i) AS ids FROM (SELECT hx, parts, unnest(range(1, len(parts) + 1)) AS i FROM merged) merged JOIN ranks ON ranks.hx = parts[i] GROUP BY merged.hx),
found AS (SELECT rid, flatten(list(ids ORDER BY p)) AS ids FROM pieces JOIN coded USING (hx) GROUP BY rid),
tokens AS (SELECT r.*, coalesce(ids, []) AS ids FROM r LEFT JOIN found USING (rid))
"""


OP4_SQL = _bpe_sql(RANKS, "<|endoftext|>") + """
SELECT doc_id, CAST(strlen(t) AS BIGINT) AS n_bytes, n_tokens, n_tokens > 1024 AS over_limit
FROM d JOIN (SELECT did, CAST(sum(len(ids)) + count(*) - 1 AS BIGINT) AS n_tokens FROM tokens GROUP BY did) USING (did)
"""
OP6_SQL = _bpe_sql(RANKS) + """
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, sha256(array_to_string(ids, ' ')) AS ids_sha256, sha256(d.t) AS decoded_sha256 FROM d JOIN tokens USING (did)
"""


# The primes of XXH64.
XXH_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _op8_sql() -> str:
    """XXH64 of each shingle by its definition, modulo 2^64 in 128 bits; majority bits, pairs of different
    fingerprints, and who reaches whom."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in XXH_PRIMES)
    low = lambda x: f"(({x}) & 18446744073709551615::UHUGEINT)"
    let = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    turn = lambda x, r: f"({low(f'{x} * {1 << r}::UHUGEINT')} + ({x} >> {64 - r}::UHUGEINT))"
    mixed = lambda acc, k: let("q", low(f"{acc} + {low(f'{k} * {p2}')}"), low(f"{turn('q', 31)} * {p1}"))
    merged = lambda h, k: let("r", f"xor({h}, {k})", low(f"{turn('r', 27)} * {p1} + {p4}"))
    zero, seed = "0::UHUGEINT", 42
    starts = [(seed + XXH_PRIMES[0] + XXH_PRIMES[1]) % 2**64, (seed + XXH_PRIMES[1]) % 2**64, seed, (seed - XXH_PRIMES[0]) % 2**64]
    # stripes of 32 bytes: four sums, each of every fourth lane
    sums = ", ".join(f"list_reduce(list_prepend({v}::UHUGEINT, [lanes[4 * j + {i + 1}] FOR j IN range(0, n // 32)]), lambda a, k: {mixed('a', 'k')}) AS v{i + 1}" for i, v in enumerate(starts))
    wide = low(" + ".join(turn(f"v{i}", r) for i, r in ((1, 1), (2, 7), (3, 12), (4, 18))))
    for i in range(1, 5):
        wide = let(f"w{i}", f"xor({wide}, {mixed(zero, f'v{i}')})", low(f"w{i} * {p1} + {p4}"))
    eights = f"list_reduce(list_prepend(h, lanes[n // 32 * 4 + 1 : n // 8]), lambda a, k: {merged('a', mixed(zero, 'k'))})"
    four = let("r", f"xor(h, {low(f'(b[n // 8 * 8 + 1] + 256 * b[n // 8 * 8 + 2] + 65536 * b[n // 8 * 8 + 3] + 16777216 * b[n // 8 * 8 + 4]) * {p1}')})", low(f"{turn('r', 23)} * {p2} + {p3}"))
    ones = f"list_reduce(list_prepend(h, b[n // 4 * 4 + 1 : n]), lambda a, k: {let('r', f'xor(a, {low(f'k * {p5}')})', low(f'{turn("r", 11)} * {p1}'))})"
    last = let("x", f"xor(h, h >> 33::UHUGEINT)", let("y", low(f"x * {p2}"), let("z", "xor(y, y >> 29::UHUGEINT)", let("u", low(f"z * {p3}"), "xor(u, u >> 32::UHUGEINT)"))))
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, array_to_string(list_slice(w, p, p + 3), ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
e AS (SELECT g, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS UHUGEINT)) AS b FROM (SELECT DISTINCT g FROM s)),
l AS (SELECT g, b, len(b) AS n, [list_reduce(list_reverse(b[8 * j + 1 : 8 * j + 8]), lambda a, k: a * 256 + k) FOR j IN range(0, len(b) // 8)] AS lanes FROM e),
a0 AS (SELECT *, {sums} FROM l),
a1 AS (SELECT g, b, n, lanes, {low(f"CASE WHEN n >= 32 THEN {wide} ELSE {low(f'{seed}::UHUGEINT + {p5}')} END + CAST(n AS UHUGEINT)")} AS h FROM a0),
a2 AS (SELECT g, b, n, {eights} AS h FROM a1),
a3 AS (SELECT g, b, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM a2),
a4 AS (SELECT g, {ones} AS h FROM a3),
hs AS (SELECT g, CAST({last} AS UBIGINT) AS h FROM a4),
f AS (
  SELECT rid, bit_or(CASE WHEN 2 * ones > total THEN (1::UBIGINT << k::UBIGINT) ELSE 0::UBIGINT END) AS fp
  FROM (SELECT rid, k, count(*) AS total, count(*) FILTER ((h >> k::UBIGINT) & 1::UBIGINT = 1) AS ones FROM s JOIN hs USING (g), (SELECT unnest(range(0, 64)) AS k) GROUP BY rid, k) GROUP BY rid),
r AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN f USING (rid)),
u AS (SELECT DISTINCT fp FROM r),
j AS (SELECT x.fp AS a, y.fp AS b FROM u x, u y WHERE bit_count(xor(x.fp, y.fp)) <= 4),
c AS (SELECT a, b FROM j UNION SELECT c.a, j.b FROM c JOIN j ON j.a = c.b),
least_id AS (SELECT a AS fp, min(doc_id) AS component_id FROM c JOIN r ON r.fp = c.b GROUP BY a)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM r JOIN least_id USING (fp)
"""


#: CRC-32 by its table, which follows from the polynomial; the map's edit as a recursion over the slots that move,
#: largest first, each to the shard that holds least.
OP10_SQL = """
WITH RECURSIVE tbl AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
b AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '') AS k FROM documents),
n AS (SELECT *, CAST('0x' || substr(sha1(k), 1, 15) AS BIGINT) AS h, row_number() OVER (PARTITION BY k) - 1 AS copy FROM b),
c AS (
  SELECT doc_id, CAST(strlen(x) + 8 AS BIGINT) AS size, CASE WHEN copy = 0 THEN h ELSE CAST('0x' || substr(sha1(h || ':' || copy), 1, 15) AS BIGINT) END AS h,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda d: CAST('0x' || d AS BIGINT))),
                         lambda a, d: xor(a >> 8, t[xor(a & 255, d) + 1])), 4294967295) AS crc
  FROM n, tbl),
p AS (SELECT doc_id, size, crc, CAST(h % 4096 AS INTEGER) AS vslot, CAST(h // 4096 % 16 AS INTEGER) AS part FROM c),
z AS (SELECT v AS vslot, v % 24 AS shard, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT unnest(range(0, 4096)) AS v) LEFT JOIN p ON vslot = v GROUP BY v),
u AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, vslot ROWS UNBOUNDED PRECEDING) <= (SELECT sum(bytes) / 24 FROM z) AS stays FROM z),
pool AS (SELECT vslot, bytes, row_number() OVER (ORDER BY bytes DESC, vslot) AS i FROM u WHERE NOT stays),
m AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS vslot, CAST(NULL AS BIGINT) AS shard,
         (SELECT list(w ORDER BY shard) FROM (SELECT shard, CAST(coalesce(sum(bytes) FILTER (stays), 0) AS BIGINT) AS w FROM u GROUP BY shard)) AS loads
  UNION ALL
  SELECT pool.i, pool.vslot, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + pool.bytes ELSE v END)
  FROM m JOIN pool ON pool.i = m.i + 1),
s AS (SELECT vslot, shard FROM u WHERE stays UNION ALL SELECT vslot, shard FROM m WHERE i > 0),
g AS (SELECT p.vslot, part, shard, coalesce(sum(count(*)) OVER (PARTITION BY shard ORDER BY p.vslot, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN s ON s.vslot = p.vslot GROUP BY p.vslot, part, shard)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(NULL AS INTEGER) AS grown_shard, p.vslot,
       CAST(before + row_number() OVER (PARTITION BY p.vslot, p.part ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot
FROM p JOIN g ON g.vslot = p.vslot AND g.part = p.part
"""


#: Each window as its words; what is there twice covers its places.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, p, array_to_string(list_slice(w, p, p + 34), ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
r AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS k FROM (SELECT rid, p FROM g SEMI JOIN r USING (s))),
x AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
l AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM x ANTI JOIN c USING (rid, k) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (rid)
"""


#: CRC-32 by its table; words by number; periods q for which some grid point's next q words seem to repeat (words at a few
#: places are looked at), and of these each stretch over which words q apart are equal.
OP12_SQL = r"""
WITH tbl AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                                  lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295), 1) AS h
  FROM documents, tbl),
z AS (SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
y AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM z),
e AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM y),
src AS (SELECT rid, i, CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END AS j FROM (SELECT rid, planted, a, p, unnest(range(0, n)) AS i FROM e)),
orig AS (SELECT rid, unnest(range(0, n)) AS j, unnest(w) AS word FROM e),
num AS (SELECT word, row_number() OVER () AS v FROM (SELECT DISTINCT word FROM orig)),
x AS (SELECT src.rid, i, word, v FROM src JOIN orig ON orig.rid = src.rid AND orig.j = src.j JOIN num USING (word)),
per AS (SELECT rid, n, unnest(range(1, n // 3 + 1)) AS q FROM e WHERE n >= 24),
pts AS (SELECT rid, q, unnest(range(0, n - 2 * q + 1, q)) AS s FROM per),
c1 AS (SELECT pts.rid, q, s FROM pts JOIN x a ON a.rid = pts.rid AND a.i = s JOIN x b ON b.rid = pts.rid AND b.i = s + q WHERE a.v = b.v),
c2 AS (SELECT c1.rid, q, s FROM c1 JOIN x a ON a.rid = c1.rid AND a.i = s + q // 2 JOIN x b ON b.rid = c1.rid AND b.i = s + q // 2 + q WHERE a.v = b.v),
c3 AS (SELECT c2.rid, q, s FROM c2 JOIN x a ON a.rid = c2.rid AND a.i = s + q // 3 JOIN x b ON b.rid = c2.rid AND b.i = s + q // 3 + q WHERE a.v = b.v),
c4 AS (SELECT c3.rid, q, s FROM c3 JOIN x a ON a.rid = c3.rid AND a.i = s + q - 1 JOIN x b ON b.rid = c3.rid AND b.i = s + 2 * q - 1 WHERE a.v = b.v),
c5 AS (SELECT DISTINCT c4.rid, q FROM c4 JOIN x a ON a.rid = c4.rid AND a.i = s + 2 * q // 3 JOIN x b ON b.rid = c4.rid AND b.i = s + 2 * q // 3 + q WHERE a.v = b.v),
eq AS (SELECT c5.rid, q, a.i, a.i - row_number() OVER (PARTITION BY c5.rid, q ORDER BY a.i) AS island FROM c5 JOIN x a ON a.rid = c5.rid JOIN x b ON b.rid = c5.rid AND b.i = a.i + q WHERE a.v = b.v),
st AS (SELECT rid, q, min(i) AS start, max(i) + 1 + q - min(i) AS length FROM eq GROUP BY rid, q, island HAVING max(i) + 1 + q - min(i) >= greatest(24, 3 * q)),
run AS (SELECT rid, start, length, min(q) AS period FROM st GROUP BY rid, start, length),
f AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY rid),
top AS (
  SELECT r.rid, r.start, r.length, r.period FROM run r JOIN (SELECT rid, max(CAST(length AS DOUBLE) / period) AS most FROM run GROUP BY rid) m ON m.rid = r.rid
  WHERE CAST(length AS DOUBLE) / period = most QUALIFY row_number() OVER (PARTITION BY r.rid ORDER BY start, period) = 1),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM run),
l AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN f USING (rid) LEFT JOIN top USING (rid) LEFT JOIN l USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op4_token_counts": OP4_SQL, "op5_warc": OP5_SQL, "op6_bpe": OP6_SQL, "op8_simhash": _op8_sql(), "op10_sharding": OP10_SQL, "op11_superkmers": OP11_SQL, "op12_runs": OP12_SQL}
