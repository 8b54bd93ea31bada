import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from corvane.llm import bpe, decontaminate, langid, queries, secrets, simhash
from corvane.llm.common import _bytes, clear_shared, materialize, pick

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA)
        out.append((name, docs, made))
        docs = made
    return out


def test_columns_and_order(spark, stages):
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "secrets", "tokens"]
    assert all(made.columns == columns for _, _, made in stages[:-1])


def test_stages_against_their_operators(spark, stages):
    by = {n: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for n, a, b in stages}
    before, after = by["language"]
    model = langid.train(spark.read.parquet(f"{DATA}/documents.parquet"), langid.may_learn())
    assert set(after) == {r.doc_id for r in langid.predict(stages[0][1], model).where("accepted").collect()} and len(after) > 0.97 * len(before)
    before, after = by["near_duplicates"]
    assert set(after) == {r.component_id for r in simhash.components(stages[1][1], simhash.SIMILAR).collect()} and all(after[i] == before[i] for i in after)
    before, after = by["benchmark"]
    found = {r.doc_id: r for r in decontaminate.hits(stages[2][1], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert any(r.n_hit for r in found.values())
    for i, r in found.items():
        assert (i in after) == (r.n_hit <= 0.5 * r.n_words) and (r.n_hit > 0 or after[i] == before[i])
    before, after = by["secrets"]
    assert set(before) == set(after)
    for i in after:
        changed = bool(secrets.examine(before[i].text)[0])
        assert changed == (after[i].text != before[i].text) and after[i].n_chars == len(after[i].text) and not secrets.examine(after[i].text)[0]
    before, after = by["tokens"]
    assert all(r.bytes.decode() == before[r.doc_id].text for r in bpe.decode(stages[-1][2], queries.RANKS).collect()) and set(after) == set(before)


def test_run_equals_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_intermediate_tables_can_be_cleared(spark):
    made = materialize(spark.range(3), "test")
    assert made.count() == 3
    file = made.inputFiles()[0]
    clear_shared(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(file)


@pytest.mark.parametrize(("text", "n"), [("67108864b", 64 << 20), ("16m", 16 << 20), ("1", 1), ("2 GB", 2 << 30), ("-1", None)])
def test_sizes(text, n):
    assert _bytes(text) == n


def test_pick_takes_exact_names(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, text string, TEXT string, x string").toDF("doc_id", "text", "TEXT", "text")
    assert pick(df, "text", "doc_id").first() == ("a", 1)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_returns_whole_tables(spark, name):
    table = "pages" if name in ("op1_html", "op5_warc") else "documents"
    assert queries.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def odd_documents(spark):
    """Rows that repeat, without ids, without texts; columns whose names clash with each other or with the stages' own."""
    prose = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'").limit(12).collect()]
    rows = [(i, t) for i, t in enumerate(prose)] * 2 + [(None, prose[0]), (None, prose[1]), (None, None), (50, None), (51, ""), (52, "½ ²"), (0, prose[3])]
    rows += [(60, prose[5] + " password: hunter2hunter2"), (61, "lonely little text, password: hunter2hunter2 of its own")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1, "y", 2) for d, t in rows], "a long, b string, c string, d string, e long, f string, g int, h string, i int")
    return df.toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "Doc_ID", "c0", "__c1"), rows


def test_stages_take_odd_rows_and_clashing_names(spark):
    docs, rows = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA)
        got = made.collect()
        assert stage(spark, docs.limit(0), DATA).collect() == []
        if name == "language":
            assert len(got) == sum(bool(t) and t != "½ ²" for _, t in rows)
        if name == "near_duplicates":
            assert len(got) == len({t for _, t in rows if t and t != "½ ²"}) - 1  # one more is a near copy
        if name != "tokens":
            assert made.columns == docs.columns
            assert all(r[7] == "y" and r[5] == "x" and r[4] == len(r[1] or "") for r in got)
            docs = spark.createDataFrame([tuple(r) for r in got], docs.toDF(*"abcdefghi").schema).toDF(*docs.columns)
    assert len(got) == docs.count() and {r.n_tokens > 0 for r in got} == {True}
    assert not any("hunter2" in r[1] for r in docs.collect())


@pytest.mark.parametrize("kind", ["string", "double", "date"])
def test_a_column_that_is_no_count_stays(spark, kind):
    docs = spark.createDataFrame([(1, "password: hunter2hunter2 and " + "w " * 40)], "doc_id long, text string").selectExpr("*", f"cast(null as {kind}) as n_chars")
    bench = spark.createDataFrame([(1, "and w w w w w w w w w w")], "item_id long, text string")
    assert secrets.redact(docs).first().n_chars is None
    assert decontaminate.clean(docs, bench, max_coverage=1.0).first().n_chars is None


def test_run_on_odd_tables(spark, tmp_path):
    docs, rows = odd_documents(spark)
    plain = docs.toDF(*"abcdefghi").selectExpr("a as doc_id", "b as text", "c as lang", "d as source", "e as n_chars", "f as fp", "g as component_id", "h as c0", "i as n_tokens")
    for name, df in (("full", plain), ("empty", plain.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert len(got) == len({t for _, t in rows if t and t != "½ ²"}) - 1


def least_of_similar(rows):
    """The least id of those that a text reaches through pairs of a Jaccard similarity of 0.8, by all pairs."""
    sets = []
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[root(i)][0] for i in range(len(rows))}


def without_windows(text, windows):
    """The text without words in windows of the benchmark, and without what stands between these; None if most are."""
    found = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    words = [m[0] for m in found]
    hit = [False] * len(words)
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
    if sum(hit) > 0.5 * len(words):
        return None
    out, at = "", 0
    for k, m in enumerate(found):
        if hit[k] and (k == 0 or not hit[k - 1]):
            out += text[at : m.start()]
        if hit[k]:
            at = m.end()
    return out + text[at:]


def test_run_against_brute_force(spark):
    """All stages once more, without Spark but for the language model's training."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None)
    model = langid.train(docs, langid.may_learn())
    langs, probs = langid.judge([t for _, t in rows], model)
    rows = [r for r, x, p in zip(rows, langs, probs, strict=True) if x != "und" and p >= model.settings.min_confidence]
    kept = least_of_similar(rows)
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = [x.decode() for x in decontaminate.words(r.text)]
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    rows = [(d, clean) for d, t in rows if d in kept and (clean := without_windows(t, windows)) is not None]
    found = {d: secrets.examine(t) for d, t in rows}
    histogram = Counter((c, b) for _, cands in found.values() for _, _, c, b in cands)
    least = secrets.thresholds([(c, b, n) for (c, b), n in histogram.items()])
    with open(queries.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in rows:
        base, cands = found[d]
        t = secrets.replaced(t, sorted(base + [(a, 3, z) for a, z, c, p in cands if p < least[c]]), "[{}]")
        ids = library.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 100 < len(want) < 200
