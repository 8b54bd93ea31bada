"""The index on disk: counts by batches against counting anew, what reaches the scan, skipped blocks."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import bm25
from corvane.functions.text import word_index_tokens
from corvane.operators.index import Index, counted, counted_words, packed, packed_bounds, packed_words
from corvane.operators.stored import StoredIndex


def rows(spark, docs):
    cells = [(d, i, ts) for d, chunks in docs.items() for i, ts in enumerate(chunks)]
    return counted(spark.createDataFrame(cells, "doc_id string, chunk_index int, tokens array<string>"))


def made(rng, ids, vocabulary):
    return {i: [rng.choices(vocabulary, [1 / (r + 1) for r in range(len(vocabulary))], k=rng.randrange(0, 30)) for _ in range(rng.randrange(1, 4))] for i in ids}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Six batches, half of each replaces documents; and the documents that are there in the end."""
    rng = random.Random(1)
    vocabulary = [f"t{k}" for k in range(60)]
    index = StoredIndex(spark, str(tmp_path_factory.mktemp("stored") / "i"), block_chunks=4, long=20)
    now = {}
    for batch in range(1, 7):
        ids = [f"d{k}" for k in range(20 * (batch - 1), 20 * batch)] + rng.sample(sorted(now), min(len(now), 15))
        new = made(rng, ids, vocabulary)
        index.add(rows(spark, new), index.next_batch(), f"s{batch}")
        now |= new
    return index, now, vocabulary


def same(index, counted_anew):
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(index.postings, "term", "doc_id", "chunk_index", "tf") == key(counted_anew.postings, "term", "doc_id", "chunk_index", "tf")
    assert key(index.chunk_stats, "doc_id", "chunk_index", "dl") == key(counted_anew.chunk_stats, "doc_id", "chunk_index", "dl")
    assert key(index.doc_freq, "term", "df") == key(counted_anew.doc_freq(counted_anew.postings), "term", "df")
    assert index.corpus_stats.first() == pytest.approx(tuple(counted_anew.corpus_stats.first()))
    assert index.size().first() == counted_anew.size().first()


def test_counts_equal_those_taken_anew(spark, grown, tmp_path):
    index, now, _ = grown
    anew = Index.of(rows(spark, now))
    same(index, anew)
    assert index.batches() == [1, 2, 3, 4, 5, 6] and index.sources() == {f"s{k}" for k in range(1, 7)}
    merged = index.merged(str(tmp_path / "m"))
    same(merged, anew)
    assert merged.batches() == [1]
    with pytest.raises(ValueError, match="another folder"):
        index.merged(index.path)


def test_what_a_failed_batch_has_left_is_not_read(spark, grown, tmp_path):
    _, now, _ = grown
    index = StoredIndex(spark, str(tmp_path / "i")).add(rows(spark, now), 1)
    left = rows(spark, {"d1": [["never"]], "x": [["never"]]})
    left.write.parquet(f"{index.path}/forward/batch=2")
    left.select("doc_id", F.lit(1).alias("of")).write.parquet(f"{index.path}/gone/batch=2")
    same(index, Index.of(rows(spark, now)))
    assert index.next_batch() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        index.add(left, 2)


def test_terms_reach_the_scan(spark, grown):
    index, _, _ = grown
    asked = spark.createDataFrame([(0, ["t1", "t2"])], "query_id long, terms array<string>")
    plan = plan_of(bm25.search(index.index(), asked, 5))
    assert plan.count("In(term, [") >= 2 or plan.count("In(term,") >= 2  # postings and the dictionary
    assert "avg(" not in plan.replace("avgdl", "") and "forward" not in plan


def test_empty_and_tokenless(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"))
    assert index.batches() == [] and index.next_batch() == 1 and index.sources() == set()
    index.add(rows(spark, {"a": [["x"]]}).limit(0), 1)
    assert index.corpus_stats.first() == (0, 0.0) and index.size().first() == (0, 0, 0)
    index.add(rows(spark, {"a": [[], ["x"]], "b": [[]], None: [["y"]]}), 2)
    assert index.corpus_stats.first() == (3, pytest.approx(1 / 3)) and index.size().first() == (1, 3, 2)
    index.add(rows(spark, {"a": [[]]}), 3)
    assert index.size().first() == (0, 2, 2) and index.postings.collect() == []


@pytest.mark.parametrize("first", [1, 3])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_skipping_blocks_changes_nothing(spark, grown, first, k):
    index, _, vocabulary = grown
    rng = random.Random(k)
    asked = [(i, rng.choices(vocabulary, k=rng.randrange(1, 5))) for i in range(25)] + [(90, []), (91, ["none"]), (92, ["t0", "none", "t0"]), (93, ["t59"])]
    queries = spark.createDataFrame(asked, "query_id long, terms array<string>")
    want = sorted((r.query_id, r["rank"], r.doc_id, r.chunk_index, round(r.bm25_score, 9)) for r in bm25.search(index.index(), queries, k).collect())
    pruned = bm25.search_pruned(index, queries, k, first)
    assert sorted((r.query_id, r["rank"], r.doc_id, r.chunk_index, round(r.bm25_score, 9)) for r in pruned.found.collect()) == want
    read = pruned.read.first()
    assert 0 < read.read <= read.postings
    if k == 1:
        assert read.read < 0.9 * read.postings


def test_hits_are_summed_in_tasks_of_bounded_size(spark, grown, monkeypatch):
    index, now, vocabulary = grown
    monkeypatch.setattr(bm25, "SUMMED", 20)
    asked = spark.createDataFrame([(0, vocabulary[:4])], "query_id long, terms array<string>")
    got, want = bm25.scores(index.index(), asked), bm25.scores(Index.of(rows(spark, now)), asked)
    hits = index.postings.where(F.col("term").isin(vocabulary[:4])).count()
    assert got.rdd.getNumPartitions() >= hits / 20 > 4
    key = lambda df: sorted((r.doc_id, r.chunk_index, round(r.bm25_score, 9)) for r in df.collect())
    assert key(got) == key(want)


def test_postings_of_rare_terms_are_shuffled_once(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), F.expr("transform(sequence(1, 20), k -> concat('w', id, '_', k))").alias("tokens"))
    store = spark.sparkContext._jsc.sc()
    store.listenerBus().waitUntilEmpty(30000)
    seen = spark._jvm.scala.jdk.javaapi.CollectionConverters
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in seen.asJava(store.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = stages()
    index = StoredIndex(spark, str(tmp_path / "i")).add(counted(docs), 1)
    store.listenerBus().waitUntilEmpty(30000)
    moved = sum(n for k, n in stages().items() if k not in before)
    # the postings, and each term's count for the dictionary and as it is ranged; not once more for bounds that no term has
    assert index.doc_freq.count() == 8000 and index.blocks.count() == 0
    assert moved < 4 * 8000


def stages(spark):
    store = spark.sparkContext._jsc.sc()
    store.listenerBus().waitUntilEmpty(30000)
    seen = spark._jvm.scala.jdk.javaapi.CollectionConverters
    return {s.stageId(): s.shuffleWriteRecords() for s in seen.asJava(store.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}


def test_words_are_counted_as_by_expressions(spark):
    texts = ["The ab a B7 77 7x é 中 中文 ab AB", "", None, "\x00ab\x7fab\ncd", "是 the IS 12.5 ", "x" * 5000, "ÀB àb I\u0307 ab\u2003cd"]
    docs = spark.createDataFrame([(f"d{i}", i, t) for i, t in enumerate(texts)], "doc_id string, chunk_index int, content string")
    want = counted(docs.select("doc_id", "chunk_index", word_index_tokens(F.col("content")).alias("tokens")))
    got = counted_words(docs)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_term_moves_as_one_row_a_pack(spark, tmp_path):
    docs = spark.range(0, 3000, 1, 3).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.expr("concat('both ', if(id % 2 = 0, 'even', 'odd'))").alias("content"))
    before = stages(spark)
    index = StoredIndex(spark, str(tmp_path / "i"), long=100).add(counted_words(docs), 1)
    # the documents are counted by their ids; of 6,000 postings next to none is moved alone
    assert sum(n for k, n in stages(spark).items() if k not in before) < 3600
    assert {(r.term, r.df) for r in index.doc_freq.collect()} == {("both", 3000), ("even", 1500), ("odd", 1500)}
    own = index.postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, index.blocks.select(*own.columns).collect()))
    assert packed_bounds(spark.read.parquet(f"{index.path}/forward").limit(0), 4).count() == 0


def test_one_batch_is_copied_without_a_shuffle(spark, grown, tmp_path):
    _, now, _ = grown
    index = StoredIndex(spark, str(tmp_path / "i")).add(rows(spark, now), 1, "s")
    before = stages(spark)
    merged = index.merged(str(tmp_path / "m"), "t")
    # but for the number of batches
    assert sum(n for k, n in stages(spark).items() if k not in before) < 20
    assert merged.sources() == {"t"} and merged.next_batch() == 2
    same(merged, Index.of(rows(spark, now)))


def test_words_are_packed_without_a_table_between(spark):
    texts = spark.createDataFrame([(f"d{i}", i % 3, f"Common word{i % 5} common 中文字 w{i} 12 a" if i % 4 else "") for i in range(50)] + [("none", 0, None)], "doc_id string, chunk_index int, content string").coalesce(2)
    found = sorted(map(tuple, packed_words(texts, 4).collect()))
    assert found == sorted(map(tuple, packed(counted_words(texts), 4).collect())) and any(len(r[3]) > 4 for r in found)
    assert packed_words(texts.limit(0), 4).count() == 0


def test_runs_are_not_shuffled_and_tell_the_same(spark, grown, tmp_path, monkeypatch):
    """Large batches: postings stay where their chunks are read, and none of their counted rows is stored besides."""
    from corvane.operators import index as made, stored

    monkeypatch.setattr(stored, "SMALL", 0)
    monkeypatch.setattr(made, "RUN_POSTINGS", 40)
    monkeypatch.setattr(made, "HANDED", 7)
    word = lambda i: f"concat('both ', if({i} % 2 = 0, 'even ', 'odd '), 'w', {i} % 7, if({i} % 5 = 0, ' both', ''))"
    docs = spark.range(0, 300, 1, 3).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.expr(f"if(id = 8, '', {word('id')})").alias("content"))
    before = stages(spark)
    index = StoredIndex(spark, str(tmp_path / "i"), block_chunks=4, long=20).add_texts(docs, 1)
    # the ids for their number, and a count of each term a task
    assert sum(n for k, n in stages(spark).items() if k not in before) < 500
    assert "terms" not in spark.read.parquet(f"{index.path}/forward").columns
    same(index, Index.of(counted_words(docs)))
    again = docs.where("doc_id % 3 = 0").select("doc_id", "chunk_index", F.concat("content", F.lit(" again")).alias("content"))
    index.add_texts(again, 2)
    now = Index.of(counted_words(docs.where("doc_id % 3 > 0").unionByName(again)))
    same(index, now)
    assert index.doc_freq.where("term = 'again'").first().df == 100
    same(index.merged(str(tmp_path / "m")), now)
    # without bounds the same is found
    plain = StoredIndex(spark, str(tmp_path / "p"), long=None).add_texts(docs, 1).add_texts(again, 2)
    asked = spark.createDataFrame([(0, ["both", "w3"]), (1, ["again", "even"])], "query_id long, terms array<string>")
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.bm25_score, 9)) for r in df.collect())
    assert plain.blocks.count() == 0 and index.blocks.count() > 0
    assert key(bm25.search_pruned(plain, asked, 3).found) == key(bm25.search_pruned(index, asked, 3, 1).found) == key(bm25.search(now, asked, 3))
