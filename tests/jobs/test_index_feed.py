"""The feed over growing copies of the tables, against SQL over what is there."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import index_feed as J
from jobs.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


def want(rows):
    """Postings of documents (doc_id, text, lang) by SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute(ORACLE["job1_index_feed"]).fetchall())


def got(spark, out):
    return sorted(map(tuple, J.postings(spark, out).collect()))


@pytest.fixture()
def places(tmp_path):
    return str(tmp_path / "documents.parquet"), str(tmp_path / "out"), str(tmp_path / "checkpoint")


def put(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(folder)


def read_log(spark, out):
    return {r.batch: (r["read"], r.left_out, r.documents) for r in spark.read.json(f"{out}/log").collect()}


def test_two_runs_over_growing_input(spark, places):
    folder, out, check = places
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    put(spark, rows[:60], folder)
    put(spark, rows[60:120], folder)
    assert J.run(spark, folder, out, check) == 1
    assert got(spark, out) == want(rows[:120])
    assert read_log(spark, out) == {0: (120, 0, 120)}
    # more documents, two of them known already, repeats, and rows that name nothing
    new = rows[120:] + [(rows[0][0], "alpha beta alpha", "xx"), (rows[1][0], "", None), (9001, "zeta", "en"), (9001, "eta", "de"), (None, "lost", "en"), (9002, None, "en")]
    put(spark, new, folder)
    assert J.run(spark, folder, out, check) == 1
    now = [r for r in rows if r[0] not in (rows[0][0], rows[1][0])] + [(rows[0][0], "alpha beta alpha", "xx"), (9001, "eta", "de")]
    assert got(spark, out) == want(now)
    assert read_log(spark, out)[1] == (len(new), 2, len(rows[120:]) + 3)
    # nothing new: nothing is written
    before = sorted(p for p in Path(out).rglob("*.parquet"))
    assert J.run(spark, folder, out, check) == 0
    assert sorted(p for p in Path(out).rglob("*.parquet")) == before and got(spark, out) == want(now)
    cut = {(r.doc_id, r.chunk_index): (r.content, r.lang) for r in J.chunks(spark, out).collect()}
    assert cut[rows[0][0], 0] == ("alpha beta alpha", "xx") and cut[9001, 0] == ("eta", "de") and (rows[1][0], 0) not in cut


def test_a_batch_that_runs_again_is_there_once(spark, places):
    folder, out, _ = places
    put(spark, [(1, "one two. " * 100, "en"), (2, "three", None)], folder)
    docs = spark.read.parquet(folder)
    for _ in range(2):
        J.add(docs, 7, out, J.settings())
    assert got(spark, out) == want([(1, "one two. " * 100, "en"), (2, "three", None)])
    assert read_log(spark, out) == {7: (2, 0, 2)}
    J.add(docs.limit(0), 8, out, J.settings())
    assert J.batches(spark, out) == {7}


def test_files_are_taken_in_batches_and_terms_are_pruned(spark, places):
    folder, out, check = places
    for i in range(3):
        put(spark, [(i, f"common word{i}", "en")], folder)
    assert J.run(spark, folder, out, check, J.settings() | {"max_files_per_trigger": 1}) == 3
    assert got(spark, out) == want([(i, f"common word{i}", "en") for i in range(3)])
    bucket = spark.range(1).select(F.pmod(F.crc32(F.lit(b"common")), F.lit(J.settings()["buckets"]))).first()[0]
    found = spark.read.parquet(f"{out}/postings").where(f"bucket = {bucket} and term = 'common'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,common)" in plan
    assert found.count() == 3


def test_tables_of_no_documents(spark, places):
    folder, out, check = places
    put(spark, [(None, None, None)], folder)
    assert J.run(spark, folder, out, check) == 1
    put(spark, [(1, "", "en")], folder)
    assert J.run(spark, folder, out, check) == 1
    assert read_log(spark, out) == {0: (1, 1, 0), 1: (1, 0, 1)}
    put(spark, [(1, "now with words", "en")], folder)
    J.run(spark, folder, out, check)
    assert got(spark, out) == want([(1, "now with words", "en")])


def test_postings_are_not_ranged_and_not_joined(spark, places, monkeypatch):
    folder, out, check = places
    rows = [(i, f"everywhere word{i % 7} other{i}", "en") for i in range(40)]
    put(spark, rows, folder)
    monkeypatch.setattr(J, "SLICE_CHUNKS", 4)
    monkeypatch.setattr(J, "LONG", 2)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert J.run(spark, folder, out, check, J.settings() | {"buckets": 2}) == 1
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert got(spark, out) == want(rows)
    plan = lambda: J.postings(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan()
    # a bucket is several tasks' work, each of which writes its terms in order
    files = list(Path(out).glob("postings/batch=0/bucket=0/*.parquet"))
    assert len(files) > 1
    for f in files:
        terms = [r[0] for r in duckdb.execute("SELECT term FROM read_parquet(?, file_row_number = true) ORDER BY file_row_number", [str(f)]).fetchall()]
        assert terms == sorted(terms)
    # a second batch that replaces nothing needs no join either, one that does leaves the old rows out
    more = [(100, "everywhere again", "de")]
    put(spark, more, folder)
    assert J.run(spark, folder, out, check, J.settings() | {"buckets": 2}) == 1
    assert "Join" not in plan() and got(spark, out) == want(rows + more)
    for text in ("newer", "newest of them"):
        put(spark, [(0, text, "en")], folder)
        assert J.run(spark, folder, out, check, J.settings() | {"buckets": 2}) == 1
    assert got(spark, out) == want(rows[1:] + more + [(0, "newest of them", "en")])
    # what a failed attempt has left of a batch does not count before its documents are there
    J._write(spark.createDataFrame([("lost", 5, 0, 1, 1, 0)], "term string, doc_id long, chunk_index int, tf int, dl int, bucket int"), out, "postings", 9, "bucket")
    assert got(spark, out) == want(rows[1:] + more + [(0, "newest of them", "en")])


def test_registered_query_leaves_its_files(spark):
    from corvane.sources.shared import shared_dir

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert sorted(map(tuple, QUERIES["job1_index_feed"](spark, DATA).collect())) == want(rows)
    there = Path(shared_dir(spark).removeprefix("file:")).glob("jobs/index_feed-*/out/postings/batch=0/bucket=*")
    assert len(list(there)) >= 2


def test_command_line(tmp_path, places, spark):
    folder, out, check = places
    put(spark, [(1, "first text", "en")], folder)
    config = tmp_path / "c.json"
    config.write_text(json.dumps(J.settings() | {"buckets": 3}))
    done = subprocess.run([sys.executable, "-m", "jobs.index_feed", "--documents", folder, "--out", out, "--checkpoint", check, "--config", str(config)], cwd=REPO, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 new batches" in done.stderr and got(spark, out) == want([(1, "first text", "en")])
