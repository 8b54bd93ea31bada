"""Evidence for standing questions, against SQL."""

import csv
import subprocess
import sys
from pathlib import Path

import duckdb

from jobs import evidence as J
from jobs.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]
COLUMNS = "query_id rank doc_id chunk_index content score lang".split()


def want(where):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet{'' if where == DATA else '/*.parquet'}')")
    found = con.execute(ORACLE["job2_evidence"])
    names = [c[0] for c in found.description]
    return sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()), key=repr)


def got(spark, out):
    return sorted(map(tuple, J.evidence(spark, out).collect()), key=repr)


def paths(where):
    return [f"{where}/{t}.parquet" for t in ("documents", "benchmark", "labels")]


def test_given_tables_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    said = [J.run(spark, *paths(DATA), out) for _ in range(2)]
    assert said[0] == said[1] and said[0]["evidence"] == len(want(DATA))
    assert got(spark, out) == want(DATA)
    assert {p.name[:5] for p in (tmp_path / "out" / "evidence").iterdir() if p.is_dir()} == {"lang="}
    names = [p for p in (tmp_path / "out" / "questions").glob("*.csv")]
    rows = [r for p in names for r in csv.DictReader(p.open())]
    assert len(rows) == said[0]["questions"] and sum(int(r["n_evidence"]) for r in rows) == said[0]["evidence"]
    best = {}
    for r in got(spark, out):
        best.setdefault(r[0], []).append((r[1], r[2]))
    assert all([int(x) for x in r["doc_ids"].split()] == [d for _, d in sorted(best[int(r["query_id"])])] for r in rows)


def test_odd_rows_and_changing_input(spark, tmp_path):
    """Toxic documents, nulls, repeats and ties; a second run over other tables leaves nothing of the first."""
    line = "alpha beta gamma. "
    docs = [(1, line * 80, "en"), (2, line, "de"), (3, line, "de"), (4, "alpha poison", "en"), (5, None, "en"), (None, line, "en"), (6, "", "fr"), (7, "zz", None), (7, "alpha", "fr"), (8, "beta beta", None)]
    asked = [(1, "Alpha beta"), (2, "nothing of it"), (3, ""), (4, None), (None, "alpha"), (5, "beta"), (5, "zz alpha")]
    labels = [(4, 0, 1), (1, 1, 0), (9, 0, 1), (None, 0, 1), (4, 0, 1)]

    def put(rows, schema, name):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")

    put(docs, "doc_id long, text string, lang string", "documents")
    put(asked, "item_id long, text string", "benchmark")
    put(labels, "doc_id long, quality int, toxic int", "labels")
    out = str(tmp_path / "out")
    said = J.run(spark, *paths(tmp_path), out)
    mine = [(q, r, d, c, s) for q, r, d, c, _, s, _ in got(spark, out)]
    assert {q for q, *_ in mine} == {1, 5} and all(d not in (4, 5, None) for _, _, d, _, _ in mine)
    assert [d for q, r, d, c, s in mine if q == 1].count(1) == 2  # two chunks of a document at most
    first = {d: s for q, r, d, c, s in mine if q == 1}
    assert first[2] == first[3] and said["questions"] == len(asked)
    rows = {int(r["query_id"]): int(r["n_evidence"]) for p in (tmp_path / "out" / "questions").glob("*.csv") for r in csv.DictReader(p.open())}
    assert rows == {1: len([m for m in mine if m[0] == 1]), 2: 0, 3: 0, 4: 0, 5: len([m for m in mine if m[0] == 5])}
    put([(2, line, "xx")], "doc_id long, text string, lang string", "documents")
    J.run(spark, *paths(tmp_path), out)
    assert {(d, lang) for _, _, d, _, _, _, lang in got(spark, out)} == {(2, "xx")}


def test_registered_query(spark):
    assert sorted(map(tuple, QUERIES["job2_evidence"](spark, DATA).select(*COLUMNS).collect()), key=repr) == want(DATA)


def test_command_line(tmp_path, spark):
    names = [x for pair in zip(("--documents", "--questions", "--labels"), paths(DATA)) for x in pair]
    done = subprocess.run([sys.executable, "-m", "jobs.evidence", *names, "--out", str(tmp_path / "out")], cwd=REPO, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert got(spark, str(tmp_path / "out")) == want(DATA) and "wrote" in done.stderr
