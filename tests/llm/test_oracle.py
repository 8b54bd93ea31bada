"""Queries of this part that SQL can express, against it; and the SQL on texts that are hard on it."""

import duckdb
import pytest

from corvane.llm import queries as Q

DATA = "/root/testdata/sf0.001"
KINDS = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}
ODD = [
    None, "", " ", "a", "A b\tC  d", "I'll say 'tis we've don't", "x" * 700, "  two  blanks  \n\n end ", "\u00a0\u3000 wide \u2028blanks", "１２½ ²3", "a<|endoftext|>b <|endoftext|>", "Ünï çödé 中文 字 😀👍🏽", "!!!??  ...",
    " ".join(f"w{i % 7}" for i in range(400)), " ".join(f"w{i % 7}" for i in range(399)) + " changed", "one two three", "ONE two Three", "tab\x0bform\x0cfeed\r\n", "q" * 31, "q" * 32, "q" * 33 + " " + "r" * 64 + " s t u v",
]


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == DATA else '/*.parquet'}')")
    df, found = Q.queries()[name](spark, folder), con.execute(Q.oracle_sql()[name])
    kinds = {c[0]: KINDS[str(c[1])] for c in found.description}
    assert dict(df.dtypes) == kinds
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    return sorted(map(repr, map(tuple, df.collect()))), sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_given_tables(spark, name):
    got, want = compare(spark, DATA, name)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.oracle_sql()) - {"op5_warc"}))
def test_odd_texts_and_repeated_rows(spark, tmp_path, name):
    rows = [*enumerate(ODD), (3, "a"), (3, "a"), (None, "a"), (None, None), (70, ODD[13])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w0 w1 w2 w3 w4"), (2, "one two"), (2, "one two"), (None, "changed"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = compare(spark, str(tmp_path), name)
    assert got == want
