"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from corvane.plans.oracle import ORACLE
from corvane.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
KINDS = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLE[name])
    kinds = {c[0]: KINDS[str(c[1])] for c in found.description}
    assert dict(df.dtypes) == kinds
    order = sorted(kinds)
    at = [[c[0] for c in found.description].index(c) for c in order]
    want = sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*order).collect()) == want
