import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import langid as L

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = L.train(docs, L.may_learn())
    got = L.predict(docs, model).join(docs.select("doc_id", "lang", (~L.may_learn()).alias("held")), "doc_id").where("held").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


TRAINING = [(i, ("the house of the rising sun and the sea " if i % 2 else "der Hund und das Haus sind nicht da ") * (1 + i % 3), "en" if i % 2 else "de") for i in range(200)]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(rows(spark, TRAINING), F.lit(True), L.Settings(max_docs=200))


def test_nulls_empty_texts_and_odd_rows(spark, model):
    data = [(1, None, "en"), (2, "", None), (3, "123 !!", "de"), (4, "the sun and the sea", None), (None, "das Haus und der Hund", None), (4, "the sun and the sea", None), (5, "und " * 300_000, None)]
    df = rows(spark, data).selectExpr("*", "1 as score", "'x' as LANG_PRED")
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(df, model).collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "en", "de", "en", "de"] and got[0][2] == 0.0 and got[3] == got[5]
    kept = L.keep_confident(df, model).collect()
    assert [r.doc_id for r in kept] == [4, None, 4, 5] and kept[0].LANG_PRED == "x"


def test_order_does_not_matter(spark, model):
    again = L.train(rows(spark, TRAINING[::-1]).repartition(7), F.lit(True), L.Settings(max_docs=200))
    assert np.array_equal(again.table, model.table) and again.temperature == model.temperature


def test_long_texts_are_scored_in_steps(model):
    texts = ["the sun ", "das Haus und " * 200_000, "x", "sea and " * 70_000]
    together = L.scores([t.encode() for t in texts], model)
    for t, p in zip(texts, together, strict=True):
        assert L.scores([t.encode()], model)[0] == pytest.approx(p, abs=1e-6)
        ids, n = L.counts_of(t, model.settings.buckets)
        z = (n @ model.table[ids] / n.sum() + model.bias) / model.temperature
        assert L._softmax(z[None, :])[0] == pytest.approx(p, abs=1e-4)


def test_nothing_to_learn_from(spark):
    df = rows(spark, [(1, "text", None), (2, None, "en")])
    assert L.train(df, F.lit(True)) is None
    assert [r.lang_pred for r in L.predict(df, None).collect()] == ["und", "und"]
    assert L.keep_confident(df, None).count() == 0 and L.predict(df.limit(0), None).count() == 0


def test_held_out_rows_are_never_learned_from(spark):
    import zlib

    df = spark.range(300).select(F.col("id").alias("doc_id"), L.may_learn("id").alias("may"))
    assert all(r.may == (zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for r in df.collect())
    assert spark.createDataFrame([(None,)], "doc_id long").select(L.may_learn()).first()[0] is False


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """Rows of one id, rows that repeat as a whole, and many languages."""
    taken = []
    monkeypatch.setattr(L, "fit", lambda got, s: taken.append([r[0] for r in got]))
    same_id = [(7, f"text number {chr(97 + i % 26)} {i}", "en") for i in range(5000)]
    again = [(i % 3, "das ist der eine Text", "de") for i in range(5000)]
    few = [(i, f"la casa {i}", "es") for i in range(5)]
    for rows_ in (same_id, same_id + again + few):
        L.train(rows(spark, rows_), F.lit(True), L.Settings(max_docs=300))
    assert 200 <= len(taken[0]) <= 300
    n = {lang: taken[1].count(lang) for lang in set(taken[1])}
    assert n["en"] == 100 and 1 <= n.get("de", 3) <= 3 and n["es"] <= 5
