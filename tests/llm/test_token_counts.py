import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import token_counts as C

PATH = P.path("byte_bpe_50k.json")
DATA = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (None, "No id"), (None, "No id at all"), (5, "a <|endoftext|> b"), (6, "x y " * 20_000), (1, "Hello world"), (1, "other text, same id"), (7, "é中😀")]


def table(spark, data=DATA):
    return spark.createDataFrame(data, "doc_id long, text string")


def test_counts_are_the_librarys(spark):
    lib = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, C.token_counts(table(spark).selectExpr("*", "1 n_tokens", "2 as content"), PATH).collect()), key=repr)
    want = [(d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in DATA]
    assert got == sorted(((*w, w[2] > 1024) for w in want), key=repr)


def test_sentencepiece(spark):
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in C.token_counts(table(spark), path).collect()}
    assert got[1, 11] == len(lib.encode("Hello world")) and got[2, 0] == 0


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    C.token_counts(table(spark), PATH, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in DATA})
    # what is stored is used: a count that was changed comes back
    digest = C.tokenizer_digest(PATH)
    more = table(spark, [(9, "Hello world"), (10, "brand new")])
    C.token_counts(more, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert {r[0] for r in spark.read.parquet(cache).select("tokenizer").distinct().collect()} == {digest}
    C.token_counts(more, P.path("word_bpe_49k.json"), cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 3


def test_stored_counts_are_joined(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    digest = C.tokenizer_digest(PATH)
    spark.createDataFrame([("Hello world",)], "text string").select(C.content().alias("content")).selectExpr("content", "77L as n_tokens", f"'{digest}' as tokenizer").write.partitionBy("tokenizer").parquet(cache)
    assert {r.n_tokens for r in C.token_counts(table(spark, [(1, "Hello world")]), PATH, cache).collect()} == {77}


def test_empty(spark):
    assert C.token_counts(table(spark).limit(0), PATH).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_digest_names_file_and_library(name):
    assert len(C.tokenizer_digest(P.path(name))) == 64
