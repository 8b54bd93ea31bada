import base64
import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import bpe as B

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "'s", "'", "I'll we've 're", "a  b\n\n c\t", "x　y", "１２ab½", "a" * 3000, " " * 500, "'" * 333, "z" * 20_000 + "'s", "\0\x85\xa0 \r\n", "😀👍🏽", "don't'd'm'", "<|endoftext|>"]


def check(texts, library):
    own = B.codec(RANKS)
    for t, p in zip(texts, B.pieces(texts), strict=True):
        assert "".join(p) == t
        ids, digits = own.encode(p)
        at = np.array(ids, np.int32)
        assert ids == library.encode_ordinary(t) and own.decode(at, own.offsets(at)) == t.encode() and digits == " ".join(map(str, ids))


def test_odd_texts(library):
    check(ODD, library)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'stmdrevl aA1 \n\t!é中　"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=8))
def test_any_texts(library, texts):
    check(texts, library)


def test_blocks_and_states(library):
    rng = random.Random(1)
    parts = ["'s", "'re", "'", "t", " ", "  ", "\n", "é", "9", "!", "a" * 600, " " * 520]
    check(["".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(300)], library)


def test_classes_know_at_least_what_python_knows():
    cls = B.classes()
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            assert cls[c] == (B.LETTER if kind == "L" else B.NUMBER)


def test_table(spark, library):
    data = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (1, "repeat"), (1, "repeat")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as N_TOKENS")
    out = B.encode(df, RANKS)
    got = out.collect()
    assert len(got) == len(data)
    for r, (d, t) in zip(got, data, strict=True):
        raw, ids = (t or "").encode(), library.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (d, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.offsets[-1] == len(raw) and all(B.codec(RANKS).token[i] == raw[a:z] for i, a, z in zip(ids, r.offsets, r.offsets[1:]))
    assert [r.bytes for r in B.decode(out, RANKS).collect()] == [(t or "").encode() for _, t in data]
    some = {r.doc_id: r.bytes for r in B.decode(out.where("n_tokens > 5").drop("n_tokens"), RANKS, first=2, last=5).collect()}
    assert all(some[r.doc_id] == b"".join(B.codec(RANKS).token[i] for i in r.ids[2:5]) for r in got if r.n_tokens > 5)
    assert B.encode(df.limit(0), RANKS).collect() == []


def test_decoding_goes_by_the_offsets(monkeypatch):
    """Whatever the number of tokens that are decoded at a time; other offsets, other places."""
    own, text = B.codec(RANKS), "Retained offsets say where bytes go. é中😀 " * 30
    ids = np.array(own.encode(next(B.pieces([text])))[0], np.int32)
    at = own.offsets(ids)
    for n in (1, 7, 1 << 18):
        monkeypatch.setattr(B, "TOKENS", n)
        assert own.decode(ids, at) == text.encode() and own.decode(ids[5:9], at[5:10]) == text.encode()[at[5] : at[9]]
    with pytest.raises((ValueError, IndexError)):
        own.decode(ids, np.concatenate((at[:-1], [at[-1] + 10**9])))


def test_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 5)
    own = B.Codec(RANKS)
    texts = [f"alpha{i} beta{i % 7} gamma" for i in range(50)]
    for _ in range(2):
        for t, p in zip(texts, B.pieces(texts), strict=True):
            assert own.encode(p)[0] == library.encode_ordinary(t)
    assert len(own.ids) < 20
