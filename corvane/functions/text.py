"""Text as columns: tokens, token filters, byte views. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default stop words.
STOP_WORDS_ZH = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些 "
    "所 为 所以 因为 但是 然而 而且 虽然 如果 可以 还是 只是 之后 然后 已经 这个 那个 什么 怎么 吗 啊 吧 呢 哦 嗯"
).split()
STOP_WORDS_EN = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall "
    "to of in for on with at by from it its and or but not no this that"
).split()
STOP_WORDS = (*STOP_WORDS_ZH, *STOP_WORDS_EN)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of languages that write blanks between them.
TOKEN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def index_tokens(tokens: Column, stop_words: Sequence[str] = STOP_WORDS, extra: Sequence[str] = (), lower: bool = True) -> Column:
    """Tokens as they are indexed: lowered, without stop words, without ASCII tokens of one byte
    or others of under three, without numbers. Repeats stay."""
    stop = [*stop_words, *extra]
    lowered = F.transform(tokens, ascii_lower) if lower else tokens
    # a literal list is looked up by hash; a token is ASCII if it has a byte a character
    return F.filter(lowered, lambda t: (F.octet_length(t) >= F.when(F.octet_length(t) == F.length(t), 2).otherwise(3)) & ~t.isin(stop) & (F.translate(t, "0123456789.", "") != ""))


def word_index_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """index_tokens(word_tokens(text)), lowered in one go."""
    return index_tokens(word_tokens(ascii_lower(text)), stop_words, lower=False)


def latin1(binary: Column) -> Column:
    """One character per byte."""
    return F.decode(binary, "ISO-8859-1")


def two_places(c: Column) -> Column:
    """Two decimals; halves go to the even neighbour."""
    return F.format_string("%.2f", F.bround(c, 2))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words (not patterns)."""
    return F.coalesce(c.rlike("|".join(r"\Q" + w + r"\E" for w in words)), F.lit(False))
