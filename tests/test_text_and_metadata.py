import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import metadata as meta
from corvane.functions.segment import Cutter, cut, segmented, user_lexicon, with_user_words
from corvane.functions.text import STOP_WORDS, STOP_WORDS_EN, STOP_WORDS_ZH, index_tokens, two_places, word_tokens


def test_stop_word_counts():
    assert (len(STOP_WORDS_ZH), len(STOP_WORDS_EN), len(set(STOP_WORDS))) == (59, 42, 101)


def test_token_filters(spark):
    df = spark.createDataFrame([(["RAG", "a", "The", "2024", "3.5", "...", "法", "É", "ok", "ok", "，"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(index_tokens(F.col("t"))).collect()] == [["rag", "法", "ok", "ok", "，"], []]
    assert df.limit(1).select(index_tokens(F.col("t"), extra=["ok"])).first()[0] == ["rag", "法", "，"]


def test_words_of_null(spark):
    df = spark.createDataFrame([("Über-Straße 12",), (None,)], "t string")
    assert [r[0] for r in df.select(word_tokens(F.col("t"))).collect()] == [["Über", "Straße", "12"], []]


def test_two_places_goes_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.0,)], "x double")
    assert [r[0] for r in df.select(two_places(F.col("x"))).collect()] == ["0.12", "0.38", "2.00"]


def test_segmentation(spark, tmp_path):
    assert cut("知识产权法院审理专利侵权") == ["知识产权法院", "审理", "专利侵权"]
    assert cut("") == [] and cut(None) == [] and cut("RAG 3.5 版") == ["RAG", "3.5", "版"]
    path = tmp_path / "words.txt"
    path.write_text("# comment\n\n审理 20 v\n检索增强\n  生成\t7\n", encoding="utf-8")
    found = user_lexicon(spark, str(path))
    assert sorted(map(tuple, found.collect())) == [("审理", 20, "v"), ("检索增强", 10, "l"), ("生成", 7, "l")]
    words = with_user_words(found)
    df = spark.createDataFrame([("检索增强生成",), (None,)], "t string")
    assert [r[0] for r in df.select(segmented(F.col("t"), words)).collect()] == [["检索增强", "生成"], []]


# text, case number, court, date, case type, litigants, procedure
CASES = [
    ("北京市朝阳区人民法院\n民事判决书\n（2024）京0105民初12345号\n", "（2024）京0105民初12345号", "北京市朝阳区人民法院", "", "民事", "", "一审"),
    ("二〇二四年三月十五日作出\n审判员签名\n2024年3月15日", "", "", "2024-03-15", "", "", ""),
    ("本院于二〇二四年三月十五日作出如下判决", "", "", "2024-03-15", "", "", ""),
    ("（2023）京73民终456号\n侵害商标权纠纷", "（2023）京73民终456号", "", "", "民事", "", "二审（终审）"),
    ("A plain sentence.", "", "", "", "", "", ""),
    ("(2024)abc行复1号 on 2024-1-5", "(2024)abc行复1号", "", "2024-01-05", "行政", "", "复议"),
    ("（2024）" + "京" * 20 + "号（2023）沪01刑再2号", "（2023）沪01刑再2号", "", "", "刑事", "", "再审"),
    ("不服上海市浦东新区人民法院判决，向人民法院上诉。", "", "不服上海市浦东新区人民法院", "", "", "", "二审"),
    ("年月日 二〇二四年十三月一日", "", "", "", "", "", ""),
    ("三\n年 一九九九年三\n月五日", "", "", "", "", "", ""),
    ("一九九九年十二月三十一日", "", "", "1999-12-31", "", "", ""),
    ("原告张三，被告李四五六七八", "", "", "", "", "原告张三， 诉 被告李四五六", ""),
    ("原告" + "长" * 33 + "被告李四。公诉机关", "", "", "", "", "公诉机关", ""),
    ("原告A被告李四", "", "", "", "", "", ""),
    ("", "", "", "", "", "", ""),
    (None, "", "", "", "", "", ""),
]


def test_metadata(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, text string")
    got = meta.with_metadata(df).select(*meta.FIELDS, "doc_id").orderBy("doc_id").collect()
    for r, c in zip(got, CASES, strict=True):
        assert tuple(r)[:6] == c[1:], c[0]
    stored = {r.doc_id for r in meta.doc_metadata(df).collect()}
    assert stored == {i for i, c in enumerate(CASES) if c[1] or c[2] or c[3]}


@pytest.mark.parametrize(("s", "n"), [("二〇二四", 2024), ("十五", 15), ("二十五", 25), ("二十", 20), ("三十一", 31), ("一九九九", 1999), ("十", 10), ("七", 7), ("", 0)])
def test_chinese_numbers(spark, s, n):
    assert spark.createDataFrame([(s,)], "s string").select(meta.chinese_number(F.col("s"))).first()[0] == n


def _date_by_hand(text):
    """As chinese_date tells it, by plain search."""
    value, at = [], 0
    for sign in "年月日":
        to = text.find(sign, at)
        if to < 0:
            return None
        head = text[at:to]
        s = head[len(head.rstrip(meta.NUMERALS)) :]
        digits = [meta.NUMERALS[:-1].find(c) - (c not in "零十") if c != "十" else 10 for c in s]
        if set(s) & {"〇", "零"} or len(s) >= 4:
            n = int("".join(str(d) for d in digits if d < 10) or "0")
            n = n if n < 2**31 else 0
        else:
            n = 0
            for d in digits:
                n = (n * 10 if n else 10) if d == 10 else n + d
        value.append(n)
        at = to + 1
    y, m, d = value
    return f"{y:04d}-{m:02d}-{d:02d}" if y > 1900 and 1 <= m <= 12 and 1 <= d <= 31 else None


def test_chinese_dates_of_any_shape(spark):
    rng = random.Random(5)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randrange(n)))
    texts = [pick("甲\n年月日" + meta.NUMERALS, 25) for _ in range(300)]
    for _ in range(300):
        gap = lambda: rng.choice(["", "", "", "甲 ", "年", "一\n", "日"])
        texts.append(f"{gap()}{rng.choice(['一九', '二〇', '二零', '十', ''])}{pick(meta.NUMERALS, 4)}年{gap()}{pick(meta.NUMERALS, 4)}月{gap()}{pick(meta.NUMERALS, 4)}日{gap()}")
    texts += ["一九九九九年一月一日", "九九九九九九九九九九九年一月一日", "二〇〇〇年十月十日", "年一九九九年一月一日"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", meta.chinese_date(F.col("t")).alias("d"))
    got = {r.i: r.d for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == [_date_by_hand(t) for t in texts]
    assert sum(d is not None for d in got.values()) > 20


def test_court_levels(spark):
    df = spark.createDataFrame([("最高人民法院",), ("某高级人民法院",), ("某中级人民法院",), ("某区人民法院",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(meta.court_level(F.col("c"))).collect()] == ["最高", "高级", "中级", "基层", "", ""]


def test_frequencies_decide():
    """Of two ways to cut, the likelier one; with words alone the one with fewer."""
    words = {"研究": 50, "研究生": 5, "生命": 50, "命": 2, "起源": 20}
    assert cut("研究生命起源", words) == ["研究", "生命", "起源"]
    assert cut("研究生命起源", {**words, "研究生": 50_000, "命": 50_000}) == ["研究生", "命", "起源"]
    assert cut("研究生命起源", ["研究生", "生命", "研究", "起源"]) == ["研究", "生命", "起源"]
    assert cut("未知字词研究", words) == ["未知", "知字", "字词", "研究"] and cut("研究甲", words) == ["研究", "甲"]


def test_likeliest_of_all_cuts():
    rng = random.Random(2)
    for _ in range(200):
        words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 4))): rng.randint(1, 100) for _ in range(8)}
        run = "".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 9)))
        c = Cutter(words)
        value = lambda ws, c=c: sum(c.weight.get(w, c.unknown) for w in ws)
        cuts = [[]]
        for ch in run:  # every way to cut into words and single characters
            cuts = [x for ws in cuts for x in ([*ws, ch], [*ws[:-1], ws[-1] + ch] if ws else [ch])]
        best = max(value(ws) for ws in cuts if all(len(w) == 1 or w in words for w in ws))
        got = c.likeliest(run)
        assert "".join(got) == run and value(got) == pytest.approx(best)
