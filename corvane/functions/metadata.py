"""Metadata of Chinese judgments as columns: case number, court, date, case type, parties,
procedure. What is absent is the empty string. Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a case number and what they stand for.
CASE_TYPES = {"民": "民事", "刑": "刑事", "行": "行政", "知": "知识产权", "商": "商事", "国": "国家赔偿", "破": "破产", "法": "司法协助", "执": "执行"}
PROCEDURES = {"初": "一审", "终": "二审（终审）", "再": "再审", "申": "申请再审", "复": "复议", "监": "检察监督", "赔": "赔偿", "特": "特别程序", "破": "破产程序"}
COURT_LEVELS = ("最高", "高级", "中级")
NUMERALS = "零〇一二三四五六七八九十"

FIELDS = ("case_number", "court", "date", "case_type", "litigants", "procedure")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(table[key], F.lit(""))


def case_number(text: Column) -> Column:
    """The first bracket with a year whose next 号 ends at most 40 bytes on."""
    found = F.regexp_extract_all(text, F.lit(r"(?=([(（]\d{4}[^号]*号))"), F.lit(1))
    # a text without the sign is not looked through bracket by bracket
    return F.when(F.contains(text, F.lit("号")), F.coalesce(F.get(F.filter(found, lambda x: F.octet_length(x) <= 43), 0), F.lit(""))).otherwise("")


def court(text: Column) -> Column:
    """The last 人民法院 with two characters or more before it, and up to ten of these."""
    backwards = F.regexp_extract(F.reverse(text), r"院法民人[^\x00-\x7F。，、：]{2,10}", 0)
    return F.when(F.contains(text, F.lit("人民法院")), F.reverse(backwards)).otherwise("")


def _ymd(found: Column, pattern: str) -> Column:
    part = lambda k: F.lpad(F.regexp_extract(found, pattern, k), 2 if k > 1 else 4, "0")
    return F.when(found != "", F.concat_ws("-", part(1), part(2), part(3)))


def arabic_date(text: Column) -> Column:
    """The first date with 年, 月 and 日, else the first ISO date; neither is validated. Null if none."""
    written, iso = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})-(\d{1,2})-(\d{1,2})"
    first = lambda pattern: _let(F.regexp_extract(text, pattern, 0), lambda found: _ymd(found, pattern))
    return F.coalesce(F.when(F.contains(text, F.lit("年")), first(written)), F.when(F.contains(text, F.lit("-")), first(iso)))


def chinese_number(s: Column) -> Column:
    """Digits by place if it has a zero or four characters and more, else tens and ones."""
    by_place = F.coalesce(F.translate(s, NUMERALS, "00123456789").try_cast("int"), F.lit(0))
    added = F.aggregate(
        F.split(F.translate(s, NUMERALS[:-1], "00123456789"), ""),
        F.lit(0),
        lambda n, c: F.when(c == "十", F.when(n == 0, 10).otherwise(n * 10)).otherwise(n + F.coalesce(c.try_cast("int"), F.lit(0))),
    )
    return F.when(F.contains(s, F.lit("〇")) | F.contains(s, F.lit("零")) | (F.length(s) >= 4), by_place).otherwise(added)


def chinese_date(text: Column) -> Column:
    """By the text's first 年, the next 月 and the next 日 after it, in numerals right before each."""
    # texts are cut at the signs, and of what stands before one only its end is looked at
    after = lambda t, sign: F.substring(t, F.instr(t, sign) + 1, F.length(t))
    tail = lambda t, sign: F.when(F.contains(t, F.lit(sign)), F.reverse(F.regexp_extract(F.reverse(F.substring_index(t, sign, 1)), rf"\A[{NUMERALS}]+", 0))).otherwise("")
    number = lambda t, sign, then: _let(tail(t, sign), lambda s: F.when(s != "", _let(chinese_number(s), then)))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    day = lambda y, m, t: number(t, "日", lambda d: F.when(d.between(1, 31), F.concat_ws("-", y.cast("string"), two(m), two(d))))
    month = lambda y, t: number(t, "月", lambda m: F.when(m.between(1, 12), _let(after(t, "月"), lambda u: day(y, m, u))))
    return number(text, "年", lambda y: F.when(y > 1900, _let(after(text, "年"), lambda t: month(y, t))))


def date(text: Column) -> Column:
    return F.coalesce(arabic_date(text), chinese_date(text), F.lit(""))


def case_type(number: Column) -> Column:
    """By the first telling character after the closing bracket; an ASCII bracket goes first."""
    kinds = "".join(CASE_TYPES)
    bracket = F.when(F.instr(number, ")") > 0, ")").otherwise("）")
    after = F.when(F.instr(number, bracket) > 0, F.substring(number, F.instr(number, bracket) + 1, F.length(number))).otherwise("")
    return _lookup(CASE_TYPES, F.regexp_extract(after, f"[{kinds}]", 0))


def litigants(text: Column) -> Column:
    """Plaintiff and defendant, up to four characters each, if under 100 bytes lie between the
    words; else the prosecutor's office if there is one."""
    wide = r"[ࠀ-￿]"
    at = F.instr(text, "原告")
    rest = F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise("")
    to = F.instr(rest, "被告")
    between = F.substring(rest, F.lit(1), F.greatest(to - 1, F.lit(0)))
    first = F.regexp_extract(between, rf"^{wide}{{1,4}}", 0)
    second = F.regexp_extract(F.substring(rest, to + 2, F.length(text)), rf"^{wide}{{1,4}}", 0)
    both = (at > 0) & (to > 0) & (F.octet_length(between) + 6 < 100) & (first != "") & (second != "")
    return F.when(both, F.concat(F.lit("原告"), first, F.lit(" 诉 被告"), second)).when(F.instr(text, "公诉机关") > 0, "公诉机关").otherwise("")


def _any(text: Column, *words: str) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def procedure(number: Column, text: Column, court_name: Column) -> Column:
    by_number = _lookup(PROCEDURES, F.regexp_extract(number, f"[{''.join(PROCEDURES)}]", 0))
    return (
        F.when(by_number != "", by_number)
        .when(_any(text, "二审", "上诉", "终审"), "二审")
        .when(_any(text, "再审", "审判监督"), "再审")
        .when(_any(text, "一审"), "一审")
        .when(court_name.contains("最高"), "二审/再审")
        .otherwise("")
    )


def court_level(court_name: Column) -> Column:
    """最高, 高级 or 中级, else 基层; the empty string for no court."""
    out = F.when(F.coalesce(court_name, F.lit("")) == "", "")
    for level in COURT_LEVELS:
        out = out.when(court_name.contains(level), level)
    return out.otherwise("基层")


def with_metadata(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the six fields."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"case_number": case_number(t), "court": court(t), "date": date(t), "litigants": litigants(t)})
    return out.withColumns({"case_type": case_type(F.col("case_number")), "procedure": procedure(F.col("case_number"), t, F.col("court"))})


def is_empty() -> Column:
    """Such rows are not stored: neither case number nor court nor date."""
    return (F.col("case_number") == "") & (F.col("court") == "") & (F.col("date") == "")


def doc_metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the six fields of the documents that have any to store. The test is made on the
    finished row; as a filter it would move below the projection and extract all fields again."""
    row = F.struct(*FIELDS)
    kept = F.filter(F.array(row), lambda m: (m["case_number"] != "") | (m["court"] != "") | (m["date"] != ""))
    return with_metadata(docs, text_col).select(F.col(id_col).alias("doc_id"), F.inline_outer(kept)).where("case_number is not null")
