"""Secret scans: fixed patterns, and a randomness test battery under length-aware FDR control.

Every run of 20 or more characters that keys are written in is a candidate, and so are its parts of
20 or more between separators (a token within a path, or behind a prefix) and hex in groups with
dashes. The encoding is inferred, the smallest alphabet that fits (digits, hex, base32, base36,
base58, base62, base64, base64url), and each symbol gets its place in that alphabet. Three tests ask whether the places look drawn at random: chi-squared uniformity over bins of
the alphabet, a Wald-Wolfowitz runs test about its middle, and lag-one serial correlation.
Where words fit the alphabet too, the number of digits (base36) or small letters (base58 and on) and
their runs are tested as well.
The least p-value times the number of tests is the candidate's p-value for "it is random".

A candidate is cleared when this is rejected. Rejections are made by the Benjamini-Hochberg
step-up rule within each class of lengths over all documents, so of the random strings in the
corpus at most a share of about `fdr` is cleared among those cleared, short ones as well as
long. The rule needs only a histogram of p-values per class, which Spark sums up; p-values
are rounded up to the bin's upper end, which errs towards keeping a candidate. The rest,
whose randomness is not rejected, are spans of kind `random`, without those that lie within another.

Spans are in code points, end exclusive. Defined results: a null or empty text has no spans; a null id stays null;
repeated rows come back repeated; an empty table gives an empty result; extra columns are
ignored by `scan` and kept by `redact`. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import arrow_batch, count_position, materialize, numbered, pick, position, slices

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LENGTHS = (20, 24, 32, 48, 64, 128)
BINS, PER_DECADE = 400, 20
FDR = 0.01

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "digits": (re.compile(r"[0-9]+"), DIGIT),
    "hex": (re.compile(r"[0-9a-f]+|[0-9A-F]+"), DIGIT + "abcdef"),
    "base32": (re.compile(r"[A-Z2-7]+"), UPPER + "234567"),
    "base36": (re.compile(r"(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]+"), LOWER + DIGIT),
    "upper36": (re.compile(r"(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]+"), UPPER + DIGIT),
    "base58": (re.compile(r"[1-9A-HJ-NP-Za-km-z]+"), "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz123456789"),
    "base62": (re.compile(r"[A-Za-z0-9]+"), UPPER + LOWER + DIGIT),
    "base64": (re.compile(r"[A-Za-z0-9+/]+"), UPPER + LOWER + DIGIT + "+/"),
    "base64url": (re.compile(r"[A-Za-z0-9_-]+"), UPPER + LOWER + DIGIT + "-_"),
}
DASHED = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]+(?:-[0-9a-f]+)+|[0-9A-F]+(?:-[0-9A-F]+)+)(?![A-Za-z0-9])")
PARTS = [re.compile(rf"[^{x}]{{{LENGTHS[0]},}}") for x in ("/+", "_-", "/+_", "/+-", "/+_-")]
PLACES = {k: {c: i for i, c in enumerate(a)} for k, (_, a) in ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def hex_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Hex runs of 24 or more; each lies within a run of key characters."""
    return [(a + m.start(), 2, a + m.end()) for a, z in runs for m in HEX.finditer(text[a:z]) if m.end() - m.start() >= LEAST_HEX]


def encoding(run: str) -> str | None:
    """None: characters of both base64 alphabets, which no encoding writes (paths, say)."""
    return next((k for k, (whole, _) in ALPHABETS.items() if whole.fullmatch(run)), None)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution: the regularised incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-10:
            break
    return min(1.0, scale * h)


def battery(run: str, kind: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation under the hypothesis of randomness."""
    k = len(ALPHABETS[kind][1])
    v = np.array([PLACES[kind][c] for c in (run.lower() if kind == "hex" else run)], np.int64)
    n = len(v)
    bins = max(2, min(k, n // 5))
    width = np.bincount(np.arange(k) * bins // k, minlength=bins)
    expected = width * n / k
    uniform = chi2_tail(float(((np.bincount(v * bins // k, minlength=bins) - expected) ** 2 / expected).sum()), bins - 1)
    high = v >= k // 2
    n1, n0 = int(high.sum()), int(n - high.sum())
    if not n1 or not n0:
        above = 2.0 ** (1 - n)
    else:
        mean = 2 * n1 * n0 / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        above = math.erfc(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(2 * var))
    d = v - v.mean()
    total = float((d * d).sum())
    serial = math.erfc(abs(float((d[1:] * d[:-1]).sum()) / total + 1 / n) * math.sqrt(n / 2)) if total else 0.0
    return uniform, above, serial


def classes(run: str, kind: str) -> tuple[float, float]:
    """p-values of the number of digits (base36) or small letters, and of runs of these and others."""
    own = DIGIT if kind.endswith("36") else LOWER
    of, alphabet = np.array([c in own for c in run]), ALPHABETS[kind][1]
    n, n1, p = len(run), int(of.sum()), sum(c in own for c in alphabet) / len(alphabet)
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(n + 1)]
    count = min(1.0, 2 * min(sum(map(math.exp, log[: n1 + 1])), sum(map(math.exp, log[n1:]))))
    mean = 2 * n1 * (n - n1) / n + 1
    var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    return count, math.erfc(abs(1 + int((of[1:] != of[:-1]).sum()) - mean) / math.sqrt(2 * var))


def candidate(run: str) -> tuple[int, int] | None:
    """(length class, p-value bin) of a run; None if no encoding has it. Dashes in hex do not count."""
    body = run.rstrip("=")
    if "-" in body and DASHED.fullmatch(body):
        body = body.replace("-", "")
    kind = encoding(body)
    if kind is None or len(body) < LENGTHS[0]:
        return None
    tests = battery(body, kind)
    if kind not in ("digits", "hex", "base32"):
        tests += classes(body, kind)
    p = min(1.0, len(tests) * min(tests))
    return sum(len(body) >= x for x in LENGTHS) - 1, min(BINS - 1, int(-math.log10(max(p, 1e-300)) * PER_DECADE))


def parts(run: str) -> set[tuple[int, int]]:
    """Spans of the run, its parts between separators, and hex with dashes."""
    out = {(0, len(run))}
    if any(c in run for c in "/+_-"):
        for one in (DASHED, *PARTS):
            out.update(m.span() for m in one.finditer(run))
    return out


def examine(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans by start, then kind; candidates (start, end, class, bin) outside of them."""
    if not text:
        return [], []
    runs = [m.span() for m in RUN.finditer(text)]
    base = sorted(base_spans(text) + hex_spans(text, runs))
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))  # the last end among the first spans
    out = []
    for a, z in runs:
        for i, j in sorted(parts(text[a:z])):
            before = bisect_left(starts, a + j)
            if not before or ends[before - 1] <= a + i:
                found = candidate(text[a + i : a + j])
                if found:
                    out.append((a + i, a + j, *found))
    return base, out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def thresholds(histogram: list[tuple[int, int, int]], fdr: float = FDR) -> list[int]:
    """Per length class the least bin that is rejected (BINS + 1: none), by the step-up rule.
    histogram: (class, bin, candidates); a bin's p-value is its upper end, 10^(-bin/20)."""
    out = [BINS + 1] * len(LENGTHS)
    for cls in range(len(LENGTHS)):
        own = sorted(((b, n) for c, b, n in histogram if c == cls), reverse=True)
        m, rank = sum(n for _, n in own), 0
        for b, n in own:  # from the least p-value on
            rank += n
            if 10 ** (-b / PER_DECADE) <= fdr * rank / m:
                out[cls] = b
    return out


CANDIDATE = "array<struct<start:int,end:int,cls:int,bin:int>>"
PA_CANDIDATE = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "cls", "bin")]))


def _histogram(found: DataFrame) -> list[tuple[int, int, int]]:
    """At most 6 x 400 rows."""
    seen = found.select(F.explode("candidates").alias("c")).groupBy("c.cls", "c.bin").count()
    return sorted(tuple(r) for r in seen.collect())


def scan(docs: DataFrame, fdr: float = FDR, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random; a row per row of docs."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [examine(t) for t in batch.column(1).to_pylist()]
            kinds = [[k for _, k, _ in base] for base, _ in found]
            yield arrow_batch(
                [batch.column(0), *([k.count(i) for k in kinds] for i in range(3)), [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found],
                 [[{"start": a, "kind": k, "end": z} for a, k, z in b] for b, _ in found],
                 [[{"start": a, "end": z, "cls": c, "bin": p} for a, z, c, p in cs] for _, cs in found]],
                pa.schema([("doc_id", batch.column(0).type), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()),
                           ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))), ("candidates", PA_CANDIDATE)]),
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, candidates {CANDIDATE}"
    found = materialize(rows.mapInArrow(run, fields), "secrets")
    least = F.array(*[F.lit(b) for b in thresholds(_histogram(found), fdr)])
    kept = found.withColumn("candidates", F.filter("candidates", lambda c: c["bin"] < F.get(least, c["cls"])))
    inner = lambda c, o: (o["start"] <= c["start"]) & (c["end"] <= o["end"]) & (o["end"] - o["start"] > c["end"] - c["start"])
    random = F.transform(
        F.filter("candidates", lambda c: ~F.exists("candidates", lambda o: inner(c, o))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", random)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return kept.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(random).cast("long").alias("n_random"))


def redact(docs: DataFrame, fdr: float = FDR, text_col="text", chars_col: str | None = "n_chars", mark: str = "[{}]") -> DataFrame:
    """docs, all rows and columns, each secret replaced by its kind in brackets (chars_col, if it is there and
    holds whole numbers, is set anew). Two passes: the first sums the histogram of p-values, the second applies it."""
    found = scan_candidates(docs, text_col)
    least = thresholds(_histogram(found), fdr)
    at, n_at, rows = position(docs, text_col), count_position(docs, chars_col), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            texts = part.column(at).to_pylist()
            chars = part.column(n_at).to_pylist() if n_at is not None else None
            changed = False
            for i, text in enumerate(texts):
                base, cands = examine(text)
                spans = sorted(base + [(a, 3, z) for a, z, c, p in cands if p < least[c]])
                if spans:
                    texts[i], changed = replaced(text, spans, mark), True
                    if chars is not None:
                        chars[i] = len(texts[i])
            if changed:
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    columns[n_at] = pa.array(chars, columns[n_at].type)
                part = pa.RecordBatch.from_arrays(columns, names=part.schema.names)
            yield part

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def scan_candidates(docs: DataFrame, text_col="text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [examine(t)[1] for t in batch.column(0).to_pylist()]
            yield arrow_batch([[[{"start": a, "end": z, "cls": c, "bin": p} for a, z, c, p in cs] for cs in found]], pa.schema([("candidates", PA_CANDIDATE)]))

    return pick(docs, text_col).toDF("text").mapInArrow(run, T.StructType.fromDDL(f"candidates {CANDIDATE}"))


def replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """Overlapping spans become one, named by the first."""
    out, last = [], 0
    for a, k, z in spans:
        if a >= last:
            out += [text[last:a], mark.format(KINDS[k])]
        last = max(last, z)
    return "".join([*out, text[last:]])
