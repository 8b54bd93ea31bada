"""Text of PDF files: content streams, their filters, and the operators that show text."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

START = re.compile(rb"(?<=[\n\r >])stream\r?\n|(?<=[\n\r >])stream\r")
DICT_BYTES = 2048
SPACE = b"\0\t\n\f\r "
DELIMITERS = b"()<>[]{}/%"
ESCAPES = {ord(k): v for k, v in {"n": b"\n", "r": b"\r", "t": b"\t", "b": b"\b", "f": b"\f"}.items()}


def inflate(data: bytes) -> bytes:
    """What can be inflated; the input itself if nothing can."""
    stream = zlib.decompressobj()
    try:
        return stream.decompress(data) + stream.flush()
    except zlib.error:
        pass
    # damaged: what comes before the damage, in pieces that are halved where they fail
    stream, out, at, size = zlib.decompressobj(), [], 0, len(data)
    while at < len(data) and size:
        before = stream.copy()
        try:
            out.append(stream.decompress(data[at : at + size]))
            at += size
        except zlib.error:
            stream, size = before, size // 2
    return b"".join(out) or data


def ascii85(data: bytes) -> bytes:
    """Groups of five; white space and strange bytes are skipped; `~` or the end ends it."""
    out, group = bytearray(), []
    for c in data:
        if c == 0x7E:
            break
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 33)
            if len(group) == 5:
                out += _group(group)
                group = []
    if len(group) > 1:
        out += _group(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _group(digits: list[int]) -> bytes:
    n = 0
    for d in digits:
        n = n * 85 + d
    return (n & 0xFFFFFFFF).to_bytes(4, "big")


def unfiltered(data: bytes, dictionary: bytes) -> bytes:
    a85, flate = b"ASCII85Decode" in dictionary or b"/A85" in dictionary, b"FlateDecode" in dictionary or re.search(rb"/Fl\b", dictionary) is not None
    if a85:
        data = ascii85(data)
    return inflate(data) if flate else data


def streams(pdf: bytes) -> list[bytes]:
    """Decoded streams in file order."""
    out, at = [], 0
    while m := START.search(pdf, at):
        end = pdf.find(b"endstream", m.end())
        if end < 0:
            break
        body = pdf[m.end() : end]
        body = body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body
        before = pdf[max(0, m.start() - DICT_BYTES) : m.start()]
        opened = before.rfind(b"obj")
        dictionary = before[opened:] if opened >= 0 else before[max(0, before.rfind(b"<<")) :]
        out.append(unfiltered(body, dictionary))
        at = end + 9
    return out


def decoded(raw: bytes) -> str:
    """UTF-16 behind its mark, else UTF-8, else Latin-1."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _literal(s: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(s):
        c = s[at]
        at += 1
        if c == 0x5C and at < len(s):
            c = s[at]
            at += 1
            if c in ESCAPES:
                out += ESCAPES[c]
            elif 0x30 <= c <= 0x37:
                n, digits = c - 48, 1
                while digits < 3 and at < len(s) and 0x30 <= s[at] <= 0x37:
                    n, at, digits = n * 8 + s[at] - 48, at + 1, digits + 1
                out.append(n & 255)
            elif c == 0x0D:
                at += s[at : at + 1] == b"\n"
            elif c != 0x0A:
                out.append(c)
        elif c == 0x28:
            depth += 1
            out.append(c)
        elif c == 0x29:
            depth -= 1
            if not depth:
                break
            out.append(c)
        else:
            out.append(c)
    return bytes(out), at


def tokens(s: bytes):
    """('text', bytes), ('op', name) or ('open' / 'close', None); the rest is skipped."""
    at, n = 0, len(s)
    while at < n:
        c = s[at]
        if c in SPACE:
            at += 1
        elif c == 0x28:
            text, at = _literal(s, at + 1)
            yield "text", text
        elif c == 0x3C and s[at + 1 : at + 2] != b"<":
            end = s.find(b">", at)
            end = n if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", s[at + 1 : end])
            yield "text", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            at = end + 1
        elif c == 0x5B:
            at += 1
            yield "open", None
        elif c == 0x5D:
            at += 1
            yield "close", None
        elif c == 0x25:
            while at < n and s[at] not in b"\r\n":
                at += 1
        elif c in DELIMITERS:
            at += 1
            while c == 0x2F and at < n and s[at] not in SPACE and s[at] not in DELIMITERS:
                at += 1
        else:
            start = at
            while at < n and s[at] not in SPACE and s[at] not in DELIMITERS:
                at += 1
            yield "op", s[start:at]


def shown(content: bytes) -> str:
    """The text that a content stream shows between BT and ET. Strings are set apart by blanks
    unless a blank, a line end or a hyphen is there; moves end the line."""
    out: list[str] = []
    inside, pending = False, []

    def show() -> None:
        for raw in pending:
            text = decoded(raw)
            if out and out[-1] and out[-1][-1] not in " \n-" and text:
                out.append(" ")
            out.append(text)
        pending.clear()

    for kind, value in tokens(content):
        if kind == "text":
            if inside:
                pending.append(value)
        elif kind == "op":
            if value == b"BT":
                inside = True
            elif value == b"ET":
                inside = False
                out.append("\n")
            elif inside and value in (b"Tj", b"TJ"):
                show()
            elif inside and value in (b"'", b'"'):
                out.append("\n")
                show()
            elif inside and value in (b"Td", b"TD", b"T*", b"Tm"):
                out.append("\n")
            if not re.match(rb"[-+.0-9]", value):
                pending.clear()
    return "".join(out)


def text_of(pdf: bytes | None) -> str:
    """All streams' text; empty for bytes that are no PDF."""
    if not pdf or not pdf.startswith(b"%PDF-"):
        return ""
    parts = [p for s in streams(pdf) if b"BT" in s and (p := shown(s).strip())]
    return re.sub(r"[ \t]*\n\s*", "\n", "\n".join(parts))


def pdf_text(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(files: pd.Series) -> pd.Series:
        return files.map(text_of)

    return run(content)
