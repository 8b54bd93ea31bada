"""Prompts, request bodies, and the event streams that answer them."""

from __future__ import annotations

import http.client
import json
import urllib.request
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import contains_any

# Words that tell a legal text; the headings of a prompt's parts and of the answer's sections.
LEGAL_WORDS = "人民法院 检察院 原告 被告 判决 裁定 案号 （20 (20 合同法 刑法 民法 诉讼法 违约责任 侵权 上诉 起诉 答辩 审判长 审判员 合议庭".split()
METADATA_HEADING, TEXT_HEADING, QUESTION_HEADING, QUESTION_LABEL = "【文档元数据】\n", "【法律文档内容】\n", "【用户问题】\n", "用户问题："
TEMPERATURE, ANSWER_TOKENS = 0.3, 2048
LEGAL_SECTIONS = ("案件概述", "法律分析", "结论", "参考来源")

LEGAL_SYSTEM = "你负责解读裁判文书与法规。只依据所给材料作答：写明案号与出处，分点说明，先述案情后作分析；材料不足时直说。意见仅供参考。"
GENERAL_SYSTEM = "你负责根据所给材料回答问题；材料里没有的内容请直说没有。"
NOT_READY = "错误：未设置 API 密钥"
GENERAL_RULES = ("简明准确，分点作答", "写明依据的来源编号", "材料中没有的内容请直说")


def is_legal(context: Column) -> Column:
    return contains_any(context, LEGAL_WORDS)


def system_prompt(context: Column) -> Column:
    return F.when(is_legal(context), LEGAL_SYSTEM).otherwise(GENERAL_SYSTEM)


def legal_prompt(query: Column, context: Column, metadata: Column) -> Column:
    head = F.when(F.coalesce(metadata, F.lit("")) != "", F.concat(F.lit(METADATA_HEADING), metadata, F.lit("\n\n"))).otherwise("")
    sections = "\n".join(f"## {n}、{s}" for n, s in zip("一二三四", LEGAL_SECTIONS, strict=True))
    return F.concat(head, F.lit(TEXT_HEADING), context, F.lit("\n\n" + QUESTION_HEADING), query, F.lit("\n\n请依次写出以下各节：\n" + sections))


def general_prompt(query: Column, context: Column) -> Column:
    rules = "\n".join(f"{i}. {r}" for i, r in enumerate(GENERAL_RULES, 1))
    return F.concat(context, F.lit("\n\n" + QUESTION_LABEL), query, F.lit("\n\n请依据以上内容回答：\n" + rules))


def prompt(query: Column, context: Column, metadata: Column | None = None) -> Column:
    """By the context's words, not the question's."""
    return F.when(is_legal(context), legal_prompt(query, context, F.lit("") if metadata is None else metadata)).otherwise(general_prompt(query, context))


def request_body(system: Column, user: Column, model: str = "chat") -> Column:
    """A chat request as JSON: streamed, temperature 0.3, 2048 tokens at most."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(
        F.lit(model).alias("model"), F.array(message("system", system), message("user", user)).alias("messages"),
        F.lit(True).alias("stream"), F.lit(TEMPERATURE).alias("temperature"), F.lit(ANSWER_TOKENS).alias("max_tokens"),
    ))


def delta(json: Column) -> Column:
    """The text of one event; empty for anything else."""
    return F.coalesce(F.get_json_object(json, "$.choices[0].delta.content"), F.lit(""))


def line_delta(line: Column) -> Column:
    """The text of a line of an event stream: comments, other fields, [DONE] and broken JSON have none."""
    trimmed = F.regexp_replace(line, r"\r\z", "")
    return F.when(trimmed.startswith("data: ") & (F.trim(F.substring(trimmed, 7, 1 << 30)) != "[DONE]"), delta(F.substring(trimmed, 7, 1 << 30))).otherwise("")


def sse_text(events: DataFrame, by: str | None = None) -> DataFrame:
    """events: seq, line (and by). The texts of a stream's lines, joined by seq."""
    parts = events.select(*([by] if by else []), "seq", line_delta(F.col("line")).alias("d")).where("d <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "d"))), lambda x: x["d"]), "").alias("text")
    return parts.groupBy(by).agg(text) if by else parts.agg(text)


class LineBuffer:
    """Lines of a stream that comes in pieces; a part of a line waits for its rest."""

    def __init__(self):
        self.rest = b""

    def feed(self, piece: bytes) -> list[str]:
        *lines, self.rest = (self.rest + piece).split(b"\n")
        return [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines]

    def end(self) -> list[str]:
        last, self.rest = self.rest, b""
        return [last.rstrip(b"\r").decode("utf-8", "replace")] if last else []


def parse_delta(json_text: str) -> str:
    try:
        found = json.loads(json_text)["choices"][0]["delta"]["content"]
    except (ValueError, KeyError, IndexError, TypeError):
        return ""
    return found if isinstance(found, str) else ""


class ChatProvider(Protocol):
    ready: bool

    def stream(self, system: str, user: str) -> Iterable[bytes]: ...


class EchoProvider:
    """A provider without a network: streams the last line of the prompt back."""

    ready = True

    def stream(self, system: str, user: str) -> Iterable[bytes]:
        for c in user.rsplit("\n", 1)[-1]:
            yield b"data: " + json.dumps({"choices": [{"delta": {"content": c}}]}).encode() + b"\n"
        yield b"data: [DONE]\n"


class HttpChat:
    """A service that streams its answer: a POST of the request body with the key as bearer."""

    def __init__(self, url: str, key: str | None, model: str = "chat", timeout: float = 300):
        self.url, self.key, self.model, self.timeout = url, key or "", model, timeout

    @property
    def ready(self) -> bool:
        return bool(self.key)

    def stream(self, system: str, user: str) -> Iterable[bytes]:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "messages": messages, "stream": True, "temperature": TEMPERATURE, "max_tokens": ANSWER_TOKENS}
        headers = {"Content-Type": "application/json", "Accept": "text/event-stream", "Authorization": f"Bearer {self.key}"}
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
                while piece := answer.read1(8192):
                    yield piece
        except http.client.HTTPException as e:  # a stream that breaks off
            raise OSError(f"the answer breaks off: {e!r}") from e


def generate(provider: ChatProvider | None, system: str, user: str, on_text: Callable[[str], None] | None = None) -> str:
    """The answer, passed on bit by bit. Without a provider a notice; an error after some text
    gives the text so far, an error before any is raised."""
    if provider is None or not provider.ready:
        return NOT_READY
    buffer, out = LineBuffer(), []

    def take(lines: list[str]) -> None:
        for line in lines:
            body = line[6:].strip() if line.startswith("data: ") else ""
            text = parse_delta(body) if body and body != "[DONE]" else ""
            if text:
                out.append(text)
                if on_text:
                    on_text(text)

    try:
        for piece in provider.stream(system, user):
            take(buffer.feed(piece))
        take(buffer.end())
    except OSError:
        if not out:
            raise
    return "".join(out)
