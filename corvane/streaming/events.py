"""Event streams that come in pieces, with state: a stream's pieces are put in order, cut into lines wherever they
were cut before, and give texts as they come.

`texts` takes a stream (or a table) of pieces, keyed by stream, and keeps for each stream the number of the piece it waits
for, pieces that came too early, the bytes of a line that is not whole, and whether it has ended: by its marker
(`data: [DONE]`), or because nothing came for a while. After the end nothing counts. What a batch that is run again after
a failure takes and gives is the same, as Spark keeps the state with the stream's checkpoint.

Pieces have numbers from 0 on, without gaps; one that repeats a number counts once. Null pieces are empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.prompts import LineBuffer, parse_delta

OUT = "stream_id {}, seq long, text string, ended string"
STATE = "next long, rest binary, early string, ended string"
MARKER = "[DONE]"


class Reader:
    """The state of one stream."""

    def __init__(self, next_: int = 0, rest: bytes = b"", early: str = "{}", ended: str = ""):
        self.next, self.ended = next_, ended
        self.early = {int(k): v for k, v in json.loads(early).items()}
        self.lines = LineBuffer()
        self.lines.rest = bytes(rest)

    def state(self) -> tuple[int, bytes, str, str]:
        return self.next, self.lines.rest, json.dumps({str(k): v for k, v in sorted(self.early.items())}), self.ended

    def _texts(self, lines: Iterable[str]) -> str:
        out = []
        for line in lines:
            if self.ended or not line.startswith("data: "):
                continue
            if line[6:].strip(" ") == MARKER:
                self.ended, self.early = "marker", {}
            else:
                out.append(parse_delta(line[6:]))
        return "".join(out)

    def take(self, pieces: Iterable[tuple[int, bytes]]) -> list[tuple[int, str]]:
        """(piece, text) of the pieces whose turn it is now, those with a text."""
        for seq, piece in pieces:
            if seq >= self.next and not self.ended:
                self.early.setdefault(seq, (piece or b"").hex())
        out = []
        while self.next in self.early and not self.ended:
            text = self._texts(self.lines.feed(bytes.fromhex(self.early.pop(self.next))))
            if text:
                out.append((self.next, text))
            self.next += 1
        return out

    def end(self, why: str) -> list[tuple[int, str]]:
        """A stream without a marker ends: a line without its end is a line."""
        text = self._texts(self.lines.end())
        self.ended, self.early = self.ended or why, {}
        return [(self.next, text)] if text else []


def texts(pieces: DataFrame, wait: str | None = None) -> DataFrame:
    """pieces: stream_id, seq, piece (bytes). Returns stream_id, seq (the piece that brought it), text, and ended: null, or in a row of its own how the
    stream ended (marker, timeout). wait: how long a stream may be silent, as '10 minutes'; None: for ever."""
    kind = pieces.schema["stream_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reader = Reader(*state.get) if state.exists else Reader()
        was = reader.ended
        if state.hasTimedOut:
            out = reader.end("timeout")
        else:
            rows = [r for part in batches for r in zip(part["seq"].tolist(), part["piece"].tolist(), strict=True) if r[0] is not None and not pd.isna(r[0])]
            out = reader.take(sorted(((int(s), p) for s, p in rows), key=lambda r: r[0]))
        state.update(reader.state())
        if wait and not reader.ended:
            state.setTimeoutDuration(_millis(wait))
        cells = [(key[0], s, t, None) for s, t in out]
        if reader.ended and not was:
            cells.append((key[0], reader.next, "", reader.ended))
        if cells:
            yield pd.DataFrame(cells, columns=["stream_id", "seq", "text", "ended"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return pieces.select("stream_id", "seq", "piece").groupBy("stream_id").applyInPandasWithState(step, OUT.format(kind), STATE, "append", timeout)


def _millis(wait: str) -> int:
    n, unit = wait.split()
    return int(float(n) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])
