"""Event streams in pieces: cut anywhere, out of order, restarted, silent."""

import json
import random
import time

import pytest

from corvane.streaming.events import Reader, _millis, texts

LINES = [": ping", 'data: {"choices":[{"delta":{"content":"见 a"}}]}', "data: {bad", 'event: x', 'data: {"choices":[{"delta":{"content":"b\\n"}}]}\r', "", 'data: {"choices":[{"delta":{"content":"é"}}]}', "data: [DONE] ", 'data: {"choices":[{"delta":{"content":"never"}}]}']
RAW = "\n".join(LINES).encode() + b"\n"
WANT = "见 ab\né"


def test_cut_at_every_byte():
    for cut in range(len(RAW) + 1):
        reader, got = Reader(), ""
        for piece in enumerate((RAW[:cut], RAW[cut:])):
            got += "".join(t for _, t in reader.take([piece]))
            reader = Reader(*reader.state())  # as if kept and read again
        assert (got, reader.ended) == (WANT, "marker"), cut


@pytest.mark.parametrize("seed", range(5))
def test_pieces_out_of_order_and_repeated(seed):
    rng = random.Random(seed)
    at = sorted({0, len(RAW), *(rng.randrange(len(RAW)) for _ in range(20))})
    pieces = list(enumerate(RAW[a:z] for a, z in zip(at, at[1:])))
    reader, got = Reader(), []
    order = pieces + rng.sample(pieces, 5)
    rng.shuffle(order)
    for piece in order:
        got += reader.take([piece])
        reader = Reader(*reader.state())
    assert "".join(t for _, t in got) == WANT and [s for s, _ in got] == sorted(s for s, _ in got)
    assert reader.early == {} and reader.take([(reader.next, b'data: {"choices":[{"delta":{"content":"x"}}]}\n')]) == []


def test_end_without_marker():
    reader = Reader()
    assert reader.take([(0, b'data: {"choices":[{"delta":{"content":"half"}}]}')]) == [] and reader.end("timeout") == [(1, "half")]
    assert reader.ended == "timeout" and reader.end("timeout") == [] and json.loads(reader.state()[2]) == {}
    assert [_millis(x) for x in ("10 minutes", "1 second", "0.5 hours")] == [600_000, 1000, 1_800_000]


SCHEMA = "stream_id string, seq long, piece binary"


def put(spark, folder, *rows):
    spark.createDataFrame([(s, n, None if p is None else bytearray(p)) for s, n, p in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, check):
    made = texts(spark.readStream.schema(SCHEMA).parquet(folder))
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out).collect()


def test_restart_from_the_checkpoint(spark, tmp_path):
    places = [str(tmp_path / n) for n in ("in", "out", "check")]
    put(spark, places[0], ("a", 0, RAW[:70]), ("a", 2, RAW[100:]), ("b", 0, b"data: "), ("c", 0, None))
    rows = {(r.stream_id, r.ended): r.text for r in run(spark, *places)}
    assert rows == {("a", None): "见 a"}
    put(spark, places[0], ("a", 1, RAW[70:100]), ("a", 0, b"again"), ("b", 1, b'{"choices":[{"delta":{"content":"later"}}]}\n'))
    rows = run(spark, *places)
    own = lambda s: "".join(r.text for r in sorted(rows, key=lambda r: r.seq) if r.stream_id == s)
    assert own("a") == WANT and own("b") == "later" and own("c") == ""
    assert [r.ended for r in rows if r.stream_id == "a" and r.ended] == ["marker"]


def test_silent_streams_end(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    put(spark, folder, ("a", 0, b'data: {"choices":[{"delta":{"content":"tail"}}]}'))
    query = texts(spark.readStream.schema(SCHEMA).parquet(folder), wait="1 second").writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", check).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("silent").count() < 2:
            time.sleep(1)
        assert {(r.text, r.ended) for r in spark.table("silent").collect()} == {("tail", None), ("", "timeout")}
    finally:
        query.stop()
