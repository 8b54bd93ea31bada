import base64
import gzip
import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import warc

PAGES = [
    (1, "http://a.org/", "<p>one</p>"), (2, "http://a.org/2", "<p>two</p>"), (3, "http://b.org/", "<p>one</p>"), (4, None, None), (5, "http://c.org/a b\r\nX: y", ""), (6, "http://d.org", "é中" * 40_000),
    (7, "http://d.org", "<p>one</p>"), (8, "http://e.org", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (None, "http://n.org", "nobody"), (None, "http://n.org", "nobody"),
]


def table(spark, pages=PAGES):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def brute(pages, least=0):
    best = {}
    for i, _, h in pages:
        h = h or ""
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    out = []
    for i, _, h in pages:
        raw, first = (h or "").encode(), best[h or ""]
        again = len(raw) >= least and first != -1 and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_round_trip(spark, least):
    df = table(spark).selectExpr("*", "1 record_type", "'x' as payload", "2 as digest")
    got = sorted(map(tuple, warc.round_trip(df, least_bytes=least).collect()), key=repr)
    assert got == brute(PAGES, least)


def test_empty(spark):
    assert warc.round_trip(table(spark).limit(0)).collect() == []


def test_payloads_and_pushdown(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    files = warc.write(table(spark).repartition(3), path, file_bytes=200)
    assert files.agg(F.sum("records")).first()[0] == len(PAGES)
    found = warc.read(spark, path=path)
    assert found.rdd.getNumPartitions() == files.count()
    full = {r.record_id: bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
    assert full["urn:page:6"].decode() == "é中" * 40_000 and full["urn:page:8"].startswith(b"WARC/1.1")
    plan = found.where("record_type = 'revisit' and payload_bytes > 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "revisit" not in plan.split("Filter")[-1].split("\n")[0]
    assert {r.refers_to for r in found.where("record_type in ('revisit', 'x')").collect()} == {"urn:page:7", "urn:page:5"}
    bare = warc.read(spark, path=path, payload="none").where("target_uri = 'http://d.org'").collect()
    assert len(bare) == 2 and all(r.payload is None and r.payload_bytes is None for r in bare)
    one = warc.read(spark, files=files.first().file)
    assert one.count() == files.first().records


def test_any_archive_reads(spark, tmp_path):
    """Plain files, gzip members that do not tell their length, other record types."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: text/plain\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"
    page = warc.record("response", "urn:page:1", "http://x.org", b"<p>" + b"x" * 100_000, "2024-01-01T00:00:00Z", "A" * 32)
    (tmp_path / "a.warc").write_bytes(info + page + info)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page) + warc.member(info) + gzip.compress(page))
    (tmp_path / "note.txt").write_text("no archive")
    rows = warc.read(spark, path=f"file://{tmp_path}").collect()
    assert sorted(r.record_type for r in rows) == ["response"] * 3 + ["warcinfo"] * 4
    assert all(bytes(r.payload) == b"<p>" + b"x" * 100_000 for r in rows if r.record_type == "response")
    assert all(bytes(r.payload) == b"software:" for r in rows if r.record_type == "warcinfo")


def test_refused_payloads_are_not_read():
    class Counted(io.BytesIO):
        fetched = 0

        def read(self, n=-1):
            out = super().read(n)
            self.fetched += len(out)
            return out

        def size(self):
            return len(self.getvalue())

    import os

    big = warc.member(warc.record("response", "urn:page:1", None, os.urandom(1 << 20), "d", "A"))
    f = Counted(big + warc.member(warc.record("revisit", "urn:page:2", None, b"", "d", "A", "urn:page:1")))
    got = list(warc.records(f, lambda h: h["warc-type"] == "revisit", True))
    assert len(got) == 1 and f.fetched < 3 * warc.HEAD


def test_damage_is_noticed(spark, tmp_path):
    bad = warc.record("response", "urn:page:1", None, b"payload", "d", "B" * 32)
    (tmp_path / "a.warc").write_bytes(bad)
    with pytest.raises(Exception, match="cut off|digest"):
        data = warc.member(bad)
        (tmp_path / "c.warc.gz").write_bytes(data[:-20])
        warc.read(spark, path=f"file://{tmp_path}/c.warc.gz").collect()


def test_url_control_characters():
    assert b"http://c.org/a%20b%0D%0AX:%20y\r\n" in warc.record("response", "u", "http://c.org/a b\r\nX: y", b"", "d", "A")
    assert isinstance(pa.array([1]), pa.Array)


def test_members_of_many_records(tmp_path):
    """A file that is compressed as a whole, members of several records and plain ones, read record by record."""
    texts = ["", "short", "x" * 30_000, "é" * 9000, "last"]
    raw = [warc.record("response", f"urn:page:{i}", f"http://a.org/{i}", t.encode(), "2020-01-01T00:00:00Z", warc.base32_sha1(t.encode())) for i, t in enumerate(texts)]
    ways = {"whole": gzip.compress(b"".join(raw)), "two": gzip.compress(raw[0] + raw[1]) + warc.member(raw[2]) + gzip.compress(b"".join(raw[3:])), "plain": b"".join(raw), "wrong": warc.member(raw[0] + raw[1] + raw[2]) + warc.member(raw[3]) + raw[4]}
    for name, data in ways.items():
        (tmp_path / name).write_bytes(data)
        for payloads in (True, False):
            for wanted in ({0, 1, 2, 3, 4}, {1, 4}, {2}, set()):
                with pa.OSFile(str(tmp_path / name)) as f:
                    got = list(warc.records(f, lambda h, w=wanted: int(h["warc-record-id"].split(":")[-1][:-1]) in w, payloads))
                assert [h["warc-target-uri"] for h, _ in got] == [f"http://a.org/{i}" for i in sorted(wanted)], (name, payloads, wanted)
                assert all((b.split(b"\r\n\r\n", 1)[1].decode() == texts[i]) if payloads else b is None for (_, b), i in zip(got, sorted(wanted), strict=True))
        (tmp_path / name).write_bytes(data[:-30])
        with pa.OSFile(str(tmp_path / name)) as f, pytest.raises((ValueError, KeyError)):
            list(warc.records(f, lambda h: True, True))


def test_query_plan_takes_the_record_type(spark):
    plan = warc.round_trip(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and "= response" not in plan and "= revisit" not in plan


def test_predicates_leave_payloads_alone(tmp_path):
    """Refused records of the writer's files cost their first bytes only."""
    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def seek(self, at):
            self.f.seek(at)

        def size(self):
            return self.f.size()

        def read(self, n):
            got = self.f.read(n)
            self.n += len(got)
            return got

    big = hashlib.sha512(b"x").hexdigest().encode() * 1
    noise = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(60_000))
    data = b"".join(warc.member(warc.record("response", f"urn:page:{i}", None, noise, "d", "s")) for i in range(3)) + warc.member(warc.record("revisit", "urn:page:9", None, big, "d", "s", "urn:page:1"))
    (tmp_path / "w").write_bytes(data)
    with pa.OSFile(str(tmp_path / "w")) as f:
        counted = Counting(f)
        assert len(list(warc.records(counted, lambda h: h["warc-type"] == "revisit", True))) == 1
    assert counted.n < 5 * warc.HEAD < len(data) / 10


def test_payloads_are_not_shuffled_nor_handed_on(spark, tmp_path, monkeypatch):
    path, plans = f"file://{tmp_path}/w", []
    monkeypatch.setattr(warc, "materialize", lambda df, label, real=warc.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    warc.write(table(spark), path)
    assert "MapInArrow" in plans[-1] and "BroadcastHashJoin" in plans[-1] and "hashpartitioning" not in plans[-1]
    full = {r.record_id: r for r in warc.read(spark, path=path).where("record_type = 'response'").collect()}
    told = {r.record_id: r for r in warc.read(spark, path=path, payload="digest").where("record_type = 'response'").collect()}
    known = [i for i in full if i.startswith("urn:page:")]
    assert known and all(told[i].payload is None and told[i].payload_sha1 == full[i].payload_sha1 and told[i].payload_bytes == len(full[i].payload) for i in known)
