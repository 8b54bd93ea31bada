"""WARC archives: a writer, and a Python data source that reads them.

The source plans a partition per file, takes equality and IN predicates on the record type and
other header columns, and parses each record's headers first. The payload of a record that the
predicates refuse is not decoded: if its gzip member says how long it is (the `sl` extra field,
which the writer sets) and holds no other record, the reader seeks past it, else it only inflates to
find the end. A member may hold any number of records, as in a file that is compressed as a whole.

Writer: a gzip member per record. Records of equal payload become one response, that of the
largest page_id, and revisits of it without payload (profile identical-payload-digest), if the
payload has at least `least_bytes`. Tasks write files under names of their own and report them;
only files of tasks that succeeded are named in the result, so a lost executor leaves no doubt.

Defined results: a null html is an empty payload; a null url writes no WARC-Target-URI. A null
page_id is never the largest unless all are null. Rows that repeat the largest page_id are
responses all. Control characters in urls are percent-encoded. Extra columns are ignored, and an empty table has an empty
result and no archive. The archives stay in the shared folder until `clear_shared`.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from corvane.llm.common import arrow_batch, fresh_path, materialize, pick, position, slices, written

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary, payload_sha1 string, file string"
)
#: Header columns that predicates are taken for, and their header names.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, HEAD = 256 << 20, 8192


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Spark's names of local and S3 folders in pyarrow's spelling."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", uri)))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its length and that of what it inflates to."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(record)) >= 1 << 32:
        raise ValueError("a record of 4 GB or more does not fit a gzip member's length fields")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record))


def record(kind: str, record_id: str, url: str | None, payload: bytes, date: str, digest: str, refers_to: str | None = None) -> bytes:
    """A response or revisit; a revisit keeps the HTTP header, so the payload's length stays known."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_urn(page_id) -> str:
    return f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives under path; file, records, bytes of each."""
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table, whose size is known: a small one is broadcast, and pages are neither shuffled nor sorted for it
    marked = rows.join(materialize(same.select("digest", "first", "n"), "warc-same"), "digest", "left")
    marked = marked.select("page_id", "url", "payload", F.when(F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, done = None, "", []
        place, root = filesystem(path)
        place.create_dir(root, recursive=True)
        for batch in slices(batches, "payload"):
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or done[-1][2] >= file_bytes:
                    if out:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = place.open_output_stream(f"{root}/{name}", compression=None)
                    done.append([f"{path}/{name}", 0, 0])
                kind = "response" if first is None else "revisit"
                data = member(record(kind, page_urn(page_id), url, payload, date, base32_sha1(payload), None if first is None else page_urn(first)))
                out.write(data)
                done[-1][1] += 1
                done[-1][2] += len(data)
        if out:
            out.close()
        yield arrow_batch([[d[k] for d in done] for k in range(3)], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(marked.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


class FilePartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcSource(DataSource):
    """spark.read.format("warc"); options: path (a file or folder), files (one a line), or manifest (a Parquet
    table of `file`); payload = "full" (default), "digest", which decodes payloads but hands on their lengths and digests alone, or
    "none", which never decodes them."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.wanted.append((HEADERS[f.attribute[0]], set(f.value) if isinstance(f, In) else {f.value}))
            else:
                yield f

    def partitions(self) -> Sequence[FilePartition]:
        if "files" in self.options:
            return [FilePartition([f]) for f in self.options["files"].split("\n") if f] or [FilePartition([])]
        if "manifest" in self.options:
            # a task gets its own file's name; the list stays with the plan
            place, root = filesystem(self.options["manifest"])
            parts = [i.path for i in place.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(".parquet")]
            names = sorted(n for p in parts for n in pq.read_table(p, columns=["file"], filesystem=place).column(0).to_pylist())
            return [FilePartition([n]) for n in names] or [FilePartition([])]
        place, root = filesystem(self.options["path"])
        info = place.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.is_file else place.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(i.path for i in found if i.is_file and re.search(r"\.warc(\.gz)?$", i.path))
        base = self.options["path"].rstrip("/")
        return [FilePartition([base + n[len(root.rstrip("/")) :]]) for n in names] or [FilePartition([])]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        for uri in partition.files:
            place, name = filesystem(uri)
            with place.open_input_file(name) as f:
                for head, payload in records(f, self.takes, self.options.get("payload", "full") != "none"):
                    row = self.row(uri, head, payload)
                    yield (*row[:7], None, *row[8:]) if self.options.get("payload") == "digest" else row

    def takes(self, head: dict[str, str]) -> bool:
        return all(clean(head.get(h)) in values for h, values in self.wanted)

    @staticmethod
    def row(uri: str, head: dict[str, str], block: bytes | None) -> tuple:
        length, payload = None, None
        if block is not None:
            http = head.get("content-type", "").startswith("application/http")
            cut = block.find(b"\r\n\r\n") if http else -4
            inner = fields(block[: max(cut, 0)].decode("utf-8", "replace")) if http else {}
            payload = None if head.get("warc-type") == "revisit" else block[cut + 4 :]
            length = len(payload) if payload is not None else int(inner["content-length"]) if "content-length" in inner else None
        values = [clean(head.get(h)) for h in HEADERS.values()]
        return (*values, length, payload, base32_sha1(payload) if payload is not None else None, uri)


def clean(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def fields(head: str) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank continues the last."""
    out: dict[str, str] = {}
    last = ""
    for line in head.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class Plain:
    """The bytes of a file from a place on; what is skipped is not read."""

    def __init__(self, f, at: int):
        self.f, self.at, self.end = f, at, f.size()

    def read(self, n: int) -> bytes:
        self.f.seek(self.at)
        got = self.f.read(min(n, self.end - self.at))
        self.at += len(got)
        return got

    def back(self, rest: bytes) -> None:
        self.at -= len(rest)

    def skip(self, n: int) -> None:
        self.at = min(self.end, self.at + n)


class Inflated:
    """The bytes that a gzip member holds; what is skipped is inflated and let go. start: what has been
    read of the file from `at` on."""

    def __init__(self, f, at: int, start: bytes):
        self.f, self.at, self.fed, self.rest = f, at + len(start), start, b""
        self.inflate = zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        out, self.rest = [self.rest[:n]], self.rest[n:]
        got = len(out[0])
        while got < n and not self.inflate.eof:
            if not self.fed:
                self.f.seek(self.at)
                self.fed = self.f.read(1 << 16 if n > HEAD else HEAD)
                if not self.fed:
                    raise ValueError("a record is cut off")
                self.at += len(self.fed)
            out.append(self.inflate.decompress(self.fed, n - got))
            self.fed = self.inflate.unconsumed_tail
            got += len(out[-1])
        return b"".join(out)

    def back(self, rest: bytes) -> None:
        self.rest = rest + self.rest

    def skip(self, n: int) -> None:
        while n > 0 and (got := len(self.read(min(n, 1 << 20)))):
            n -= got

    @property
    def end(self) -> int:
        """Where the next member begins; what is left of this one is checked."""
        self.skip(1 << 62)
        return self.at - len(self.inflate.unused_data)


def next_head(source: Plain | Inflated) -> tuple[dict[str, str], int] | None:
    """Headers and how many bytes they take; None behind the last record."""
    text, cut = b"", -1
    while cut < 0:
        more = source.read(HEAD)
        text = (text + more).lstrip(b"\r\n")
        if not more:
            if text:
                raise ValueError("a record's headers are cut off")
            return None
        cut = text.find(b"\r\n\r\n")
    source.back(text[cut + 4 :])
    return fields(text[:cut].decode("utf-8", "replace")), cut + 4


def records(f, takes, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the records that `takes` takes; block is None without payloads."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        start = f.read(min(HEAD, size - at))
        packed = start[:2] == b"\x1f\x8b"
        source = Inflated(f, at, start) if packed else Plain(f, at)
        compressed, inflated = member_length(start) if packed else (None, None)
        done, jump = 0, False
        while not jump and (found := next_head(source)):
            head, n = found
            length = int(head["content-length"])
            done += n + length + 4
            taken = takes(head)
            if taken and payloads:
                block = source.read(length)
                if len(block) < length:
                    raise ValueError(f"a record is cut off in the member at byte {at}")
                yield head, block
            else:
                if taken:
                    yield head, None
                jump = done == inflated  # nothing else is in this member
                if not jump:
                    source.skip(length)
        at = at + compressed if jump else source.end


def member_length(start: bytes) -> tuple[int | None, int | None]:
    """What the extra field `sl` says, if it is there: bytes of the member and of what it holds."""
    if not start[3] & 4:
        return None, None
    at, end = 12, 12 + struct.unpack_from("<H", start, 10)[0]
    while at + 4 <= min(end, len(start)):
        name, n = start[at : at + 2], struct.unpack_from("<H", start, at + 2)[0]
        if name == b"sl" and n >= 8:
            return struct.unpack_from("<II", start, at + 4)
        at += 4 + n
    return None, None


def read(spark: SparkSession, **options: str) -> DataFrame:
    """Archives as rows; predicates on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load()


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Responses and revisits are read apart, each by a predicate that the reader takes, so the scan
    of revisits seeks past all payloads. Payloads are digested anew as they are read; a digest that
    differs from the record's header fails the query."""
    spark = pages.sparkSession
    _, manifest = written(write(pages, path or fresh_path(spark, "warc"), least_bytes).select("file"), "warc-manifest")
    # a reader for each, as a source keeps what was pushed to it first
    part = lambda kind: read(spark, manifest=manifest, payload="digest").where(F.col("record_type") == kind)
    found = part("response").unionByName(part("revisit"))
    kind = pages.schema[position(pages, "page_id")].dataType.simpleString()
    number = lambda c: F.when(F.col(c).startswith("urn:page:"), F.substring(F.col(c), 10, 1 << 20)).cast(kind)
    digest = F.substring(F.col("payload_digest"), 6, 32)
    sound = F.when(F.col("payload_sha1").isNotNull() & (F.col("payload_sha1") != digest), F.raise_error(F.concat(F.lit("payload digest differs: "), "record_id"))).otherwise(digest)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", sound.cast("string").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
