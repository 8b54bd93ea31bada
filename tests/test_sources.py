import sys
import zlib
from base64 import a85encode

from pyspark.sql import functions as F

from corvane.sources import files, ocr, pdf
from corvane.sources.ocr import ProcessOcr


def make_pdf(content: bytes, filters: str = "/FlateDecode") -> bytes:
    body = content
    if "Flate" in filters:
        body = zlib.compress(body)
    if "ASCII85" in filters:
        body = a85encode(body) + b"~>"
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(body)).encode() + b" /Filter [" + filters.encode() + b"] >>\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"


SHOW = b"BT (Hello PDF World) Tj 0 -20 Td (RAG Search Engine) Tj ET"


def test_pdf_filters():
    for filters in ("/FlateDecode", "/ASCII85Decode /FlateDecode", "/ASCII85Decode", ""):
        assert pdf.text_of(make_pdf(SHOW, filters)) == "Hello PDF World\nRAG Search Engine", filters


def test_pdf_operators():
    cases = {
        b"BT [(a) -20 (b)] TJ (c-) Tj (d) Tj ET": "a b c-d",
        rb"BT (x\(y\)\101\n\\z) Tj ET": "x(y)A\n\\z",
        b"BT <48656C6C6F> Tj T* <4> Tj ET": "Hello\n@",
        b"BT (one) Tj (two) ' ET (out) Tj BT (has ET in it) Tj ET": "one\ntwo\nhas ET in it",
        b"BT <FEFF4E2D6587D83DDE00> Tj ET": "中文😀",
    }
    for content, want in cases.items():
        assert pdf.text_of(make_pdf(content)) == want


def test_no_pdf():
    assert pdf.text_of(b"not a pdf") == "" and pdf.text_of(None) == "" and pdf.text_of(b"%PDF-1.4") == ""
    assert pdf.inflate(b"plain") == b"plain"


def test_ascii85_tail():
    for n in range(9):
        raw = bytes(range(1, n + 1))
        assert pdf.ascii85(a85encode(raw) + b"~>") == raw and pdf.ascii85(a85encode(raw)) == raw


class Ocr:
    def read(self, raw):
        return ("Success", "scanned text", "") if b"scan" in raw else ("EmptyText", "", "nothing")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Some text. " * 100, encoding="utf-8")
    (tmp_path / "b.PDF").write_bytes(make_pdf(SHOW))
    (tmp_path / "c.json").write_text('{"raw": 1}', encoding="utf-8")
    (tmp_path / "d.md").write_text(" \n\t", encoding="utf-8")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 scan")
    (tmp_path / "f.pdf").write_bytes(b"junk")
    (tmp_path / "g.txt").write_bytes(b"bad \xff bytes")
    found = files.read_files(spark, str(tmp_path))
    parsed = {r.doc_id: r for r in files.parse(found, Ocr()).collect()}
    assert {k: (r.status, r.source) for k, r in parsed.items()} == {
        "a.txt": ("Success", "TextFile"), "b.PDF": ("Success", "NativePdf"), "c.json": ("Success", "TextFile"), "d.md": ("NoTextExtracted", "None"),
        "e.pdf": ("Success", "Ocr"), "f.pdf": ("OcrFailed", "None"), "g.txt": ("Success", "TextFile"),
    }
    assert parsed["c.json"].text == '{"raw": 1}' and parsed["g.txt"].text == "bad � bytes"
    log = files.import_log(files.parse(found, Ocr()))
    assert files.import_tally(log).first() == (5, 7, 1, 2)
    gone = files.missing_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "no.pdf")], log).collect()
    assert [(r.doc_id, r.imported) for r in gone] == [("no.pdf", False)] and gone[0].diagnostic


def test_ocr_cascade():
    def broken(raw):
        raise RuntimeError("no engine")

    assert files.Cascade(broken, lambda raw: ["one", None, "two"]).read(b"") == ("Success", "one\n\ntwo", "")
    assert files.Cascade(broken).read(b"")[0] == "NoText"
    assert files.NoOcr().read(b"")[0] == "ScriptNotFound"


def test_text_status(spark):
    df = spark.createDataFrame([(1, "x"), (2, " \n"), (3, None)], "id long, t string")
    assert [r.status for r in files.text_status(df, "id", "t").orderBy("id").collect()] == ["Success", "NoTextExtracted", "NoTextExtracted"]
    assert df.select(F.col("t").rlike(files.BLANK)).count() == 3


def test_damaged_streams():
    raw = bytes(i * i % 251 for i in range(50_000))
    packed = zlib.compress(raw)
    assert pdf.inflate(packed[: len(packed) // 2]) == zlib.decompressobj().decompress(packed[: len(packed) // 2])
    for at in (200, len(packed) // 2, len(packed) - 8):
        bad = bytearray(packed)
        bad[at : at + 6] = b"\xff" * 6
        want, stream = b"", zlib.decompressobj()
        for i in range(len(bad)):
            try:
                want += stream.decompress(bytes(bad[i : i + 1]))
            except zlib.error:
                break
        assert pdf.inflate(bytes(bad)) == (want or bytes(bad))


def script(folder, body):
    path = folder / "ocr.py"
    path.write_text("import sys, time\nraw = sys.stdin.buffer.read()\n" + body)
    return str(path)


def test_ocr_process(tmp_path):
    of = lambda body, **o: ProcessOcr([sys.executable], script(tmp_path, body), probe="pass", **o).read(b"%PDF-1.4")
    assert of("print('read', len(raw))") == ("Success", "read 8\n", "")
    assert of("print(' ')")[0] == "NoText"
    status, _, note = of("sys.exit('x' * 500)")
    assert status == "ProcessFailed" and note.endswith("x...") and len(note) < 330
    assert of("sys.exit(3)") == ("ProcessFailed", "", "OCR failed")
    assert of("time.sleep(30)", timeout=0.5)[0] == "TimedOut"
    assert ProcessOcr([sys.executable], str(tmp_path / "none.py"), probe="pass").read(b"x")[0] == "ScriptNotFound"
    assert ProcessOcr([sys.executable], probe="import no_such_module").read(b"x")[0] == "PythonNotFound"
    assert ProcessOcr(["/no/python"], probe="pass").read(b"x")[0] == "PythonNotFound"
    assert ProcessOcr([sys.executable], probe="import time; time.sleep(30)", probe_timeout=0.3).read(b"x")[0] == "PythonNotFound"
    gone = ProcessOcr([sys.executable], script(tmp_path, ""), probe="pass")
    gone.found = "/no/python"
    assert gone.read(b"x")[0] == "PythonStartFailed" and gone.read(b"")[0] == "PdfNotFound"


def test_ocr_engines_that_are_missing():
    """The module as a program: engines that are not installed are passed over, and said to be."""
    status, text, note = ProcessOcr([sys.executable], probe="pass").read(b"no pdf")
    assert (status, text) == ("ProcessFailed", "") and "text_layer" in note
    assert ocr.cascade(b"", [lambda raw: ["a ", None, " b"]]) == ("a\n\nb", [])


def test_files_with_an_ocr_process(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "scan.pdf").write_bytes(b"%PDF-1.4 a picture")
    reader = ProcessOcr([sys.executable], script(tmp_path, "print('from', len(raw), 'bytes')"), probe="pass")
    row = files.parse(files.read_files(spark, str(tmp_path / "in")), reader).first()
    assert (row.status, row.source, row.text) == ("Success", "Ocr", "from 18 bytes\n")


def test_small_tables_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    from corvane.sources import tables

    spark.range(20000).selectExpr("id", "uuid() AS text").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 4
    monkeypatch.setattr(tables, "PART_BYTES", 50_000)
    dealt = tables.table(spark, str(tmp_path), "t")
    assert dealt.rdd.getNumPartitions() > 8 and dealt.count() == 20000
