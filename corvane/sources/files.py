"""Files as documents. A file that gives no text is a row with a status, not an error."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.chunking import chunks
from corvane.sources.ocr import NOTE, NOTES, cascade
from corvane.sources.pdf import pdf_text

EXTENSIONS = ("txt", "md", "pdf", "csv", "json", "xml")
BLANK = r"\A[ \t\n\r\f\x0b]*\z"


class OcrProvider(Protocol):
    """Text of a scanned PDF: (status, text, diagnostic); status is Success or what went wrong."""

    def read(self, pdf: bytes) -> tuple[str, str, str]: ...


class NoOcr:
    def read(self, pdf: bytes) -> tuple[str, str, str]:
        return "ScriptNotFound", "", "no OCR engine is configured"


class Cascade:
    """Engines in turn, until one gives text, within the task. Each is a function from bytes to the pages' texts;
    pages that fail are None. Pages are joined by blank lines. `ocr.ProcessOcr` runs engines apart."""

    def __init__(self, *engines):
        self.engines = engines

    def read(self, pdf: bytes) -> tuple[str, str, str]:
        text, notes = cascade(pdf, self.engines)
        return ("Success", text, "") if text else ("NoText", "", "; ".join(notes)[:NOTE] or NOTES["NoText"])


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content (binary) of files and folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")


def is_there(spark: SparkSession, path: str) -> bool:
    try:
        read_files(spark, path)
    except AnalysisException:
        return False
    return True


def parse(files: DataFrame, ocr: OcrProvider | None = None) -> DataFrame:
    """doc_id (the file's name), text, status, source, diagnostic. PDFs give their text layer or,
    if it is blank, what OCR finds; every other file is text as it stands."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content")
    ext = F.lower(F.regexp_extract("doc_id", r"\.([^.]+)\z", 1))
    is_pdf = ext == "pdf"
    plain = F.coalesce(F.try_validate_utf8("content").cast("string"), F.make_valid_utf8(F.col("content")).cast("string"))
    text = named.where(~is_pdf).select("doc_id", F.col("content").isNull().alias("failed"), plain.alias("text"))
    text = text.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("TextFile").alias("source"), "failed", F.lit("").alias("note"))
    pdf = named.where(is_pdf)
    reader = ocr or NoOcr()

    @F.pandas_udf("status string, text string, note string")
    def scanned(content: pd.Series, layer: pd.Series) -> pd.DataFrame:
        found = [("None", t, "") if t and t.strip() else reader.read(c or b"") for c, t in zip(content, layer, strict=True)]
        return pd.DataFrame(found, columns=["status", "text", "note"])

    read = pdf.withColumn("layer", pdf_text(F.col("content"))).withColumn("o", scanned("content", "layer"))
    pages = read.select("doc_id", F.col("o.text").alias("text"), F.when(F.col("o.status") == "None", "NativePdf").otherwise("Ocr").alias("source"), F.col("content").isNull().alias("failed"),
                        F.when(F.col("o.status").isin("None", "Success"), "").otherwise(F.concat(F.lit("OCR: "), "o.note")).alias("note"))
    both = text.unionByName(pages)
    blank = F.col("text").rlike(BLANK)
    status = F.when(F.col("failed"), "FileOpenFailed").when(blank & (F.col("note") != ""), "OcrFailed").when(blank, "NoTextExtracted").otherwise("Success")
    note = F.when(F.col("failed"), "the file cannot be read").when(blank & (F.col("note") == ""), "no text in the file").otherwise(F.col("note"))
    return both.select("doc_id", "text", status.alias("status"), F.when(status == "Success", F.col("source")).otherwise("None").alias("source"), note.alias("diagnostic"))


def import_log(parsed: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """doc_id, imported, chunks_added, source, diagnostic: a row per file."""
    cut = chunks(parsed.where("status = 'Success'")) if cut is None else cut
    counts = cut.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunks_added"))
    rows = parsed.join(counts, "doc_id", "left").na.fill({"chunks_added": 0})
    return rows.select("doc_id", (F.col("chunks_added") > 0).alias("imported"), "chunks_added", "source", "diagnostic")


def import_tally(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if("imported").alias("imported"), F.coalesce(F.sum("chunks_added"), F.lit(0)).alias("chunks_added"),
        F.count_if((F.col("source") == "Ocr") & F.col("imported")).alias("ocr_imported"), F.count_if(~F.col("imported")).alias("errors"),
    )


def text_status(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, status, source, n_bytes of texts that are there already, read as they stand."""
    blank = F.coalesce(F.col(text_col), F.lit("")).rlike(BLANK)
    return texts.select(
        id_col, F.when(blank, "NoTextExtracted").otherwise("Success").alias("status"), F.when(blank, "None").otherwise("TextFile").alias("source"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )


def missing_files(spark: SparkSession, wanted: Sequence[str], found: DataFrame) -> DataFrame:
    """The log's rows of paths that are not there."""
    asked = spark.createDataFrame([(w,) for w in wanted], "path string").select(F.element_at(F.split("path", "/"), -1).alias("doc_id"))
    gone = asked.join(found.select("doc_id"), "doc_id", "left_anti")
    note = "the file cannot be read"
    return gone.select("doc_id", F.lit(False).alias("imported"), F.lit(0).alias("chunks_added"), F.lit("None").alias("source"), F.lit(note).alias("diagnostic"))
