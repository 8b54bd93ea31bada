"""Keeps an index of chunks and postings up to date with a growing folder of documents.

    python -m jobs.index_feed --documents DIR --out DIR --checkpoint DIR [--config jobs/index_feed.json]

The folder's Parquet files (doc_id, text, lang) are read as a file stream up to what is there now; the stream's
checkpoint says which have been read. Each micro-batch is cut into chunks and counted, and written below `out`:

    chunks     batch, lang / doc_id, chunk_index, content, byte_offset
    terms      batch / doc_id, chunk_index, dl, terms: the counted terms of each chunk
    postings   batch, bucket / term, doc_id, chunk_index, tf, dl      (bucket: of the term; each file sorted by term)
    documents  batch / doc_id, n_chunks: what the batch holds; a document's last batch counts
    log        batch / documents, left_out, chunks, postings, as JSON

The folders of a batch that runs again after a failure are overwritten by the same rows, and a run that finds no new
files writes nothing. Rows without doc_id or text are left out; of rows of one batch that repeat an id the least
text counts. `chunks`, `postings` give the rows of what is there now. Documents without text have no chunks, but
take the place of earlier ones.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.chunking import chunks_arrow
from corvane.operators.index import KEY, counted_words, packed_words, unpacked
from corvane.sources.shared import materialize

log = logging.getLogger("jobs.index_feed")
CONFIG = Path(__file__).with_suffix(".json")
#: Chunks to a block of `packed`; the job keeps no blocks.
PACK_CHUNKS = 64
#: Chunks whose postings are a task's, about; postings of a term in a pack from which on packs are dealt apart.
SLICE_CHUNKS, LONG = 50_000, 512


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def _write(df: DataFrame, out: str, name: str, batch: int, *by: str, kind: str = "parquet") -> DataFrame:
    """Overwrites the batch's folder only; what lies there then."""
    path = f"{out}/{name}/batch={batch}"
    df.write.partitionBy(*by).option("partitionOverwriteMode", "static").mode("overwrite").format(kind).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


def _write_postings(packs: DataFrame, n_chunks: int, out: str, batch: int, buckets: int) -> DataFrame:
    """A task has a slice of a bucket, so that nothing is looked at twice to range it; a term has one slice, but where packs have very
    many of its postings each has its own."""
    slices = max(1, -(-n_chunks // (SLICE_CHUNKS * buckets)))
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")
    nth = F.pmod(F.xxhash64("term", F.when(F.size("tf") >= LONG, F.col("pack"))), F.lit(slices)).cast("int")
    packs = packs.select("term", "pack", *KEY, "tf", "dl", bucket.alias("bucket"))
    dealt = packs.repartitionById(buckets * slices, F.col("bucket") * slices + nth).sortWithinPartitions("bucket", "term", "pack")
    # they come by bucket already, which Spark cannot know, and need no sort for the folders
    conf, name = packs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, buckets)
    try:
        return _write(unpacked(dealt, "bucket"), out, "postings", batch, "bucket")
    finally:
        conf.set(name, before)


def add(docs: DataFrame, batch: int, out: str, config: dict) -> None:
    """One micro-batch: doc_id, text, lang."""
    if docs.isEmpty():
        return
    usable = docs.where("doc_id is not null and text is not null")
    one = usable.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d"))
    # the language goes along in the key, so that the texts are not joined again
    cut = chunks_arrow(one.select(F.struct("doc_id", "d.lang").alias("key"), "d.text"), config["max_bytes"], config["overlap"], "key")
    whole = _write(cut.select("doc_id.doc_id", "chunk_index", "content", "byte_offset", "doc_id.lang"), out, "chunks", batch, "lang")
    _write(counted_words(whole), out, "terms", batch)
    # of the chunks once more: their counted words move less than the terms' table costs to read
    stored = _write_postings(packed_words(whole, PACK_CHUNKS), whole.count(), out, batch, config["buckets"])
    own = usable.select("doc_id").distinct().join(whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks")), "doc_id", "left").na.fill({"n_chunks": 0})
    held = _write(own, out, "documents", batch)
    read = docs.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.expr("doc_id is null or text is null")).alias("left_out"))
    wrote = held.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).crossJoin(stored.agg(F.count(F.lit(1)).alias("postings")))
    told = _write(read.crossJoin(wrote).coalesce(1), out, "log", batch, kind="json").first()
    log.info("batch %d: %s", batch, told.asDict())


def _pattern(path: str) -> str:
    """The path as a pattern that matches it alone: a stream's source takes a folder, or what a pattern matches, which may be
    one file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> int:
    """Takes what is new, waits for the stream's end; the number of batches that this run added."""
    config = config or settings()
    before = batches(spark, out)
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files_per_trigger"]).parquet(_pattern(documents))
    query = stream.writeStream.foreachBatch(lambda df, batch: add(df, batch, out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = batches(spark, out) - before
    log.info("read %s; %d new batches in %s", documents, len(done), out)
    return len(done)


def _table(spark: SparkSession, out: str, name: str, kind: str = "parquet") -> DataFrame | None:
    try:
        return spark.read.format(kind).load(f"{out}/{name}")
    except AnalysisException:  # nothing has been written yet
        return None


def batches(spark: SparkSession, out: str) -> set[int]:
    found = _table(spark, out, "log", "json")
    return set() if found is None else {r.batch for r in found.select("batch").distinct().collect()}


def _now(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows of batches whose documents are there, and that no later batch has replaced. What has been replaced is a table, whose size is
    known: little or nothing as a rule, and then the rows stay where they are."""
    held = _table(spark, out, "documents")
    whole = [r.batch for r in held.select("batch").distinct().collect()]
    rows = _table(spark, out, name).where(F.col("batch").isin(whole))
    if len(whole) < 2:  # a batch has each document once
        return rows
    seen = held.groupBy("doc_id").agg(F.sort_array(F.collect_set("batch"), asc=False).alias("of")).where(F.size("of") > 1)
    gone = materialize(seen.select("doc_id", F.explode(F.slice("of", 2, F.size("of") - 1)).alias("batch")), "feed-replaced")
    return rows if gone.isEmpty() else rows.join(gone, ["doc_id", "batch"], "left_anti")


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, chunk_index, content, byte_offset, lang of each document's last batch."""
    return _now(spark, out, "chunks").select(*KEY, "content", "byte_offset", "lang")


def postings(spark: SparkSession, out: str) -> DataFrame:
    """term, doc_id, chunk_index, tf, dl of each document's last batch."""
    return _now(spark, out, "postings").select("term", *KEY, "tf", "dl")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("index_feed").getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, settings(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
