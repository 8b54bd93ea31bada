"""The index as tables on disk that grow by batches.

A batch is written once and never changed. Below the folder of the index lie, each with a folder per batch,

    forward   doc_id, chunk_index, dl: a row per chunk. Where a batch was made of rows of `index.counted`, their terms too, of which its
              postings are made
    postings  term, n, and the lists block, doc_id, chunk_index, tf, dl: rows of `index.sorted_runs`. A file is one or more runs, each by term,
              so that a filter by terms reaches the scan and all but the pages that may hold them are skipped. A run is made
              where its chunks are read, and is not shuffled; a small batch is one
    terms     term, df: the batch's term dictionary, each file sorted by term
    blocks    term, block, n, max_tf, min_dl, each file sorted by term: of terms with LONG postings or more in the batch, the bounds that
              `bm25.search_pruned` skips blocks by. Chunks that stand next to each other are a block. Without LONG (None) no term has
              blocks, and every list is read whole
    gone      doc_id, of: documents that the batch replaces, and the batch that had them
    totals    n, length, terms of the batch, less what it replaces. It is written last: a batch counts once its
              totals are there, so what a failed attempt has left is never read

Sums over `terms` and `totals` are the statistics of what is there now, of `terms` less what replaced documents had. That is read from
`postings` for the terms of a search; no other is counted anew. One writer at a time: `add` refuses a
batch that another one has begun. A `StoredIndex` shows the batches that were there when it was first read, and its own; a new one
shows others' too.

Rows without doc_id are left out. A document without tokens has its chunks with dl 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import STOP_WORDS
from corvane.operators.index import KEY, Index, counted_words, run_bounds, sorted_runs, sorted_word_runs
from corvane.sources.shared import STORED, materialize

#: Chunks to a block, about; postings from which on a term has blocks.
BLOCK_CHUNKS, LONG = 64, 512
#: Chunks of a batch that is one file of each table; larger ones are ranged over many.
SMALL = 20_000


@dataclass
class StoredIndex:
    spark: SparkSession
    path: str
    block_chunks: int = BLOCK_CHUNKS
    long: int | None = LONG
    _whole: list[int] | None = field(default=None, repr=False)
    _replaced: bool | None = field(default=None, repr=False)

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing has been written yet
            return None

    @property
    def totals(self) -> DataFrame | None:
        """batch, n, length, source: a row per batch that counts."""
        return self._read("totals")

    def batches(self) -> list[int]:
        """A number per batch, in order."""
        if self._whole is None:
            found = self.totals
            self._whole = [] if found is None else sorted(r.batch for r in found.select("batch").distinct().collect())
        return self._whole

    def sources(self) -> set[str]:
        """What the batches were made of, where `add` was told."""
        found = self.totals
        return set() if found is None else {r.source for r in found.select("source").distinct().collect()}

    def _rows(self, name: str) -> DataFrame | None:
        """Of the batches that count, with those of replaced documents."""
        whole = self.batches()
        found = self._read(name) if whole else None
        return None if found is None else found.where(F.col("batch").isin(whole))

    def _gone(self) -> DataFrame | None:
        """doc_id, batch of what has been replaced."""
        found = self._rows("gone")
        return None if found is None else found.select("doc_id", F.col("of").alias("batch"))

    def live(self, rows: DataFrame) -> DataFrame:
        """rows: doc_id and batch, of any table that is written by the same batches. Those that no later batch has replaced."""
        return rows.join(self._gone(), ["doc_id", "batch"], "left_anti") if self._replaces() else rows

    def _replaces(self) -> bool:
        """Whether any document has been replaced."""
        if self._replaced is None:
            gone = self._gone()
            self._replaced = gone is not None and not gone.isEmpty()
        return self._replaced

    def add(self, rows: DataFrame, batch: int, source: str = "") -> StoredIndex:
        """rows of `index.counted`; all chunks of their documents, which take the place of those that are there."""
        before = self._rows("forward")
        rows.where("doc_id is not null").select(*KEY, "dl", "terms").write.options(**STORED).mode("errorifexists").parquet(self._at("forward", batch))
        new = self.spark.read.parquet(self._at("forward", batch))
        posts = sorted_runs(new.coalesce(1) if new.count() <= SMALL else new, self.block_chunks)
        posts.write.options(**STORED).mode("overwrite").parquet(self._at("postings", batch))
        return self._told(before, new, batch, source)

    def add_texts(self, texts: DataFrame, batch: int, source: str = "", stop_words: Sequence[str] = STOP_WORDS) -> StoredIndex:
        """add(counted_words(texts)); texts are read twice, so best a table. Those of a large batch are counted and turned round at once."""
        texts = texts.where("doc_id is not null")
        if texts.count() <= SMALL:
            return self.add(counted_words(texts, stop_words), batch, source)
        before = self._rows("forward")
        posts = sorted_word_runs(texts, self.block_chunks, stop_words)
        posts.write.options(**STORED).mode("errorifexists").parquet(self._at("postings", batch))
        chunks = self.spark.read.schema(posts.schema).parquet(self._at("postings", batch)).where("term is null")
        chunks.select(F.inline_outer(F.arrays_zip(*KEY, "dl"))).write.options(**STORED).mode("errorifexists").parquet(self._at("forward", batch))
        return self._told(before, self.spark.read.parquet(self._at("forward", batch)), batch, source)

    def _at(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _told(self, before: DataFrame | None, new: DataFrame, batch: int, source: str) -> StoredIndex:
        """Ends a batch whose chunks (`new`) and postings are there: what it replaces of those before, and the sums."""
        where = lambda name: self._at(name, batch)
        lost = None
        if before is None:
            gone = new.select("doc_id", F.lit(0).alias("of")).limit(0)
        else:
            gone = self.live(before.select("doc_id", "batch").distinct()).join(new.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("batch").alias("of"))
        gone.write.options(**STORED).mode("overwrite").parquet(where("gone"))
        if before is not None:
            old = self.spark.read.schema(T.StructType([new.schema["doc_id"], T.StructField("of", T.IntegerType())])).parquet(where("gone")).withColumnRenamed("of", "batch")
            # batches that lose nothing are not read
            losing = [r.batch for r in old.select("batch").distinct().collect()]
            if losing:
                lost = before.where(F.col("batch").isin(losing)).join(old, ["doc_id", "batch"], "left_semi")
        chunks = new.count()
        small = chunks <= SMALL
        blocks = max(1, -(-chunks // self.block_chunks))
        packs = self.spark.read.parquet(where("postings")).where("term is not null")
        df = packs.groupBy("term").agg(F.sum("n").alias("df"))
        df = df.repartition(1) if small else df
        df.sortWithinPartitions("term").write.options(**STORED).mode("overwrite").parquet(where("terms"))
        if self.long is not None:
            # a table, whose size is known: a small one is broadcast, and only the postings of its terms are looked at further
            frequent = materialize(self.spark.read.schema(df.schema).parquet(where("terms")).where(F.col("df") >= self.long).select("term"), "stored-frequent")
            bounds = run_bounds(packs.join(frequent, "term", "left_semi"))
            bounds.sortWithinPartitions("term").select("term", F.inline_outer(F.arrays_zip("block", "n", "max_tf", "min_dl"))).write.options(**STORED).mode("overwrite").parquet(where("blocks"))
        size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.count_distinct("doc_id").alias("docs"))
        total = size(new)
        if lost is not None:
            total = total.crossJoin(size(lost).toDF("ln", "ll", "ld")).select((F.col("n") - F.col("ln")).alias("n"), (F.col("length") - F.col("ll")).alias("length"), (F.col("docs") - F.col("ld")).alias("docs"))
        total.select("*", F.lit(blocks).alias("blocks"), F.lit(source).alias("source")).coalesce(1).write.options(**STORED).mode("overwrite").parquet(where("totals"))
        self._whole = self._replaced = None
        return self

    def next_batch(self) -> int:
        """One more than any that was begun."""
        begun = [found.agg(F.max("batch")).first()[0] or 0 for name in ("forward", "postings") if (found := self._read(name)) is not None]
        return 1 + max(begun, default=0)

    @property
    def postings(self) -> DataFrame:
        """term, block, doc_id, chunk_index, tf, dl, batch of what is there now."""
        # outer: Catalyst would else put a filter on the lists below, which makes them twice
        lists = F.inline_outer(F.arrays_zip("block", *KEY, "tf", "dl"))
        return self.live(self._rows("postings").where("term is not null").select("term", "batch", lists)).select("term", "block", *KEY, "tf", "dl", "batch")

    @property
    def chunk_stats(self) -> DataFrame:
        return self.live(self._rows("forward").select(*KEY, "dl", "batch")).drop("batch")

    @property
    def corpus_stats(self) -> DataFrame:
        """One row: n and avgdl, from the batches' totals."""
        n = F.sum("n")
        return self._rows("totals").agg(F.coalesce(n, F.lit(0)).alias("n"), F.when(n > 0, F.sum("length") / n).otherwise(0.0).alias("avgdl"))

    @property
    def doc_freq(self) -> DataFrame:
        """term, df of terms that are there now. What replaced documents had of them is counted here, of the terms that are asked for."""
        rows = self._rows("terms").select("term", F.col("df").cast("long").alias("df"))
        if self._replaces():
            had = self._rows("postings").where("term is not null").select("term", "batch", F.explode_outer("doc_id").alias("doc_id"))
            rows = rows.unionByName(had.join(self._gone(), ["doc_id", "batch"], "left_semi").select("term", F.lit(-1).cast("long").alias("df")))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def blocks(self) -> DataFrame:
        """batch, term, block, n, max_tf, min_dl. Replaced documents count still, so bounds are bounds all the same."""
        found = self._rows("blocks")
        return self.spark.createDataFrame([], "term string, block int, n long, max_tf int, min_dl int, batch int") if found is None else found

    def size(self) -> DataFrame:
        """One row: distinct terms, chunks, documents."""
        return self.doc_freq.agg(F.count(F.lit(1)).alias("terms")).crossJoin(self._rows("totals").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")))

    def index(self) -> Index:
        """What is there now, with its statistics."""
        return Index(self.postings.drop("block", "batch"), self.chunk_stats, self.corpus_stats, self.doc_freq)

    @property
    def alone(self) -> bool:
        """Whether there is one batch, which therefore replaces nothing."""
        whole = self.batches()
        return len(whole) == 1 and self._gone().isEmpty()

    def merged(self, path: str, source: str = "") -> StoredIndex:
        """What is there now as one batch in another folder: the files of many small batches become few, and
        replaced documents are left behind."""
        if path == self.path:
            raise ValueError("an index is merged into another folder")
        out = StoredIndex(self.spark, path, self.block_chunks, self.long)
        if self.alone:
            # one batch is merged already: its tables are copied as they lie, and nothing is shuffled
            for name in ("forward", "postings", "terms", "blocks", "gone", "totals"):
                if (rows := self._rows(name)) is None:  # no bounds
                    continue
                rows = rows.drop("batch")
                (rows.withColumn("source", F.lit(source)) if name == "totals" else rows).write.options(**STORED).mode("errorifexists" if name == "forward" else "overwrite").parquet(f"{path}/{name}/batch=1")
            return out
        terms = self.postings.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms"))
        return out.add(self.chunk_stats.join(terms, list(KEY), "left"), 1, source)
