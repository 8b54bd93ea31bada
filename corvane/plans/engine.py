"""The engine: documents in, index and vectors kept, questions answered.

Every step is a DataFrame; `search` takes a table of queries and gives a table of results.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.metadata import doc_metadata
from corvane.functions.segment import DEFAULT, Positions, segmented, user_lexicon, with_user_words
from corvane.functions.text import STOP_WORDS, index_tokens, word_index_tokens
from corvane.operators import bm25, hybrid, lexicon, prompts, results, vector
from corvane.operators.chunking import MAX_BYTES, OVERLAP, chunks_arrow
from corvane.operators.index import KEY, Index, counted
from corvane.operators.stored import StoredIndex
from corvane.sources import files
from corvane.sources.shared import STORED, fresh_path, materialize

log = logging.getLogger(__name__)
#: Documents from which on a batch is written as it comes, if no id repeats; smaller ones become few files.
DIRECT = 5_000


@dataclass
class Settings:
    max_bytes: int = MAX_BYTES
    overlap: int = OVERLAP
    k1: float = bm25.K1
    b: float = bm25.B
    weights: tuple[float, float] = (hybrid.BM25_WEIGHT, hybrid.VECTOR_WEIGHT)
    stop_words: tuple[str, ...] = STOP_WORDS
    lexicon: Mapping[str, int] | None = None  # None: words between blanks; else segmentation
    positions: Positions | None = None  # cuts what the lexicon does not know
    k: int = 5


@dataclass
class Answer:
    text: str
    results: DataFrame
    years: DataFrame
    prompt: str


@dataclass
class Engine:
    """Documents, chunks, the index (`stored.StoredIndex`), metadata and vectors are tables below `path` (a folder of its own
    in the shared folder, if none is given). Each `add` writes a batch to each of them, the index last: with it the batch
    counts. A search reads what is stored: of the postings those of its terms, the statistics as they were summed."""

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    embedding: vector.EmbeddingProvider | None = None
    chat: prompts.ChatProvider | None = None
    path: str | None = None

    @property
    def stored(self) -> StoredIndex:
        return StoredIndex(self.spark, f"{self.path}/index", long=None)  # its searches read whole lists

    @property
    def empty(self) -> bool:
        return self.path is None or not self.stored.batches()

    def _tokens(self, text: Column) -> Column:
        if self.settings.lexicon is None:
            return word_index_tokens(text, self.settings.stop_words)
        return index_tokens(segmented(F.coalesce(text, F.lit("")), self.settings.lexicon, self.settings.positions), self.settings.stop_words)

    def add(self, docs: DataFrame, source: str = "") -> Engine:
        """docs: doc_id, text. Documents with a known id take the place of the old ones; rows
        without id or text are left out. Of rows that repeat an id the least text counts. source names what they come
        from; what has been added under a name is not added again."""
        self.path = self.path or fresh_path(self.spark, "engine")
        if source and source in self.stored.sources():
            return self
        given = _given(docs)
        batch = self._begin(given)
        new = self.spark.read.schema(given.schema).parquet(self._folder("documents", batch))
        cut = chunks_arrow(new, self.settings.max_bytes, self.settings.overlap, start_pos=True)
        cut.sortWithinPartitions(*KEY).write.options(**STORED).mode("overwrite").parquet(self._folder("chunks", batch))
        doc_metadata(new).write.options(**STORED).mode("overwrite").parquet(self._folder("metadata", batch))
        stored = self.spark.read.schema(cut.schema).parquet(self._folder("chunks", batch))
        if self.settings.lexicon is None:
            self.stored.add_texts(stored, batch, source, self.settings.stop_words)
        else:
            self.stored.add(counted(stored.select(*KEY, self._tokens(F.col("content")).alias("tokens"))), batch, source)
        return self

    def _folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _begin(self, given: DataFrame) -> int:
        """Writes the documents of a new batch; its number. A number that another writer has taken is not taken again."""
        found = self._all("documents")
        batch = max(self.stored.next_batch(), 1 + ((found.agg(F.max("batch")).first()[0] or 0) if found is not None else 0))
        for last in (False,) * 9 + (True,):
            try:
                given.write.options(**STORED).mode("errorifexists").parquet(self._folder("documents", batch))
                return batch
            except AnalysisException:
                if last:
                    raise
                batch += 1
        raise AssertionError

    def _all(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException:  # there is none yet
            return None

    def _latest(self, name: str) -> DataFrame | None:
        """Rows of documents that no later batch has replaced, with the batch."""
        if self.path is None or not (whole := self.stored.batches()):
            return None
        return self.stored.live(self._all(name).where(F.col("batch").isin(whole)))

    def _current(self, name: str) -> DataFrame | None:
        rows = self._latest(name)
        return None if rows is None else rows.drop("batch")

    @property
    def documents(self) -> DataFrame | None:
        return self._current("documents")

    @property
    def chunks(self) -> DataFrame | None:
        return self._current("chunks")

    @property
    def metadata(self) -> DataFrame | None:
        return self._current("metadata")

    @property
    def index(self) -> Index | None:
        return None if self.empty else self.stored.index()

    def use_words(self, path: str) -> int:
        """Takes a file of words `word [freq] [tag]` into the lexicon; the number of its entries, 0 for a file that is not
        there. Documents that were added before keep their terms."""
        try:
            found = user_lexicon(self.spark, path)
            n = found.count()
        except AnalysisException:
            return 0
        self.settings.lexicon = with_user_words(found, DEFAULT if self.settings.lexicon is None else self.settings.lexicon)
        return n

    def learn_words(self, rounds: int = 3, **limits) -> int:
        """Takes words that the documents themselves show into the lexicon, and what their cut by it tells of characters' places in
        words, for what it does not have; the number of new words. Documents that were added before keep their terms."""
        known = DEFAULT if self.settings.lexicon is None else self.settings.lexicon
        if self.empty:
            return 0
        found = materialize(lexicon.runs(self.documents), "runs")
        learned, _ = lexicon.refine(found, lexicon.candidates(found, **limits), rounds)
        new = {w: n for w, n in learned.items() if len(w) > 1 and w not in known}
        self.settings.lexicon = {**known, **new}
        cut = segmented(F.col("run"), self.settings.lexicon)
        self.settings.positions = lexicon.positions(lexicon.position_counts(found, cut))
        return len(new)

    def import_files(self, paths: Sequence[str], ocr: files.OcrProvider | None = None) -> DataFrame:
        """Adds what gives text; returns the import log, with a row for each path that is not there."""
        there = [p for p in paths if files.is_there(self.spark, p)]
        log = files.missing_files(self.spark, [p for p in paths if p not in there], self.spark.createDataFrame([], "doc_id string"))
        if not there:
            return log
        parsed = materialize(files.parse(files.read_files(self.spark, *there), ocr), "parsed")
        self.add(parsed.where("status = 'Success'"))
        return files.import_log(parsed, self.chunks.join(parsed.select("doc_id"), "doc_id", "left_semi")).unionByName(log)

    def clear(self) -> Engine:
        """Forgets all documents; tables that were saved or loaded stay where they are."""
        self.path = None
        return self

    def all_documents(self) -> DataFrame:
        return self.documents.select("doc_id")

    def doc_ids(self) -> DataFrame:
        """Those with metadata only."""
        return self.metadata.select("doc_id")

    def save(self, path: str) -> None:
        """What counts of each table, as one batch. It goes to another folder than the engine's own."""
        if path == self.path:
            raise ValueError("the engine's tables are there already")
        alone = self.stored.alone  # a single batch is copied as it lies
        for name in ("documents", "chunks", "metadata"):
            rows = self._current(name)
            (rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY) if name == "chunks" and not alone else rows).write.options(**STORED).mode("overwrite").parquet(f"{path}/{name}/batch=1")
        stored = self._all("vectors")
        if stored is not None:
            # what goes is looked for by digests, so that vectors stay where they are if few or none go
            gone = materialize(vector.without(stored.select("digest").distinct(), vector.digests(self.chunks)), "vectors-gone")
            (stored if gone.isEmpty() else stored.join(gone, "digest", "left_anti")).write.options(**STORED).mode("overwrite").parquet(f"{path}/vectors")
        self.stored.merged(f"{path}/index")

    def load(self, path: str) -> Engine:
        """Goes on with the tables at path; what is added is added there."""
        self.path = path
        return self

    @property
    def vectors(self) -> DataFrame | None:
        """doc_id, chunk_index, vec of the chunks that are there and whose contents have a vector of this provider's (any, without one)."""
        stored = self._all("vectors") if self.path else None
        if stored is None or self.empty:
            return None
        model = vector.model_of(self.embedding) if self.embedding else None
        return vector.of_chunks(self.chunks, stored, model)

    def sync_vectors(self) -> DataFrame:
        """Embeds and stores contents that have no vector yet, each once, whatever the number of chunks and documents that have it and
        however often these are replaced."""
        model = vector.model_of(self.embedding)
        todo = vector.misses(self.chunks, self._all("vectors"), model)
        # a failed append leaves nothing behind, and what two writers have both asked for is read once
        vector.embed_contents(todo, self.embedding, model).write.options(**STORED).mode("append").parquet(f"{self.path}/vectors")
        return self.vectors

    def queries(self, texts: Iterable[str]) -> DataFrame:
        """query_id, query, terms."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
        terms = rows.withColumn("terms", self._tokens(F.col("query")))
        return terms.withColumn("terms", hybrid.expand_terms(F.col("query"), F.col("terms")))

    def _near(self, texts: Sequence[str], depth: int) -> DataFrame | None:
        """The chunks next to each text by vectors. All that the provider is asked for is asked and stored here, so
        whatever goes wrong with it goes wrong here: None, as without a provider."""
        if self.embedding is None or not self.embedding.ready:
            return None
        try:
            vecs = self.embedding.embed(list(texts))
            if not vecs:
                return None
            if len(vecs) != len(texts):
                raise ValueError(f"{len(vecs)} vectors for {len(texts)} texts")
            asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs) if v], "query_id long, vec array<double>")
            found = vector.search(self.sync_vectors().withColumn("vec_id", F.struct(*KEY)), asked, depth, vec_col="vec")
            return materialize(found.select("query_id", "vec_id.doc_id", "vec_id.chunk_index", F.col("similarity").alias("vector_score")), "near")
        except Exception as e:  # a provider may raise anything, on the driver or in a task
            log.warning("no vectors, words alone: %s", e)
            return None

    def search_many(self, texts: Sequence[str], k: int | None = None) -> DataFrame:
        """query_id, rank, doc_id, chunk_index, content, bm25_score, vector_score, final_score. A query for which there
        are no vector candidates is ranked by words alone, with their raw scores."""
        k = k or self.settings.k
        words = bm25.search(self.index, self.queries(texts), hybrid.depth(k), self.settings.k1, self.settings.b).drop("rank")
        near = self._near(texts, hybrid.depth(k))
        if near is None:
            found = hybrid.fallback(words, k)
        else:
            both = near.select("query_id").distinct()
            columns = ["query_id", "rank", *KEY, "bm25_score", "vector_score", "final_score"]
            fused = hybrid.fuse(words.join(both, "query_id", "left_semi"), near, k, self.settings.weights)
            found = fused.select(*columns).unionByName(hybrid.fallback(words.join(both, "query_id", "left_anti"), k).select(*columns))
        found, cut = materialize(found, "found"), self.chunks.select(*KEY, "content")
        if len(texts) * k <= bm25.FEW_TERMS:  # few ids reach the chunks' scan
            cut = cut.where(F.col("doc_id").isin([r[0] for r in found.select("doc_id").distinct().collect()]))
        return found.join(cut, list(KEY)).select("query_id", "rank", *KEY, "content", "bm25_score", "vector_score", "final_score")

    def search(self, query: str, k: int | None = None) -> DataFrame:
        return self.search_many([query], k).drop("query_id").orderBy("rank")

    def answer(self, query: str, case_type: str = results.ALL, level: str = results.ALL, year: str = results.ALL, respect_filters: bool = False, on_text: Callable[[str], None] | None = None) -> Answer | None:
        """A blank query has no answer, an empty index a notice. Questions about all documents look wider, take two chunks a
        document and, unless respect_filters is set, pay no heed to filters."""
        query = query.strip()
        if not query:
            return None
        if self.empty or self.chunks.isEmpty():
            nothing = self.spark.createDataFrame([], "rank int, doc_id string")
            return Answer("没有已导入的文档", nothing, self.spark.createDataFrame([], "year string"), "")
        wide = self.spark.range(1).select(results.asks_aggregate(F.lit(query))).first()[0]
        found = self.search(query, 20)
        years = results.year_facet(found, self.metadata)
        kept = results.filtered(found, self.metadata, case_type, level, year)
        if wide:
            more = results.per_doc_cap(self.search(query, 50))
            if respect_filters:
                more = results.filtered(more, self.metadata, case_type, level, year)
            kept = kept if more.isEmpty() else more
            notes = results.metadata_rollup(self.metadata)
        else:
            notes = results.metadata_summary(kept, self.metadata)
        parts = results.build_context(kept).crossJoin(notes.select("summary"))
        q, c, m = F.lit(query), F.col("context"), F.col("summary")
        system, user = parts.select(prompts.system_prompt(c), prompts.prompt(q, c, m)).first()
        return Answer(prompts.generate(self.chat, system, user, on_text), kept, years, user)


def _given(docs: DataFrame) -> DataFrame:
    """doc_id, text of documents that have both, one row an id."""
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    # ids alone tell whether texts have to be shuffled
    n, most = rows.groupBy("doc_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    # neither is a filter of the texts: Catalyst would put it below what makes them, which then makes them twice
    if n >= DIRECT and most == 1:
        kept = F.filter(F.array(F.struct("doc_id", "text")), lambda r: r["text"] != "")
        return rows.select(F.inline_outer(kept)).where("doc_id is not null")
    return rows.groupBy("doc_id").agg(F.min(F.when(F.col("text") != "", F.col("text"))).alias("text")).where("text is not null")


def legal(spark: SparkSession, **options) -> Engine:
    """An engine for Chinese legal texts."""
    return Engine(spark, Settings(lexicon=DEFAULT), **options)


def remote(spark: SparkSession, embeddings_url: str, chat_url: str, *variables: str, **options) -> Engine:
    """An engine for Chinese legal texts with services for vectors and answers; their key is in the environment.
    Without one it ranks by words, and answers are a notice."""
    key = results.key_from_environment(*variables)
    return legal(spark, embedding=vector.HttpProvider(embeddings_url, key), chat=prompts.HttpChat(chat_url, key), **options)
