"""Exact cosine search, and embedding providers.

One query runs on built-in expressions. Many queries are taken in blocks: both sides are packed into rows
that hold a block each, every block of queries meets every block of vectors in some task, which
multiplies the two in numpy, where the block's directions allow for one of the best k, and keeps the best k a query over
all its blocks. Of the vectors a bounded number of pivots reaches the driver, of the queries nothing.
"""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.vectors import TINY, cosine
from corvane.sources.shared import materialize

BLOCK = 2048
#: Groups of vectors by direction; rows of results that a task holds.
TILES, HELD = 256, 2_000_000
PER_CALL = 20


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, similarity: the k most similar, ties by id."""
    asked = F.array(*[F.lit(float(x)) for x in query]) if len(query) else F.array().cast("array<double>")
    return vectors.select(F.col(id_col), cosine(F.col(vec_col), asked).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def _packed(rows: DataFrame, block: int, prefix: str) -> DataFrame:
    """rows: id, vec. Blocks of up to `block` rows of one length, in the order they come: dim, ids (an array), values (doubles, row by
    row), and a cone that holds their directions: its axis and the cosine of its half angle."""
    kinds = f"{prefix}_dim int, {prefix}_values binary, {prefix}_axis binary, {prefix}_cone double"
    kind = T.StructType([T.StructField(f"{prefix}_ids", T.ArrayType(rows.schema["id"].dataType)), *T.StructType.fromDDL(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                vecs = [v if v is not None and None not in v else [] for v in part.column(1).to_pylist()]
                for dim in sorted({len(v) for v in vecs}):
                    some = [i for i, v in enumerate(vecs) if len(v) == dim]
                    ids = part.column(0).take(pa.array(some, pa.int64()))
                    values = np.array([vecs[i] for i in some], float).reshape(len(some), dim)
                    axis, half = _cone(values)
                    cells = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], k) for x, k in ((dim, pa.int32()), (values.tobytes(), pa.binary()), (axis.tobytes(), pa.binary()), (half, pa.float64())))]
                    yield pa.RecordBatch.from_arrays(cells, names=kind.names)

    return rows.mapInArrow(run, kind)


def _cone(values: np.ndarray) -> tuple[np.ndarray, float]:
    """Axis and half angle of a cone around rows; half a turn if one of them has no direction."""
    size = np.sqrt((values * values).sum(1))
    if not values.shape[1] or not np.isfinite(size).all() or (size < TINY).any():
        return np.zeros(values.shape[1]), math.pi
    units = values / size[:, None]
    axis = units.sum(0)
    length = math.sqrt(axis @ axis)
    if length < 1e-9:
        return np.zeros(values.shape[1]), math.pi
    return axis / length, float(np.arccos(np.clip(units @ (axis / length), -1, 1)).max())


def _by_direction(rows: DataFrame, tiles: int) -> DataFrame:
    """rows: id, vec, dealt so that vectors next to one of `tiles` pivots stand together. Pivots are vectors with the least hashes."""
    mark = F.xxhash64(F.col("id").cast("string") if not isinstance(rows.schema["id"].dataType, T.StructType) else F.to_json("id"))
    usable = rows.where("vec is not null and size(vec) > 0 and not exists(vec, x -> x is null)")
    found = [np.array(r.vec, float) for r in usable.orderBy(mark, F.xxhash64("vec")).select("vec").limit(tiles).collect()]
    pivots = [p / n for p in found if (n := math.sqrt(p @ p)) > TINY and len(p) == len(found[0])]
    if not pivots:
        return rows
    held = rows.sparkSession.sparkContext.broadcast(np.array(pivots))
    kind = T.StructType([*rows.schema.fields, T.StructField("tile", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            good = [i for i, v in enumerate(vecs) if v is not None and len(v) == held.value.shape[1] and None not in v]
            tile = np.full(len(vecs), -1, np.int32)
            if good:
                tile[good] = (np.array([vecs[i] for i in good], float) @ held.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], names=kind.names)

    # by range, so that a tile of many vectors is dealt to several tasks
    return rows.mapInArrow(run, kind).repartitionByRange("tile", mark).sortWithinPartitions("tile").select("id", "vec")


class Best:
    """The best k of the vectors that a block of queries has met so far, ties by id."""

    def __init__(self, ids: pa.Array, k: int):
        self.ids, self.k = ids, k
        self.rows: list[list[tuple]] = [[] for _ in range(len(ids))]
        self.least = np.full(len(ids), -np.inf)  # what a vector must have to be looked at

    def offer(self, query: np.ndarray, sims: np.ndarray, ids: list) -> None:
        """Similarities of vectors, by their place in ids, for some of the queries; (query, vector) side by side."""
        for at, q in enumerate(query.tolist()):
            own = np.flatnonzero(sims[at] >= self.least[q])
            if len(own) > self.k:  # those that may be among the best k: all that reach the k-th
                limit = np.partition(sims[at][own], -self.k)[-self.k]
                own = own[sims[at][own] >= limit]
            if len(own):
                new = [(-s, _rank(ids[i]), ids[i]) for s, i in zip(sims[at][own].tolist(), own.tolist())]
                self.rows[q] = sorted(self.rows[q] + new, key=lambda r: r[:2])[: self.k]
                if len(self.rows[q]) == self.k:
                    self.least[q] = -self.rows[q][-1][0]

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        at = [i for i, rows in enumerate(self.rows) for _ in rows]
        flat = [r for rows in self.rows for r in rows]
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(at, pa.int64())), pa.array([r[2] for r in flat], kind), pa.array([-r[0] for r in flat], pa.float64())], names=["query_id", "vec_id", "similarity"])


def _rank(x: object) -> tuple:
    """Null first, as Spark sorts."""
    if isinstance(x, dict):
        return (True, tuple(map(_rank, x.values())))
    return (False,) if x is None else (True, x)


def compared(v_dim: int, v_values: bytes, v_axis: bytes, v_half: float, v_ids: list, q_dim: int, q_values: bytes, best: Best) -> tuple[int, int]:
    """Offers a block of vectors to a block of queries. A query is left out if the cone of the block cannot hold a vector as
    near as its k-th best: for a vector v in the cone, the angle between q and v is at least that between q and the axis less half the cone's.
    (queries compared, queries left out)."""
    n = len(best.ids)
    if v_dim != q_dim or not v_dim:
        some = np.flatnonzero(best.least <= 0)
        best.offer(some, np.zeros((len(some), len(v_ids))), v_ids)
        return len(some), n - len(some)
    asked = np.frombuffer(q_values).reshape(-1, q_dim)
    size = np.sqrt((asked * asked).sum(1))
    some = np.arange(n)
    if v_half < math.pi:
        angle = np.arccos(np.clip(asked @ np.frombuffer(v_axis) / np.maximum(size, TINY), -1, 1))
        most = np.where(size < TINY, 0.0, np.cos(np.maximum(0.0, angle - v_half)))
        some = np.flatnonzero(most + 1e-7 >= best.least)
    if len(some):
        m = np.frombuffer(v_values).reshape(-1, v_dim)
        sizes = np.outer(size[some], np.sqrt((m * m).sum(1)))
        # rounded, so that ties do not hang on the order in which products were summed
        best.offer(some, np.round(np.where(sizes < TINY, 0.0, asked[some] @ m.T / np.maximum(sizes, TINY)), 12), v_ids)
    return len(some), n - len(some)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, tiles: int = TILES) -> DataFrame:
    """queries: query_id, vec. Returns query_id, vec_id, similarity, rank: for each query k of the vectors, those
    of another length than the query's and null ones with a similarity of 0. Vectors that point the same way stand in one block
    (`tiles` of them; 0: as they come), and a block is left out for the queries that it holds nothing for; a task keeps
    the best k of each query and hands on these alone."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    # tables, so that neither side is made again for each part of the other
    blocks = materialize(_packed(_by_direction(rows, tiles) if tiles else rows, block, "v"), "vector-blocks")
    asked = materialize(_packed(queries.select(F.col("query_id").alias("id"), F.col("vec")), block, "q").drop("q_axis", "q_cone").withColumn("q_no", F.monotonically_increasing_id()), "vector-queries")
    schema = T.StructType([queries.schema["query_id"], T.StructField("vec_id", vectors.schema[id_col].dataType), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        kind = None
        for batch in batches:
            cell = dict(zip(batch.schema.names, batch.columns))
            kind = cell["v_ids"].type.value_type
            for i in range(batch.num_rows):
                q_ids, q_values, q_dim = cell["q_ids"][i].values, cell["q_values"][i].as_py(), cell["q_dim"][i].as_py()
                name = cell["q_no"][i].as_py()
                if name not in best:
                    if sum(len(b.ids) for b in best.values()) * k > HELD:
                        yield from (b.batch(kind) for b in best.values())
                        best.clear()
                    best[name] = Best(q_ids, k)
                compared(cell["v_dim"][i].as_py(), cell["v_values"][i].as_py(), cell["v_axis"][i].as_py(), cell["v_cone"][i].as_py(), cell["v_ids"][i].values.to_pylist(), q_dim, q_values, best[name])
        yield from (b.batch(kind) for b in best.values())

    # a stated set of queries against all rows, in blocks
    found = blocks.crossJoin(asked).mapInArrow(run, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("vec_id", id_col)


class EmbeddingProvider(Protocol):
    """Turns texts into vectors. `ready` is false if there is no way to (no key, say)."""

    ready: bool

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """A provider without a network: hashed character trigrams, signed. Equal texts, equal vectors."""

    ready = True

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            b = f"  {t}  ".encode()
            for k in range(len(b) - 2):
                h = zlib.crc32(b[k : k + 3])
                out[i, h % self.dim] += 1 if h & 0x8000 else -1
        return out.tolist()


class HttpProvider:
    """Vectors from a service: a POST of {"model", "input": [texts]} with the key as bearer, answered by
    {"data": [{"embedding": [...]}, ...]}, in the order of the texts or with `index`. Without a key there is
    nothing to ask, and the answer is empty. A failing connection and an answer that is no JSON raise."""

    def __init__(self, url: str, key: str | None, model: str = "text-embedding-3-small", timeout: float = 60):
        self.url, self.key, self.model, self.timeout = url, key or "", model, timeout

    @property
    def ready(self) -> bool:
        return bool(self.key)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts or not self.key:
            return []
        body = json.dumps({"model": self.model, "input": texts}).encode()
        asked = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
            found = json.loads(answer.read())
        data = found.get("data") if isinstance(found, dict) else None
        rows = [d for d in data if isinstance(d, dict)] if isinstance(data, list) else []
        if all(isinstance(d.get("index"), int) for d in rows):
            rows.sort(key=lambda d: d["index"])
        return [[float(x) for x in d.get("embedding") or ()] for d in rows]


def embed_one(provider: EmbeddingProvider, text: str) -> list[float]:
    """The vector of one text; empty if the provider has none."""
    return next(iter(provider.embed([text])), [])


def embed(chunks: DataFrame, provider: EmbeddingProvider, per_call: int = PER_CALL) -> DataFrame:
    """doc_id, chunk_index, vec; the provider is called with per_call texts at a time. Texts for which it has
    no vectors have no row; vectors for some of a call's texts only are an error."""
    rows = chunks.select("doc_id", "chunk_index", "content")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a call's texts at a time, so that neither texts nor vectors of a batch are held at once as values
        for batch in batches:
            parts = []
            for i in range(0, batch.num_rows, per_call):
                asked = [t or "" for t in batch.column(2).slice(i, per_call).to_pylist()]
                got = provider.embed(asked) or [None] * len(asked)
                if len(got) != len(asked):
                    raise ValueError(f"{len(got)} vectors for {len(asked)} texts")
                parts.append(pa.array(got, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))], names=["doc_id", "chunk_index", "vec"])

    return rows.mapInArrow(run, schema).where("vec is not null")


def add(vectors: DataFrame, more: DataFrame) -> DataFrame:
    """vectors with more behind them; an id may come again."""
    return vectors.unionByName(more)


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector yet; these alone are embedded."""
    return chunks.join(vectors.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")


def current(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors of chunks that are there."""
    return vectors.join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi")


def sync(chunks: DataFrame, vectors: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """The vectors of all chunks: those there are, without those of chunks that are gone, and new ones."""
    return add(current(chunks, vectors), embed(missing(chunks, vectors), provider))


def model_of(provider: EmbeddingProvider) -> str:
    """What tells a provider's vectors from others': its `model`, or the name of its class."""
    return str(getattr(provider, "model", None) or type(provider).__name__)


def digest(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def digests(chunks: DataFrame) -> DataFrame:
    """The different digests of contents."""
    return chunks.select(digest(F.col("content")).alias("digest")).distinct()


def without(some: DataFrame, others: DataFrame) -> DataFrame:
    """The digests that others do not have."""
    return some.join(others.select("digest"), "digest", "left_anti")


def misses(chunks: DataFrame, stored: DataFrame | None, model: str) -> DataFrame:
    """digest, content: the different contents of chunks for which there is no vector of the model. stored: digest, model, vec."""
    rows = chunks.select(digest(F.col("content")).alias("digest"), "content")
    if stored is not None:
        # digests alone tell what is missing, as a table whose size is known; contents that are stored go before anything moves
        need = materialize(without(digests(chunks), stored.where(F.col("model") == model)), "vectors-missing")
        rows = rows.limit(0) if need.isEmpty() else rows.join(need, "digest", "left_semi")
    # a content that very many chunks have is one row a task before it is shuffled
    return rows.groupBy("digest").agg(F.first("content").alias("content"))


def embed_contents(contents: DataFrame, provider: EmbeddingProvider, model: str, per_call: int = PER_CALL) -> DataFrame:
    """digest, model, vec of rows of `misses`."""
    made = embed(contents.select(F.col("digest").alias("doc_id"), F.lit(0).alias("chunk_index"), "content"), provider, per_call)
    return made.select(F.col("doc_id").alias("digest"), F.lit(model).alias("model"), "vec")


def of_chunks(chunks: DataFrame, stored: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, chunk_index, vec of chunks whose content has a vector; one, if it is stored twice. model: None takes any."""
    own = stored if model is None else stored.where(F.col("model") == model)
    own = own.groupBy("digest").agg(F.max(F.struct("model", "vec")).alias("v"))
    return chunks.select("doc_id", "chunk_index", digest(F.col("content")).alias("digest")).join(own, "digest").select("doc_id", "chunk_index", "v.vec")
