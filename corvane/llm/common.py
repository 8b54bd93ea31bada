"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.shared import clear_shared as clear_shared
from corvane.sources.shared import drop_path as drop_path
from corvane.sources.shared import drop_since as drop_since
from corvane.sources.shared import fresh_path as fresh_path
from corvane.sources.shared import materialize as materialize
from corvane.sources.shared import settled as settled
from corvane.sources.shared import shared_dir as shared_dir
from corvane.sources.shared import shared_paths as shared_paths
from corvane.sources.shared import written as written
from corvane.sources.tables import table as table

#: Python operators split their input into slices of about so many bytes of text, so that
#: memory does not depend on how Spark cuts its Arrow batches.
SLICE_BYTES = 1 << 20
#: Slices after which freed memory is given back.
TRIM = 16
#: Spark hands Python batches of at most so many bytes, which bounds what a task holds outside
#: of the JVM's heap when texts are long. A session that sets less keeps its value.
BATCH_BYTES = 4 << 20


def _bytes(text: str) -> int | None:
    m = re.fullmatch(r"\s*(\d+)\s*([bkmgt]?)b?\s*", text.lower())
    return int(m[1]) << 10 * "bkmgt".index(m[2] or "b") if m else None


def tame(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = _bytes(spark.conf.get(key))
    if now is None or not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def position(df: DataFrame, name: str) -> int:
    """Of a column. Exact names win, so that columns which differ in case, or which are there twice,
    do not make a reference ambiguous; the first of equals is taken."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact and not loose:
        raise ValueError(f"column {name!r} is missing; there are {df.columns}")
    return (exact or loose)[0]


def numbered(df: DataFrame) -> DataFrame:
    """Columns c0, c1, ... in place of names that may clash; toDF(*df.columns) brings these back."""
    tame(df.sparkSession)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def count_position(df: DataFrame, name: str | None) -> int | None:
    """Of a column of whole numbers; a column of any other kind is no count and stays as it is."""
    if name is None or not any(c.lower() == name.lower() for c in df.columns):
        return None
    at = position(df, name)
    return at if isinstance(df.schema[at].dataType, (T.LongType, T.IntegerType)) else None


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by `position`."""
    tame(df.sparkSession)
    where = [position(df, name) for name in names]
    safe = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return safe.select(*[F.col(f"__c{i}").alias(n) for i, n in zip(where, names, strict=True)])


def _trim() -> None:
    """Gives memory that was freed back to the machine: workers stay, and the next operator's may be others' task."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def _glibc():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_libc = _glibc()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one slice holds about `limit` bytes of `column` or one row."""
    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
                seen += 1
                if seen % TRIM == 0:
                    _trim()
            total += int(n)
        yield batch.slice(start)
    _trim()


def arrow_batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema
    )
