"""Documents as a stream: each micro-batch becomes a batch of an engine's tables, and takes the place of earlier
versions of its documents. A batch is named by the stream's checkpoint and its number there, so one that is run again
after a failure is added once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.index import Index
from corvane.operators.prompts import line_delta
from corvane.plans.engine import Engine


def ingest(docs: DataFrame, engine: Engine | str, checkpoint: str, **trigger) -> StreamingQuery:
    """docs: a stream of doc_id, text. engine: one with a path, or the path of one with default settings."""

    def add(df: DataFrame, batch: int) -> None:
        own = Engine(df.sparkSession, path=engine) if isinstance(engine, str) else engine
        own.add(df, f"{checkpoint}#{batch}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_index(spark: SparkSession, path: str) -> Index:
    """The index of what is there now."""
    return Engine(spark, path=path).index


def deltas(lines: DataFrame) -> DataFrame:
    """A stream of event-stream lines (line) as a stream of texts."""
    return lines.withColumn("text", line_delta(F.col("line"))).where("text <> ''")
