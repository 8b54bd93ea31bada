"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: How tables that stay are written.
STORED = {"compression": "zstd"}


def shared_dir(spark: SparkSession) -> str:
    """It is spark.checkpoint.dir; where the session has none (tests, local mode), a folder of this
    machine takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            found = set_before.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="corvane-")
            spark.sparkContext.setCheckpointDir(found)
            found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: What this process has put into the shared folder, and which of its threads did.
_made: dict[str, int] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    _made[path] = threading.get_ident()
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def shared_paths() -> frozenset[str]:
    """What this thread has put into the shared folder and not dropped; others may be at work next to it."""
    own = threading.get_ident()
    return frozenset(p for p, who in list(_made.items()) if who == own)


def drop_since(spark: SparkSession, before: frozenset[str], *kept: str) -> None:
    """Deletes what came to the shared folder since, but for paths to keep."""
    for path in sorted(shared_paths() - before - {*kept}):
        drop_path(spark, path)


def clear_shared(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this process. DataFrames that operators returned may read
    them, so it is for when these have been written or are no longer needed."""
    for path in sorted(_made):
        drop_path(spark, path)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's path. It cuts the lineage
    there: a lost executor costs no more than the tasks that read the table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """The table alone."""
    return written(df, label)[0]


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make() returns as a table; the tables that were written on the way to it go."""
    there = shared_paths()
    df, path = written(make(), label)
    drop_since(spark, there, path)
    return df
