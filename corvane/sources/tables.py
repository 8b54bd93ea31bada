"""Tables as they lie on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = 1 << 30
#: Bytes of a small table to a task, so that what a task holds does not grow with the table.
PART_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table that comes in fewer splits than there are cores (one file with one row group,
    say) is dealt out evenly. Larger tables, and those in enough splits, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, -(-size // PART_BYTES)))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)
