"""Sharding by fixed virtual slots, with DataFrame and SQL functions only.

A record's hash names one of `slots` virtual slots, for good. What moves are slots: a versioned
map says which shard holds which slot. The bytes of each slot are summed, and the map is edited
so that shards hold nearly equal bytes: every shard keeps its largest slots up to the mean, the
rest are placed one by one, largest first, on the shard that holds least. A new shard is filled
by edits too, which move slots into it and nowhere else.

Rows that are equal in id and text are numbered, and the hash takes the number in, so that a row which
a third of the table repeats spreads over all slots. Numbers are given in two levels: within the
partition that a row was read in, and above that by the counts of the partitions before. Numbers depend
on what is repeated how often, not on which copy is which.

All that is gathered in one place is a row per slot and part, whose numbers are parameters, not the
number of records. Positions within a shard are the part's offset plus the rank within the part (a
slot has `PARTS`), so ranking is spread over all slots and parts.

Defined results: a null text counts 8 bytes and has the checksum of the empty text; a null
doc_id is hashed by its text alone. Null and empty texts are equal. Equal rows take positions in any order among themselves. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import fresh_path, materialize, pick, settled

SLOTS, PARTS = 4096, 16


def hashed(text: Column) -> Column:
    """60 bits of a text's SHA-1, as any SQL has them."""
    return F.conv(F.substring(F.sha1(text), 1, 15), 16, 10).cast("long")


def records(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, size, text_crc32, h (a hash of id and text), chunk (the partition read)."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        hashed(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))).alias("h"),
        F.spark_partition_id().alias("chunk"),
    )


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows of `records` that have been stored, with vslot and part in place of h and chunk."""
    counts = rows.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    same = W.partitionBy("h")
    before = F.coalesce(F.sum("n").over(same.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("h", "chunk", before.alias("before"), F.sum("n").over(same).alias("all")).where(F.col("all") > 1).drop("all")
    rank = F.row_number().over(W.partitionBy("h", "chunk").orderBy("size"))
    copy = F.when(F.col("before").isNotNull(), F.col("before") + rank - 1).otherwise(0)
    numbered = rows.join(offsets, ["h", "chunk"], "left").withColumn("copy", copy)
    mixed = F.when(F.col("copy") > 0, hashed(F.concat(F.col("h").cast("string"), F.lit(":"), F.col("copy").cast("string")))).otherwise(F.col("h"))
    at = numbered.withColumn("h", mixed)
    return at.select("doc_id", "size", "text_crc32", (F.col("h") % slots).cast("int").alias("vslot"), F.expr(f"cast((h div {slots}) % {PARTS} as int) as part"))


def part_bytes(rows: DataFrame) -> DataFrame:
    """vslot, part, bytes, n of what there is."""
    return rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def slot_bytes(parts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, bytes of every slot, empty ones too."""
    found = parts.groupBy("vslot").agg(F.sum("bytes").alias("bytes"))
    every = parts.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").na.fill(0)


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt round."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to those stored at path, or takes the place of one of the same number."""
    slot_map.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """That version or the latest."""
    every = spark.read.schema("vslot int, shard int, version int").parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version, by bytes. Slots whose shard does not exceed the mean stay."""
    known = slot_map.join(sizes, "vslot")
    by_size = W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0)
    mean = known.agg((F.sum("bytes") / shards).alias("mean"))
    ranked = known.withColumn("upto", F.sum("bytes").over(by_size)).crossJoin(F.broadcast(mean))
    ranked = ranked.withColumn("stays", (F.col("upto") <= F.col("mean")) & (F.col("shard") < shards))
    # a row per slot at most in these arrays
    gathered = ranked.agg(
        F.max("version").alias("version"),
        F.collect_list(F.when(F.col("stays"), F.struct("vslot", "shard", "bytes"))).alias("kept"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), F.col("vslot").alias("vslot"))))).alias("pool"),
    )
    loads = f"transform(sequence(0, {shards - 1}), s -> aggregate(filter(kept, k -> k.shard = s), 0L, (a, k) -> a + k.bytes))"
    least = "cast(array_position(acc.loads, array_min(acc.loads)) as int) - 1"
    placed = f"""aggregate(pool, named_struct('loads', {loads}, 'moved', cast(array() as array<struct<vslot:int,shard:int>>)),
        (acc, x) -> named_struct(
            'loads', transform(acc.loads, (v, i) -> if(i = {least}, v - x.less, v)),
            'moved', array_append(acc.moved, named_struct('vslot', x.vslot, 'shard', {least}))),
        acc -> acc.moved)"""
    moved = gathered.select((F.col("version") + 1).alias("version"), F.explode(F.concat(F.expr("transform(kept, k -> named_struct('vslot', k.vslot, 'shard', k.shard))"), F.expr(placed))).alias("m"))
    return moved.select("version", "m.vslot", "m.shard")


def grow(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version with a shard more: each shard gives the new one its smallest slots, up to
    what it holds above the new mean; no other slot moves."""
    known = slot_map.join(sizes, "vslot")
    small = W.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(W.unboundedPreceding, 0)
    mean = known.agg((F.sum("bytes") / (shards + 1)).alias("mean"))
    ranked = known.withColumn("upto", F.sum("bytes").over(small)).withColumn("all", F.sum("bytes").over(W.partitionBy("shard"))).crossJoin(F.broadcast(mean))
    gives = F.col("upto") <= F.col("all") - F.col("mean")
    return ranked.select((F.col("version") + 1).alias("version"), "vslot", F.when(gives, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def place(rows: DataFrame, slot_map: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with shard and slot, the position within the shard."""
    before = W.partitionBy("shard").orderBy("vslot", "part").rowsBetween(W.unboundedPreceding, -1)
    at = slot_map.join(parts, "vslot").select("vslot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    # slots x PARTS rows at most, however many records there are
    joined = rows.withColumn("rank", rank).join(F.broadcast(at), ["vslot", "part"])
    return joined.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot; law `bytes`. The map is stored at map_path
    (a new path by default): version 1, or the latest one there, and the edited version."""
    spark = docs.sparkSession
    rows = settled(spark, lambda: slotted(materialize(records(docs, id_col, text_col), "shard-records"), slots), "shard-slotted")
    parts = materialize(part_bytes(rows), "shard-parts")
    old = first_map(spark, shards, slots)
    if map_path is None:
        map_path = fresh_path(spark, "slot-map")
        save_map(old, map_path)
    else:
        old = load_map(spark, map_path)
    # a copy of its own, whatever another run stores under the same number
    new = materialize(rebalance(old, slot_bytes(parts, slots), shards), "slot-map-edited")
    save_map(new, map_path)
    return place(rows, new, parts)
