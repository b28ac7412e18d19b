"""Operator 8: contiguous balanced shards from global byte-size prefix sums.

Rows are put in one global order by a range exchange of small keys (never the texts), each range
reports its bytes and rows, and the running totals of the ranges turn local prefix sums into global
ones. Equal targets cut the global byte axis. Only one total per range reaches the driver-sized side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import kept


def byte_shards(docs: DataFrame, shards: int = 8, together: float = 1 / 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row of ``docs(doc_id, text)``.

    size is the text's UTF-8 bytes (0 for null) plus 1. The global order is that of the text's MD5 (its first 60 bits), then
    doc_id, so equal texts (null and empty alike) are neighbours. A row goes to the shard where its group of equal texts starts
    on the byte axis; a group of more than ``together`` of a shard's target is cut at the targets row by
    row, so one that holds a third of the table can't unbalance it. Null doc_ids come first; repeated
    rows each get a slot; no rows give no rows. slot counts from 0 in each shard.
    """
    spark = docs.sparkSession
    keys = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))), 1, 15), 16, 10).cast("long").alias("h"),
    )
    ranged = kept(
        keys.repartitionByRange("h", "doc_id").withColumn("part", F.spark_partition_id()), "byte_shards"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row per range
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    local = Window.partitionBy("part").orderBy("h", "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(offsets, "part").withColumn(
        "start", F.col("before") + F.coalesce(F.sum("size").over(local), F.lit(0))
    )
    # A group of equal texts may lie in many ranges; its totals are put together from one row per range and joined back
    # by range, so that a group of any size is never one key's rows.
    every = Window.partitionBy("h")
    groups = placed.groupBy("part", "h").agg(F.min("start").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = groups.select("part", "h", F.min("first").over(every).alias("first"), F.sum("bytes").over(every).alias("group_bytes"), F.sum("rows").over(every).alias("rows"))
    groups = groups.where("rows > 1").drop("rows")
    cut = placed.join(groups, ["part", "h"], "left").withColumn(
        "at",
        F.when(F.col("group_bytes") <= F.col("total") * F.lit(together / shards), F.col("first")).otherwise(F.col("start")),
    )
    cut = cut.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("at") * shards / F.col("total"))).cast("int"))
    heads = cut.groupBy("part", "shard").agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("part", "shard", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part", "shard").orderBy("start", "doc_id")
    return (
        cut.join(heads, ["part", "shard"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.row_number().over(inside) - 1).alias("slot"))
    )


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return byte_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
