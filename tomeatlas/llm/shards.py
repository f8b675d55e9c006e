"""Contiguous shards of nearly equal bytes, by prefix sums over partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeatlas.llm.stored import Stored


def byte_shards(docs: DataFrame, shards: int, blocks: int | None = None) -> DataFrame:
    """Deal documents to ``shards`` contiguous shards whose byte sizes are nearly equal.

    The order is doc_id (null first), then checksum and size of the text. Rows are ranged into blocks by that
    order; a block sums its bytes and rows, and the running sums over the block totals (one row a block) give
    every row its global start and rank. A document goes to the shard in which its middle byte falls, so a shard
    misses its target by half a document at either end at most. The slot is the rank in the shard.

    Size is the UTF-8 bytes of the text plus one; a null text has none (size 1, checksum of no bytes), like an
    empty one. Equal rows each get a slot of their own. An empty table gives no rows; a shard can stay empty if
    there are fewer documents than shards or one is larger than a target. Further columns are not read.

    Returns doc_id, size, text_crc32, shard, slot.
    """
    spark = docs.sparkSession
    stored = Stored(spark, "shards")
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    ranged = stored.save(rows.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), "blocks")
    up_to = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = ranged.groupBy("block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    starts = totals.select("block", F.coalesce(F.sum("bytes").over(up_to), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(up_to), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    within = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("to_here", F.sum("size").over(within)).withColumn("nth", F.row_number().over(within))
        .join(starts, "block")
        .withColumn("middle2", (F.col("bytes_before") + F.col("to_here")) * 2 - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(cast(middle2 as decimal(38,0)) * {shards} div (2 * all_bytes) as int)")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("nth") - 1).alias("rank"))
    )
    placed = stored.save(placed, "placed")
    stored.drop(ranged)
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
