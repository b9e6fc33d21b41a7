"""Contiguous shards of near-equal bytes, cut from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OVERHEAD = 16


def byte_shards(docs: DataFrame, shards: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Return order, size, text_crc32, shard and slot of every row, in `shards` contiguous shards.

    Rows are dealt out by ranges of `order`; each range's totals give its offset, so that only
    one row per range is ever summed in one place. Row r with e bytes before it and size s goes to
    shard floor((2e + s) * shards / 2T): the shard that holds the middle of its bytes.

    A null text has size 16 and the crc32 of no bytes; equal ids are ordered by size and crc32, a
    null id comes first; fewer rows than shards leave shards empty; an empty table gives no rows.
    Other columns of docs aren't read, so their names can't clash.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    sized = docs.select(
        F.col(order).alias("id"), (F.octet_length(raw).cast("long") + OVERHEAD).alias("size"), F.crc32(raw).alias("crc")
    )
    ranged = written(sized.repartitionByRange("id", "size", "crc").withColumn("part", F.spark_partition_id()))

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    total = totals.agg(F.sum("bytes").alias("total"))

    inside = Window.partitionBy("part").orderBy("id", "size", "crc")
    placed = (
        ranged.withColumn("running", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside) - 1)
        # one row per range, and one row: their number is that of the shuffle's partitions
        .join(F.broadcast(offsets), "part")
        .join(F.broadcast(total))
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("running")) - F.col("size"))
        .withColumn("shard", F.expr(f"least({shards - 1}, middle * {shards} div (2 * total))").cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("nth"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(order), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot")
    )
