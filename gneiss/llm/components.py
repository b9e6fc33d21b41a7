"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: A table of at most so many short rows may be broadcast: 40 MB.
BROADCAST_ROWS = 300_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast only if it is counted to be small; otherwise Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, rest: see folded) with `row`, an own long for each row: its doc_id where no other row has it; rows with null and repeated ids are written with numbers from -2**62 on."""
    again = written(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    own = F.col("doc_id").cast("long").alias("row")
    if again.isEmpty():
        return docs.select("*", own)
    ids = sized(again.where("doc_id IS NOT NULL"))
    alone = docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti").select("*", own)
    rest = docs.where("doc_id IS NULL").unionByName(docs.join(ids, "doc_id", "left_semi"))
    return alone.unionByName(written(rest.withColumn("row", F.monotonically_increasing_id() - 2**62)))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component), the component being its smallest node; nodes without edges don't appear.

    Each step replaces edges by edges to a smaller node and keeps components; it ends when nothing changes. Edges
    stay in tables: none reaches the driver. Loops and repeated edges are dropped, edges with a null end too.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(sized(near), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(sized(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, written(small)
        forget(before, near, large, least)
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen:
            break
        seen = mark
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
