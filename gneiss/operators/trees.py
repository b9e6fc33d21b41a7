"""Trees in tables: parents from nesting, and what nodes inherit along pointers that double."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.storage import forget, written

#: Elements that hold others; all others are leaves here, since their ends are optional or absent.
HOLDERS = "html head body nav ul ol li div article section main header footer aside table thead tbody tr td th form figure blockquote a h1 h2 h3 h4 h5 h6 title".split()
#: What is no markup: comments, scripts and styles.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG = r"</?[A-Za-z][A-Za-z0-9]*"


def tags(pages: DataFrame) -> DataFrame:
    """page_id, k (from 0), tag, side (1 opens a holder, -1 closes one, 0 a leaf) of pages (page_id, html); closing tags of leaves are left out. Null pages have none."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, ""), F.lit(TAG), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("k", "mark")).withColumn("tag", F.lower(F.regexp_replace("mark", "[</]", "")))
    holder, close = F.col("tag").isin(HOLDERS), F.startswith("mark", F.lit("</"))
    return rows.where(holder | ~close).select("page_id", "k", "tag", F.when(~holder, 0).when(close, -1).otherwise(1).alias("side"))


def nested(marks: DataFrame) -> DataFrame:
    """page_id, k, tag, depth (from 1), parent (a k, or null) of the elements of marks (page_id, k, tag, side).

    An element's parent is the last holder before it that is one level less deep: a running sum gives levels, and each
    level of a page is one ordered pass. More closing than opening tags count as if none were open.
    """
    w = Window.partitionBy("page_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    total = marks.withColumn("sum", F.sum("side").over(w))
    # what closes nothing is given back by the lowest sum so far
    level = total.withColumn("level", F.col("sum") - F.least(F.min("sum").over(w), F.lit(0)))
    open_ = level.where("side >= 0").withColumn("depth", (F.col("level") + F.when(F.col("side") == 0, 1).otherwise(0)).cast("int"))
    own = open_.where("side = 1").select("page_id", F.col("depth").alias("at"), "k", F.col("k").alias("holder"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("int").alias("depth"))
    asks = open_.select("page_id", (F.col("depth") - 1).alias("at"), "k", F.lit(None).cast("int").alias("holder"), "tag", "depth")
    by = Window.partitionBy("page_id", "at").orderBy("k", F.col("depth").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = own.unionByName(asks).withColumn("parent", F.last("holder", ignorenulls=True).over(by)).where("depth IS NOT NULL")
    return met.select("page_id", "k", "tag", "depth", F.when(F.col("depth") > 1, F.col("parent")).alias("parent"))


def inherited(nodes: DataFrame, group: str, node: str, parent: str, value: str) -> DataFrame:
    """nodes with `value` from the nearest ancestor that has one where they have none.

    Pointers double: each round a node without a value takes its pointer's value, or else that one's pointer, so the rounds are the
    logarithm of the depth. A pointer to nothing ends the search. Files of such numbers are far smaller than their rows, so their size must not choose a broadcast.
    """
    at = written(nodes.select(group, node, F.col(parent).alias("up"), value))
    while not at.where(f"`{value}` IS NULL AND up IS NOT NULL").isEmpty():
        higher = at.select(group, F.col(node).alias("up"), F.col("up").alias("higher"), F.col(value).alias("theirs"), F.lit(True).alias("there"))
        step = at.join(higher.hint("merge"), [group, "up"], "left").select(group, node, F.when(F.col(value).isNull() & F.col("theirs").isNull() & F.col("there"), F.col("higher")).alias("up"), F.coalesce(value, "theirs").alias(value))
        before, at = at, written(step)
        forget(before)
    return nodes.drop(value).join(at.select(group, node, value).hint("merge"), [group, node])


def element_trees(pages: DataFrame) -> DataFrame:
    """page_id, k, tag, depth, parent, heading: the elements of every page, each with the k of the nearest heading: the last among its elder siblings, else that of its parent."""
    tree = nested(tags(pages))
    elder = Window.partitionBy("page_id", "parent").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.rlike("tag", F.lit("^h[1-6]$")), F.col("k")), ignorenulls=True).over(elder)
    return inherited(tree.withColumn("heading", own), "page_id", "k", "parent", "heading").select("page_id", "k", "tag", "depth", "parent", "heading")
