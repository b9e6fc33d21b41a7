"""The structure of plain and Markdown texts: headings, regions, the parts of regions that a chunk has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What begins a fence, a heading, a list item and a table row; what underlines a heading.
FENCE, ATX, ITEM, ROW, UNDERLINE = r"^\s{0,3}(```|~~~)", r"^\s{0,3}#{1,6}\s+\S", r"^\s*(?:[-*+]|\d+[.)])\s+\S", r"^\s*\|.*\|\s*$", r"^\s{0,3}(=+|-{2,})\s*$"


def lines_at(docs: DataFrame) -> DataFrame:
    """doc_id, n, start, end, line: each line of a text with its place."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("n")) - 1
    return rows.select("doc_id", "n", (upto - F.length("line")).alias("start"), upto.alias("end"), "line")


def _kinds(docs: DataFrame) -> DataFrame:
    """lines_at with fenced (is the line in a code block, its fences included) and kind."""
    by = Window.partitionBy("doc_id").orderBy("n")
    fence = F.rlike("line", F.lit(FENCE))
    marked = lines_at(docs).withColumn("fences", F.sum(fence.cast("int")).over(by))
    marked = marked.withColumn("fenced", fence | (F.pmod(F.col("fences"), F.lit(2)) == 1)).withColumn("next", F.lead("line").over(by)).withColumn("before", F.lag("line").over(by)).withColumn("before_fenced", F.lag("fenced").over(by))
    text = F.rlike("line", F.lit(r"\S"))
    special = lambda c: F.rlike(c, F.lit(ATX)) | F.rlike(c, F.lit(ITEM)) | F.rlike(c, F.lit(ROW))
    underlined = text & ~special("line") & F.coalesce(F.rlike("next", F.lit(UNDERLINE)), F.lit(False)) & ~F.rlike("line", F.lit(UNDERLINE))
    underline = F.rlike("line", F.lit(UNDERLINE)) & F.coalesce(F.rlike("before", F.lit(r"\S")) & ~special("before") & ~F.col("before_fenced") & ~F.rlike("before", F.lit(UNDERLINE)), F.lit(False))
    kind = (
        F.when(F.col("fenced"), "code").when(~text, "blank").when(F.rlike("line", F.lit(ATX)) | underlined | underline, "heading")
        .when(F.rlike("line", F.lit(ROW)), "table").when(F.rlike("line", F.lit(ITEM)), "list").otherwise("prose")
    )
    return marked.withColumn("kind", kind)


def regions(docs: DataFrame) -> DataFrame:
    """doc_id, region, kind, start, end: runs of lines of one kind (heading, code, table, list, prose); blank lines end a run; a new ATX heading or a new fence begins one."""
    by = Window.partitionBy("doc_id").orderBy("n")
    rows = _kinds(docs).withColumn("last", F.lag("kind").over(by)).withColumn("last_fences", F.lag("fences").over(by))
    opens = F.rlike("line", F.lit(FENCE)) & (F.pmod(F.col("fences"), F.lit(2)) == 1)
    fresh = F.coalesce(F.col("kind") != F.col("last"), F.lit(True)) | opens | ((F.col("kind") == "heading") & ~F.rlike("line", F.lit(UNDERLINE)))
    numbered = rows.withColumn("run", F.sum(fresh.cast("int")).over(by)).where("kind <> 'blank'")
    runs = numbered.groupBy("doc_id", "run", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.withColumn("region", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).select("doc_id", "region", "kind", "start", "end")


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, start, level, title of ATX and underlined headings outside code."""
    by = Window.partitionBy("doc_id").orderBy("n")
    rows = _kinds(docs).withColumn("under", F.lead("line").over(by)).where(F.col("kind") == "heading").where(~F.rlike("line", F.lit(UNDERLINE)))
    atx = F.rlike("line", F.lit(ATX))
    level = F.when(atx, F.length(F.regexp_extract("line", r"^\s{0,3}(#{1,6})", 1))).when(F.rlike("under", F.lit("^\\s*=")), 1).otherwise(2)
    title = F.regexp_replace(F.regexp_replace("line", r"^\s{0,3}#{1,6}\s+", ""), r"\s*#*\s*$", "")
    return rows.select("doc_id", "start", level.alias("level"), F.trim(F.when(atx, title).otherwise(F.col("line"))).alias("title"))


def projected(parts: DataFrame, windows: DataFrame) -> DataFrame:
    """parts (doc_id, kind, start, end) clipped to windows (doc_id, window, start, end) and moved to begin with them: doc_id, window, kind, start, end.

    A part and a window meet by cells of 1024 characters that both touch, each pair once.
    """
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / 1024), F.floor(F.greatest("start", F.col("end") - 1) / 1024))))
    p, w = cells(parts).alias("p"), cells(windows).alias("w")
    low, high = F.greatest("p.start", "w.start"), F.least("p.end", "w.end")
    met = p.join(w, (F.col("p.doc_id") == F.col("w.doc_id")) & (F.col("p.cell") == F.col("w.cell"))).where((low < high) & (F.floor(low / 1024) == F.col("p.cell")))
    return met.select("p.doc_id", "w.window", "p.kind", (low - F.col("w.start")).alias("start"), (high - F.col("w.start")).alias("end"))
