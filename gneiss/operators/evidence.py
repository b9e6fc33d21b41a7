"""Claims, what supports them, what competes with them, and answers that cite them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions.text import content_tokens

#: Characters of an excerpt.
WIDTH = 240


def excerpt(passage: Column, terms: Column, width: int = WIDTH) -> Column:
    """A window of about `width` characters around the first place of the rarest of the terms (longest, then first, among equals), whole words; without one the head."""
    return _once(_rarest_at(F.lower(F.coalesce(passage, F.lit(""))), terms), lambda at: _window(passage, at, width))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(T.IntegerType())
def _rarest_at(low: pd.Series, terms: pd.Series) -> pd.Series:
    """Where the first place of the rarest of the terms of over three characters begins, from 0, or -1."""
    out = []
    for text, own in zip(low, terms):
        long = [t for t in (own if own is not None else ()) if t is not None and len(t) > 3]
        out.append(text.find(min(long, key=lambda t: (text.count(t), -len(t), t))) if long else -1)
    return pd.Series(out, dtype="int32")


def _window(passage: Column, at: Column, width: int) -> Column:
    n = F.length(passage)
    last = F.least(n, F.greatest(F.lit(0), at - width // 2) + width)
    first = F.greatest(F.lit(0), last - width)
    # back to the white space before, on to the one behind
    lead = F.length(F.regexp_extract(F.substring(passage, F.lit(1), first), r"[^ \n\t]*\z", 0)) + F.when((first > 0) & ~F.rlike(F.substring(passage, first + 1, F.lit(1)), F.lit(r"[ \n\t]")), 1).otherwise(0)
    begin = F.greatest(F.lit(0), F.when(F.rlike(F.substring(passage, first + 1, F.lit(1)), F.lit(r"[ \n\t]")), first).otherwise(first - lead))
    rest = F.substring(passage, last + 1, n - last)
    stop = last + F.length(F.regexp_extract(rest, r"\A[^ \n\t]*", 0))
    trim = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return F.when(at < 0, trim(F.substring(passage, 1, width))).otherwise(trim(F.substring(passage, begin + 1, stop - begin)))


def validated(claims: DataFrame, support: DataFrame) -> DataFrame:
    """claims (claim_id, text, lane) and support (claim_id, item_id, lane, text, known) to claim_id, status, reason, items.

    A graph claim holds if its tokens all stand in its items together; a text claim if one item has it word for word, in any case. Without items, with an item that is not
    known, or with items of another lane it is unsupported.
    """
    held = support.groupBy("claim_id").agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"), F.collect_set("lane").alias("lanes"),
        F.array_sort(F.collect_set("item_id")).alias("items"), F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"),
    )
    met = claims.join(held, "claim_id", "left")
    words = content_tokens(F.col("text"))
    graph = (F.size(words) > 0) & (F.size(F.array_except(words, content_tokens(F.array_join("texts", " ")))) == 0)
    text = F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S")) & F.exists("texts", lambda t: F.contains(F.lower(t), F.lower("text")))
    ok = F.when(F.col("lane") == "graph", graph).otherwise(text)
    reason = (
        F.when(F.col("n").isNull(), "NO_SUPPORT").when(~F.col("known"), "MISSING_ITEM").when((F.size("lanes") != 1) | (F.col("lanes")[0] != F.col("lane")), "MIXED_LANES").when(ok, "SUPPORTED").otherwise("NOT_GROUNDED")
    )
    return met.withColumn("reason", reason).select("claim_id", F.when(F.col("reason") == "SUPPORTED", "supported").otherwise("unsupported").alias("status"), "reason", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def numbered_citations(claims: DataFrame) -> DataFrame:
    """Supported claims (query_id, place, claim_id, text, item_id, lane) with the number of their first item: items are numbered by first use, graph claims come first."""
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("lane") == "graph", 0).otherwise(1), "place", "claim_id")
    placed = claims.withColumn("nth", F.row_number().over(order))
    first = placed.groupBy("query_id", "item_id").agg(F.min("nth").alias("first"))
    numbers = first.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    return placed.join(numbers.drop("first"), ["query_id", "item_id"])


def answers(queries: DataFrame, claims: DataFrame) -> DataFrame:
    """query_id, answer, citations: each query's supported claims as sentences with numbers of their items; abstained is true without any."""
    line = F.concat(F.col("text"), F.lit(" ["), F.col("number"), F.lit("]"))
    by_query = numbered_citations(claims).groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), " ").alias("answer"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("number", "item_id"))), lambda x: x["item_id"]), ",").alias("citations"),
    )
    return queries.select("query_id").join(by_query, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("citations", F.lit("")).alias("citations"), F.col("answer").isNull().alias("abstained"))
