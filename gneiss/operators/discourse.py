"""Folds along documents: what has been named before each place, and what a definite description there refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A definite description of up to three words, words for organisations, ordinals.
DESCRIPTION = r"\b[Tt]he [a-z][a-z0-9]*(?: [a-z0-9]+){0,2}\b"
ORGANIZATIONS = "company firm business organization vendor retailer startup provider operator maker".split()
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5}


def named_before(mentions: DataFrame, places: DataFrame, by: list[str], order: list[str], thing: str = "surface") -> DataFrame:
    """places with seen, the number of distinct things that were mentioned before in their group, and only, the thing if it is one alone.

    mentions: by, order, thing; places: by, order and more. A fold along each group: a thing counts at its first mention, a running sum is the state, and
    Spark streams the group's rows through it, spilling if they are many. Groups are as fine as `by` makes them: with the
    head of a name in it a long document is as many groups as it has heads.
    """
    own = [c for c in places.columns if c not in by and c not in order]
    firsts = mentions.groupBy(*by, thing).agg(F.min(F.struct(*order)).alias("o")).select(*by, "o.*", F.col(thing).alias("thing"), F.lit(0).alias("kind"))
    every = firsts.withColumn("own", F.lit(None).cast(places.select(F.struct(*own).alias("x")).schema["x"].dataType)).unionByName(places.select(*by, *order, F.lit(None).cast("string").alias("thing"), F.lit(1).alias("kind"), F.struct(*own).alias("own")))
    # at one place a mention doesn't come before a description
    w = Window.partitionBy(*by).orderBy(*order, F.desc("kind"), "thing").rowsBetween(Window.unboundedPreceding, 0)
    met = every.withColumn("seen", F.count("thing").over(w)).withColumn("last", F.last("thing", ignorenulls=True).over(w))
    return met.where("kind = 1").select(*by, *order, "own.*", "seen", F.when(F.col("seen") == 1, F.col("last")).alias("only"))


def nth_named(mentions: DataFrame, by: list[str], order: list[str], thing: str = "surface") -> DataFrame:
    """by, nth (from 1), thing, order of its first mention: the distinct things of each group in the order in which they came."""
    firsts = mentions.groupBy(*by, thing).agg(F.min(F.struct(*order)).alias("o"))
    return firsts.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("o", thing))).select(*by, "nth", thing, "o.*")


def head(surface: Column) -> Column:
    """The last word, in lower case."""
    return F.lower(F.regexp_extract(surface, r"(\S+)\s*\z", 1))


def antecedents(entities: DataFrame, descriptions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """descriptions (key, order, mark: "the ..." ) with head, rule, seen, antecedent: what of the entities (key, order, surface, type) before it a description refers to.

    With an ordinal as its second word ORDINAL: the nth entity with that head, if it was named before. With a word for organisations UNIQUE_ORGANIZATION: the only entity
    of type Organization before it, and of several none. Otherwise UNIQUE_HEAD: the only entity before it with the same last word. No or several
    entities leave the antecedent null: a description never names a new thing and never guesses.

    Entities are told apart by their lower-case surfaces; null surfaces and marks are left out; a mention at the description's own place is not before it.
    """
    named = entities.where("surface IS NOT NULL").select(key, *order, F.lower("surface").alias("surface"), "type").withColumn("head", head(F.col("surface")))
    asked = descriptions.where("mark IS NOT NULL").withColumn("head", head(F.col("mark")))
    nth = F.coalesce(*(F.when(F.lower(F.split("mark", r"\s+")[1]) == word, n) for word, n in ORDINALS.items())).alias("nth")
    asked = asked.select("*", nth)
    ordinal = asked.where("nth IS NOT NULL").join(nth_named(named, [key, "head"], order).select(key, "head", "nth", F.col("surface").alias("found"), F.struct(*order).alias("o")), [key, "head", "nth"], "left")
    before = F.coalesce(F.col("o") < F.struct(*order), F.lit(False))
    plain = asked.where("nth IS NULL")
    company = F.col("head").isin(ORGANIZATIONS)
    own = [c for c in descriptions.columns if c not in (key, *order)]
    by_head = named_before(named.select(key, "head", *order, "surface"), plain.where(~company).select(key, "head", *order, *own), [key, "head"], order)
    by_type = named_before(named.where("type = 'Organization'").select(key, *order, "surface"), plain.where(company).select(key, *order, "head", *own), [key], order)
    row = lambda df, rule, seen, found: df.select(key, *order, *own, "head", F.lit(rule).alias("rule"), seen.cast("long").alias("seen"), found.alias("antecedent"))
    return (
        row(by_head, "UNIQUE_HEAD", F.col("seen"), F.col("only")).unionByName(row(by_type, "UNIQUE_ORGANIZATION", F.col("seen"), F.col("only")))
        .unionByName(row(ordinal, "ORDINAL", before.cast("int"), F.when(before, F.col("found"))))
    )
