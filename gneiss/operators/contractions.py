"""Shorter forms of names within a document: each joins the only longer form that contains it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inner words of a name up to which all of its shorter forms are listed; longer names meet by their ends.
INNER = 8
PREFIX, ELISION = "anchor-prefix", "head-preserving elision"


def name_tokens(surface: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(surface, F.lit(""))), F.lit("[a-z0-9][a-z0-9-]*"), F.lit(0))


def _forms(t: Column) -> Column:
    """(form, shape) of what a name may be shortened to: its proper beginnings, and what keeps its first and last word with some of the others in order."""
    n = F.size(t)
    starts = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(F.lit(0).alias("order"), F.array_join(F.slice(t, F.lit(1), k), " ").alias("form")))
    inner = F.slice(t, F.lit(2), F.greatest(n - 2, F.lit(0)))
    some = lambda mask: F.filter(inner, lambda w, i: F.call_function("shiftright", mask, i).bitwiseAND(1) == 1)
    masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.least(n - 2, F.lit(INNER))) - 2)
    ends = F.transform(masks, lambda m: F.struct(F.lit(1).alias("order"), F.array_join(F.concat(F.slice(t, F.lit(1), F.lit(1)), some(m), F.slice(t, n, F.lit(1))), " ").alias("form")))
    none = F.expr("cast(array() as array<struct<order: int, form: string>>)")
    return F.concat(F.when(n > 1, starts).otherwise(none), F.when((n > 2) & (n - 2 <= INNER), ends).otherwise(none))


def resolved(names: DataFrame, group: str = "doc_id") -> DataFrame:
    """names (group, surface, type) once each with decision, resolved_to, shape, candidates: SAME_ENTITY with the only longer name of the group and type that contains it, else ABSTAIN.

    A longer name contains a shorter one that it begins with, or that keeps its first and last word and some of the words between, in order. Every name lists its shorter
    forms, so that names meet by equality; names of over INNER inner words list their beginnings and meet the rest by their ends. Several longer names are ambiguous: none is
    chosen. Names without words abstain; nulls count as empty; equal words in other spellings are one name's forms, not each other's.
    """
    rows = names.select(group, F.coalesce("surface", F.lit("")).alias("surface"), "type").distinct().withColumn("t", name_tokens(F.col("surface"))).withColumn("form", F.array_join("t", " "))
    listed = rows.select(group, "type", F.col("surface").alias("longer"), F.explode(_forms(F.col("t"))).alias("f")).select(group, "type", "longer", "f.order", "f.form")
    met = rows.where(F.size("t") > 0).join(listed, [group, "type", "form"]).select(group, "surface", "type", "longer", "order")
    first, last = (lambda c: F.get(c, F.lit(0))), (lambda c: F.element_at(c, -1))
    long = rows.where(F.size("t") > INNER + 2).select(group, "type", F.col("surface").alias("longer"), F.col("t").alias("lt"), first(F.col("t")).alias("a"), last(F.col("t")).alias("b"))
    short = rows.where(F.size("t") > 1).select(group, "type", "surface", "t", first(F.col("t")).alias("a"), last(F.col("t")).alias("b"))
    walk = F.aggregate("t", F.lit(0), lambda at, w: F.when(at < 0, at).otherwise(F.when(F.array_position(F.slice("lt", at + 1, F.greatest(F.size("lt") - at, F.lit(0))), w) > 0, (at + F.array_position(F.slice("lt", at + 1, F.greatest(F.size("lt") - at, F.lit(0))), w)).cast("int")).otherwise(-1)))
    by_ends = short.join(long, [group, "type", "a", "b"]).where((F.size("t") < F.size("lt")) & (walk >= 0)).select(group, "surface", "type", "longer", F.lit(1).alias("order"))
    best = met.unionByName(by_ends).groupBy(group, "surface", "type").agg(F.array_sort(F.collect_set("longer")).alias("candidates"), F.min("order").alias("order"))
    out = rows.select(group, "surface", "type").join(best, [group, "surface", "type"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    one = F.size("candidates") == 1
    return out.select(
        group, "surface", "type", F.when(one, "SAME_ENTITY").otherwise("ABSTAIN").alias("decision"), F.when(one, F.get("candidates", F.lit(0))).alias("resolved_to"),
        F.when(one, F.when(F.col("order") == 0, PREFIX).otherwise(ELISION)).alias("shape"), "candidates",
    )
