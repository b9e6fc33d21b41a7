"""Facts as edges: endpoints, eligibility, one-hop expansion, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.storage import written


def endpoints(facts: DataFrame) -> DataFrame:
    """One row for each end of a fact (an OR-join as an equi-join); a loop has one."""
    return facts.select("*", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))


def eligible(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts both of whose ends are known entities that may be in the graph."""
    ok = entities.where("admission is distinct from 'MENTION_ONLY'").select("entity")
    return facts.join(ok.withColumnRenamed("entity", "subject"), "subject", "left_semi").join(ok.withColumnRenamed("entity", "object"), "object", "left_semi")


def hop(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, and every fact at either end of it, once."""
    out = facts.join(seeds.withColumnRenamed("seed", "subject"), "subject", "left_semi").withColumn("seed", F.col("subject"))
    back = facts.join(seeds.withColumnRenamed("seed", "object"), "object", "left_semi").withColumn("seed", F.col("object"))
    return out.unionByName(back).dropDuplicates(["seed", "fact"])


def conflicts(facts: DataFrame) -> DataFrame:
    """Facts that compete: one predicate and object with several subjects, or one ordered pair with several predicates.

    The sizes of what each competes with, not all pairs.
    """
    whole = facts.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    return _varied(_varied(whole, ["predicate", "object"], "subject", "subjects"), ["subject", "object"], "predicate", "predicates").where("subjects > 1 or predicates > 1")


def _varied(rows: DataFrame, keys: list[str], of: str, name: str) -> DataFrame:
    """rows with the number of distinct values of a column among those of equal keys, in one ordered pass: the last rank without gaps."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn(name, F.dense_rank().over(by.orderBy(of)))
    return ranked.withColumn(name, F.last(name).over(by.orderBy(of).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("long"))


def surface_seeds(queries: DataFrame, entities: DataFrame, most_terms: int = 12, most: int = 8) -> DataFrame:
    """query_id, entity, rank: the entities (entity, surface, preferred) whose surface holds one of a query's terms or is held by one, preferred ones first, then by id.

    queries: query_id, terms (an array; its first most_terms distinct ones count). Distinct surfaces meet distinct terms once, by grams of the shorter; of each surface only its first
    `most` entities can be among a query's.
    """
    terms = queries.select("query_id", F.explode(F.slice(F.array_distinct("terms"), 1, most_terms)).alias("term")).where("term <> ''")
    best = Window.partitionBy("surface").orderBy(F.desc("preferred"), "entity")
    few = entities.where("surface <> ''").withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).drop("n")
    key = lambda c: F.substring(c, 1, 3)
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(c) - i + 1)), lambda n: F.substring(c, i, n)))))
    t, s = terms.select(F.lower("term").alias("t"), "term").distinct(), few.select(F.lower("surface").alias("s"), "surface").distinct()
    held = s.withColumn("gram", F.explode(grams(F.col("s")))).join(t.withColumn("gram", key("t")), "gram").where(F.contains("s", "t"))
    holds = t.withColumn("gram", F.explode(grams(F.col("t")))).join(s.withColumn("gram", key("s")), "gram").where(F.contains("t", "s"))
    met = held.select("term", "surface").unionByName(holds.select("term", "surface")).distinct()
    found = terms.join(met, "term").select("query_id", "surface").distinct().join(few, "surface").select("query_id", "entity", "preferred").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("preferred"), "entity")) - 1)
    return ranked.where(F.col("rank") < most).select("query_id", "entity", "rank")


def authorized(facts: DataFrame, evidence: DataFrame, scope: DataFrame) -> DataFrame:
    """facts (fact, ...) with evidence (fact, doc_id) in documents of the scope (doc_id), or without any evidence at all."""
    inside = evidence.join(scope.select("doc_id"), "doc_id", "left_semi").select("fact")
    outside = evidence.select("fact").distinct().join(inside.distinct(), "fact", "left_anti")
    return facts.join(outside, "fact", "left_anti")


def expansion(seeds: DataFrame, facts: DataFrame, most: int = 20) -> DataFrame:
    """query_id, fact, rank: of each query the first `most` facts, by id, at either end of its seeds (query_id, entity). A seed gives its first `most` only, which suffices."""
    at = endpoints(facts.select("fact", "subject", "object")).join(seeds.select("entity").distinct(), "entity", "left_semi")
    few = at.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("fact"))).where(F.col("n") <= most).select("entity", "fact")
    found = seeds.select("query_id", "entity").join(few, "entity").select("query_id", "fact").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("fact")) - 1).where(F.col("rank") < most)


def residue(facts: DataFrame, evidence: DataFrame, retired: DataFrame) -> DataFrame:
    """What goes with retired documents (doc_id), as kind and id: facts all of whose evidence (fact, doc_id) is in them, and entities all of whose facts go. A dry run."""
    marked = evidence.select("fact", "doc_id").join(retired.select("doc_id").distinct().withColumn("retired", F.lit(True)), "doc_id", "left")
    ends = marked.groupBy("fact").agg(F.bool_and(F.coalesce("retired", F.lit(False))).alias("gone"))
    judged = written(facts.select("fact", "subject", "object").join(ends, "fact", "left").withColumn("gone", F.coalesce("gone", F.lit(False))))
    lost = endpoints(judged).where("entity IS NOT NULL").groupBy("entity").agg(F.bool_and("gone").alias("gone"))
    named = lambda df, kind: df.where("gone").select(F.lit(kind).alias("kind"), F.col(kind).alias("id"))
    return named(judged, "fact").unionByName(named(lost, "entity"))
