"""Reprocessing: what became of facts when the spans below them were read again, some entities having become others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fact_delta(before: DataFrame, after: DataFrame, moves: DataFrame) -> DataFrame:
    """change, old_fact, new_fact, sources: every fact of either table with what became of it.

    before and after: fact, predicate, subject, object; moves: old, new, entities that are others now (of several the least). An old fact's ends are moved first. It is LOST if no new fact has its predicate and ends;
    MERGED if facts of several old ids have come to one new fact and it is not one of them as it was; MOVED if an end moved; KEPT if none did. New facts that no old one comes to are GAINED. sources is the
    number of distinct old facts that come to the new one.

    Repeated rows count once; null ends equal each other; everything meets by keys.
    """
    to = moves.where("old <> new").groupBy("old").agg(F.min("new").alias("new"))
    old = before.select("fact", "predicate", "subject", "object").distinct()
    for end in ("subject", "object"):
        old = old.join(to.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}")), end, "left").withColumn(f"to_{end}", F.coalesce(f"new_{end}", end))
    old = old.select(F.col("fact").alias("old_fact"), F.col("predicate"), F.col("to_subject").alias("s"), F.col("to_object").alias("o"), (F.col("new_subject").isNotNull() | F.col("new_object").isNotNull()).alias("moved"))
    new = after.select(F.col("fact").alias("new_fact"), F.col("predicate").alias("p"), F.col("subject").alias("ns"), F.col("object").alias("no")).distinct()
    met = old.join(new, F.col("predicate").eqNullSafe(F.col("p")) & F.col("s").eqNullSafe(F.col("ns")) & F.col("o").eqNullSafe(F.col("no")), "full")
    # old facts that come to none are spread by their ids, not gathered under null
    own = Window.partitionBy("new_fact", F.when(F.col("new_fact").isNull(), F.col("old_fact")))
    rows = met.withColumn("n", F.max(F.when(F.col("new_fact").isNotNull() & F.col("old_fact").isNotNull(), F.dense_rank().over(own.orderBy(F.desc_nulls_last("old_fact"))))).over(own))
    change = (
        F.when(F.col("old_fact").isNull(), "GAINED").when(F.col("new_fact").isNull(), "LOST").when(F.col("moved") & (F.col("n") > 1), "MERGED").when(F.col("moved"), "MOVED").otherwise("KEPT")
    )
    return rows.select(change.alias("change"), "old_fact", "new_fact", F.coalesce("n", F.lit(0)).cast("long").alias("sources"))


def delta_counts(delta: DataFrame) -> DataFrame:
    """change, facts, targets: how many old or new facts had each change, and to how many new facts they came."""
    return delta.groupBy("change").agg(F.count("*").alias("facts"), F.count_distinct("new_fact").alias("targets"))
