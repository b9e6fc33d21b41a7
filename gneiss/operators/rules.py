"""Rules over candidates: gates in order, of which the first that fails is the reason, and facts with content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import content_id
from gneiss.functions.values import first_year
from gneiss.operators.spans import modality

#: A past participle between an auxiliary and "by".
PASSIVE = r"(?i)\b(?:is|are|was|were|been|being)\s+(?:\w+\s+)?\w+(?:ed|en)\s+by\b"


def passive(sentence: Column) -> Column:
    return F.rlike(F.coalesce(sentence, F.lit("")), F.lit(PASSIVE))


def validate_pack(rules: DataFrame) -> DataFrame:
    """predicate, problem, detail: what is wrong with a pack of rules (see compiled), a row each; none if it is sound.

    EMPTY: a rule without predicate, class, trigger or type; OVERLAP: a class, trigger and signature of several predicates, which can only be ambiguous; ASYMMETRIC: a symmetric predicate
    with a signature whose inverse it lacks; MIXED: a predicate that is symmetric in some rows only.
    """
    keys = ["evidence_class", "trigger", "subject_type", "object_type"]
    r = rules.distinct()
    row = lambda df, problem, detail: df.select("predicate", F.lit(problem).alias("problem"), detail.alias("detail"))
    named = F.concat_ws("|", *keys)
    empty = F.exists(F.array("predicate", *keys), lambda c: F.coalesce(c, F.lit("")) == "")
    several = r.groupBy(*keys).agg(F.array_sort(F.collect_set("predicate")).alias("ps")).where(F.size("ps") > 1)
    overlap = several.select(F.explode("ps").alias("predicate"), *keys)
    back = r.select("predicate", "evidence_class", "trigger", F.col("object_type").alias("subject_type"), F.col("subject_type").alias("object_type"))
    lone = r.where("symmetric").join(back, ["predicate", *keys], "left_anti")
    mixed = r.groupBy("predicate").agg(F.count_distinct(F.coalesce("symmetric", F.lit(False))).alias("n")).where("n > 1")
    return row(r.where(empty), "EMPTY", named).unionByName(row(overlap, "OVERLAP", named)).unionByName(row(lone, "ASYMMETRIC", named)).unionByName(row(mixed, "MIXED", F.lit(""))).distinct()


def compiled(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates to candidate, decision, reason, predicate, subject, object, qualifiers, year, fact_id: one row each.

    candidates: candidate, evidence_class, trigger, predicate (null if the trigger belongs to no rule in particular), subject, subject_type, object, object_type, scope (of spans.scope), passive,
    sentence, and null or admission classes subject_class, object_class. rules: predicate, evidence_class, trigger, subject_type, object_type, symmetric.

    In order: scope (REJECT); an endpoint that is missing or a mere mention (REJECT); a trigger that no rule of the class has (UNSUPPORTED); a passive
    sentence turns the pair round, then no rule accepts the types (REJECT), or several predicates do (AMBIGUOUS); a fact about itself (REJECT). The rest are facts: ACCEPT, or QUALIFY with
    qualifiers from the scope. A symmetric predicate has its ends in order of their names. Rules join by equality; Spark broadcasts them if they are small.
    """
    pack = rules.groupBy("evidence_class", "trigger", "subject_type", "object_type", "predicate").agg(F.coalesce(F.bool_or("symmetric"), F.lit(False)).alias("symmetric"))
    signed = pack.groupBy("evidence_class", "trigger", F.col("subject_type").alias("__a"), F.col("object_type").alias("__b")).agg(F.array_sort(F.collect_set(F.struct("predicate", "symmetric"))).alias("__rules"))
    known = pack.groupBy("evidence_class", "trigger").agg(F.collect_set("predicate").alias("__known"))
    turned = F.coalesce("passive", F.lit(False))
    turn = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    met = candidates.withColumn("__a", turn("subject_type", "object_type")).withColumn("__b", turn("object_type", "subject_type")).join(known, ["evidence_class", "trigger"], "left").join(signed, ["evidence_class", "trigger", "__a", "__b"], "left")
    fits = F.coalesce(F.filter("__rules", lambda r: F.col("predicate").isNull() | (r["predicate"] == F.col("predicate"))), F.array().cast(signed.schema["__rules"].dataType))
    gate = modality(F.col("scope"))
    mention = F.coalesce((F.col("subject_class") == "MENTION_ONLY") | (F.col("object_class") == "MENTION_ONLY"), F.lit(False))
    has = F.coalesce(F.when(F.col("predicate").isNull(), F.size("__known") > 0).otherwise(F.array_contains("__known", F.col("predicate"))), F.lit(False))
    held = met.select(
        "candidate", "scope", "sentence", gate.alias("gate"), mention.alias("mention"), has.alias("has"), fits.alias("fits"), turned.alias("turned"), (F.col("subject").isNull() | F.col("object").isNull()).alias("gone"),
        turn("subject", "object").alias("a"), turn("object", "subject").alias("b"),
    )
    reason = (
        F.when(F.startswith("gate", F.lit("REJECT")), F.col("gate")).when(F.col("gone"), "ENDPOINT_UNAVAILABLE").when(F.col("mention"), "ENDPOINT_MENTION_ONLY").when(~F.col("has"), "TRIGGER_UNKNOWN")
        .when(F.size("fits") == 0, "SIGNATURE_MISMATCH").when(F.size("fits") > 1, "SEVERAL_PREDICATES").when(F.col("a") == F.col("b"), "SELF_EDGE").otherwise("ACCEPTED")
    )
    decision = F.when(F.col("reason") == "ACCEPTED", F.col("gate")).when(F.col("reason") == "TRIGGER_UNKNOWN", "UNSUPPORTED").when(F.col("reason") == "SEVERAL_PREDICATES", "AMBIGUOUS").otherwise("REJECT")
    ok, rule = F.col("reason") == "ACCEPTED", F.get("fits", F.lit(0))
    judged = held.withColumn("reason", reason).withColumn("decision", decision).withColumn("swap", F.coalesce(rule["symmetric"] & (F.col("a") > F.col("b")), F.lit(False)))
    s = F.col("scope")
    certainty = F.when(s["hypothetical"], "hypothetical").when(s["speculative"], "speculative")
    qualifiers = F.when(ok, F.struct(certainty.alias("certainty"), F.when(s["attributed"], s["attribution_source"]).alias("attribution_source"), s["attributed"].alias("attributed"), ((F.col("gate") == "QUALIFY") & s["comparison"]).alias("comparison")))
    done = judged.select(
        "candidate", "decision", "reason", F.when(ok, rule["predicate"]).alias("predicate"), F.when(ok, F.when(F.col("swap"), F.col("b")).otherwise(F.col("a"))).alias("subject"), F.when(ok, F.when(F.col("swap"), F.col("a")).otherwise(F.col("b"))).alias("object"),
        qualifiers.alias("qualifiers"), F.when(ok, first_year(F.col("sentence"))).alias("year"),
    )
    q = F.to_json(F.col("qualifiers"))
    return done.withColumn("fact_id", F.when(F.col("decision").isin("ACCEPT", "QUALIFY"), content_id("fact_", o=F.col("object"), p=F.col("predicate"), q=q, s=F.col("subject"))))


def losses(decisions: DataFrame) -> DataFrame:
    """decision, reason, candidates."""
    return decisions.groupBy("decision", "reason").agg(F.count("*").alias("candidates"))
