"""Entity admission from the surface alone, and canonical registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import content_id, normal_surface

#: Heads that name nothing, weak and deictic modifiers, determiners.
GENERIC = "system model platform component service data process application tool framework layer engine node record store index pool pipeline loop task job file database server network device interface module function object event request".split()
WEAK = "real new main other same some any all many several general basic simple various different certain current entire whole particular additional actual so-called own".split()
DEICTIC = "our my your their its this that these those".split()
DETERMINERS = "a an the".split()
#: Types whose equal names are one thing, and types whose equal names may be many.
MERGEABLE = ("Organization", "Location", "Product", "Technology", "Document")
HOMONYMS = ("Person", "Concept", "Event", "Method", "Process", "Measurement", "TimeReference")
VERSION = "canonicalizer-v1"


def reference_class(surface: Column) -> Column:
    """GLOBAL, CORPUS_SCOPED, DOCUMENT_SCOPED or MENTION_ONLY; the first rule that holds decides."""
    words = F.regexp_extract_all(F.coalesce(surface, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9&+.\-/]*"), F.lit(0))
    content = F.filter(words, lambda w: ~F.lower(w).isin(DETERMINERS))
    digits = F.rlike(F.coalesce(surface, F.lit("")), F.lit(r"\d"))
    acronym = F.exists(words, lambda w: F.rlike(w, F.lit("^[A-Z]{2,}$")) & ~F.lower(w).isin(GENERIC))
    proper = F.exists(words, lambda w: F.rlike(w, F.lit("^[A-Z]")) & (F.rlike(w, F.lit("^[A-Za-z]{3,}")) | ~F.rlike(w, F.lit(r"\d"))) & ~F.lower(w).isin(GENERIC))
    versioned = digits & (F.size(words) == 1) & F.exists(words, lambda w: F.rlike(w, F.lit(r"\d")))
    telling = F.size(F.filter(content, lambda w: ~F.lower(w).isin(WEAK + DEICTIC) & ~F.rlike(w, F.lit(r"\d"))))
    n = F.size(content) + F.when(F.size(words) > 0, F.size(F.regexp_extract_all(F.coalesce(surface, F.lit("")), F.lit(r"\d+"), F.lit(0)))).otherwise(0)
    head = F.coalesce(F.try_element_at(content, F.lit(-1)), F.lit(""))
    generic = F.lower(head).isin(GENERIC)
    return (
        F.when(acronym | versioned | proper, "GLOBAL")
        .when(F.exists(content, lambda w: F.lower(w).isin(DEICTIC)) & (n >= 2), "DOCUMENT_SCOPED")
        .when(digits & (n >= 2) & generic, F.when(F.rlike(head, F.lit("^[A-Z]")), "CORPUS_SCOPED").otherwise("MENTION_ONLY"))
        .when(generic & (telling <= 1), "MENTION_ONLY")
        .when(telling >= 2, "CORPUS_SCOPED")
        .otherwise("MENTION_ONLY")
    )


def named_entities(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """entities (entity, core_type, surface) with own_name, name (that of the declared alias's canonical surface, else its own) and declared.

    aliases: canonical, alias (surfaces; declared by a corpus, never guessed). An alias of several canonicals goes by the greatest.
    """
    own = entities.withColumn("own_name", normal_surface(F.col("surface")))
    if aliases is None:
        return own.withColumn("name", F.col("own_name")).withColumn("declared", F.lit(False))
    pairs = aliases.select(normal_surface(F.col("canonical")).alias("canonical"), normal_surface(F.col("alias")).alias("alias"))
    itself = pairs.select("canonical", F.col("canonical").alias("alias"))
    to = pairs.unionByName(itself).groupBy(F.col("alias").alias("own_name")).agg(F.max("canonical").alias("canonical"))
    declared = pairs.select(F.col("canonical").alias("name"), F.lit(True).alias("is")).distinct()
    met = own.join(to, "own_name", "left").withColumn("name", F.coalesce("canonical", "own_name")).drop("canonical")
    return met.join(declared, "name", "left").withColumn("declared", F.coalesce("is", F.lit(False))).drop("is")


def registry(entities: DataFrame, corpus: str, aliases: DataFrame | None = None) -> DataFrame:
    """entities (entity, core_type, surface) with normal name, canonical id, decision, basis and the group's first member and size.

    Equal names of a mergeable type are one canonical entity, and so are those of other known types whose name is declared; of others each stays alone, and no name
    is ever a name in common. Members are told by their group's first member and size rather than by all pairs, which follow from them.
    """
    named = named_entities(entities, aliases)
    groups = named.groupBy("name", "core_type").agg(F.min("entity").alias("first_member"), F.count("*").alias("members"))
    known = F.coalesce(F.col("core_type").isin(*MERGEABLE, *HOMONYMS), F.lit(False))
    mergeable = F.coalesce(F.col("core_type").isin(*MERGEABLE), F.lit(False))
    empty, alone, alias = F.col("name") == "", F.col("members") == 1, F.col("own_name") != F.col("name")
    merges = ~empty & (mergeable | (known & F.col("declared")))
    scope = F.when(merges, F.lit("")).otherwise(F.col("entity").cast("string"))
    decision = F.when(empty, "UNRESOLVED").when(merges & ~alone & alias, "ALIAS_OF").when(merges & ~alone, "SAME_AS").otherwise("SELF")
    basis = (
        F.when(empty, "empty_surface").when(merges & alone, "singleton").when(merges & (alias | ~mergeable), "explicit_source_alias")
        .when(merges, "normalized_exact_match,compatible_core_type,mergeable_type_class").when(known, "homonym_risk_type_class").otherwise("unknown_core_type")
    )
    joined = named.join(groups.withColumn("__type", F.col("core_type")).drop("core_type").withColumnRenamed("name", "__name"), (F.col("name") == F.col("__name")) & F.col("core_type").eqNullSafe(F.col("__type")))
    return joined.select(
        "entity", "core_type", "name", content_id("cent_", c=F.lit(corpus), e=scope, n=F.col("name"), t=F.col("core_type"), v=F.lit(VERSION)).alias("canonical_id"),
        decision.alias("decision"), basis.alias("basis"), "first_member", "members",
    )


def group_decisions(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """name, core_type, other_type, decision, pairs, first_member, other_member: what holds between all members of a group (one name and type), or of two groups of one name and different types.

    SAME_AS or ALIAS_OF in a group that merges, AMBIGUOUS where names may be many things, UNRESOLVED where the type is unknown, DISTINCT between types. `pairs` counts the pairs that
    the row stands for. Types of one name are few, so pairs of groups are.
    """
    named = named_entities(entities, aliases).where("name <> ''")
    groups = named.groupBy("name", F.coalesce("core_type", F.lit("")).alias("core_type"), "declared").agg(F.min("entity").alias("first_member"), F.count("*").alias("members"), F.max((F.col("own_name") != F.col("name")).cast("int")).alias("aliased"))
    known, mergeable = F.col("core_type").isin(*MERGEABLE, *HOMONYMS), F.col("core_type").isin(*MERGEABLE)
    within = F.when((mergeable | (known & F.col("declared"))) & (F.col("aliased") == 1), "ALIAS_OF").when(mergeable | (known & F.col("declared")), "SAME_AS").when(known, "AMBIGUOUS").otherwise("UNRESOLVED")
    pairs = F.expr("members * (members - 1) div 2")
    inside = groups.where("members > 1").select("name", "core_type", F.col("core_type").alias("other_type"), within.alias("decision"), pairs.alias("pairs"), "first_member", F.col("first_member").alias("other_member"))
    other = groups.select("name", F.col("core_type").alias("other_type"), F.col("first_member").alias("other_member"), F.col("members").alias("n"))
    between = groups.join(other, "name").where("core_type < other_type").select("name", "core_type", "other_type", F.lit("DISTINCT").alias("decision"), (F.col("members") * F.col("n")).alias("pairs"), "first_member", "other_member")
    return inside.unionByName(between)


def corpus_scope(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """entities (entity, admission, ...) that are an end of a fact (subject, object) and neither mentions only nor of one document."""
    ends = facts.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    return entities.where("admission IS NULL OR admission NOT IN ('MENTION_ONLY', 'DOCUMENT_SCOPED')").join(ends, "entity", "left_semi")
