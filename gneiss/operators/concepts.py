"""Concept inventories: phrases of two to five words as candidates, longest useful spans, counts over the corpus, and a ranked budget a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import STOPWORDS, content_id
from gneiss.operators.admission import GENERIC
from gneiss.storage import written

LEAST, MOST, LONGEST, BUDGET = 2, 5, 3, 8
CONTRACT = "concept-inventory-v1"
#: A token, what ends a run of tokens, words that end a run too, and words that say little or stand for acts.
TOKEN, BREAK = r"[A-Za-z][A-Za-z0-9]*(?:['’]s)?(?:/[A-Za-z0-9]+)*", r"""[.!?;:,()"']"""
STOPS = STOPWORDS + (
    "about also just only because while since through against via per without within upon says said say welcome today back right okay thanks title whereas therefore however although though whether "
    "rather often already even still until toward towards away always never cannot hence thus accordingly consequently moreover furthermore otherwise meanwhile subsequently eventually finally "
    "initially currently recently previously precisely simply merely likely unlikely exactly roughly approximately typically usually sometimes rarely frequently particularly especially certainly clearly obviously "
    "presumably apparently probably possibly perhaps maybe instead across"
).split()
WEAK = (
    "real new main other same some any all many several general basic simple various different certain current entire whole particular additional actual own better worse less more most few effective ineffective "
    "familiar explanatory common larger smaller higher greater earlier later longer shorter wider narrower available complete unseen another such"
).split()
VERBS = (
    "bring take give make put use need become seem look come go try keep let find leave show fall rise grow drop lift cut add see say think know want work run set turn hold call help mean spend send ask talk start stop "
    "watch read write learn teach test check track measure combine require allow avoid reduce increase improve lower boost spike compress segment fix trade consume depend concern create produce expose judge estimate appear "
    "remain access attempt verify review classify record forward assign authenticate detect monitor evaluate perform compare attach close open launch deploy install configure manage lead direct chair head serve own "
    "possess associate link relate suppress predict reallocate involve eliminate matter assess support decline strengthen change interpret provide feel refer reveal guarantee understand wonder notice demand interfere"
).split()


def normal_concept(surface: Column) -> Column:
    """Lower case, hyphens, underscores and slashes as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(surface), "[-_/]", " "), r"\s+", " "))


def short_sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences, which end before white space after an end mark or at a newline."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+", -1)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: s != "")


def candidate_phrases(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """chunks (doc_id, chunk_index, text) to doc_id, chunk_index, sentence, place (of its first token in the sentence), n_tokens, surface, concept, parts: every occurrence of a candidate.

    A candidate is LEAST to `most` tokens of one sentence, none a stop word, with nothing of BREAK in or between them; or tokens
    with single "of" or "per" between them, where such a chain goes on to its end. Of a run of three, parts are the
    normal forms of the pairs that it holds. A sentence is classed once, a letter a token, and candidates are told by these letters.
    """
    rows = chunks.select("doc_id", "chunk_index", F.posexplode(short_sentences(F.col("text"))).alias("sentence", "s"))
    rows = rows.withColumn("t", F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0))).where(F.size("t") >= LEAST).withColumn("g", F.split("s", TOKEN, -1)).drop("s")
    low = F.transform("t", lambda w: F.lower(w))
    letter = lambda w: F.when(w.isin("of", "per"), "o").when(w.isin(STOPS) | F.contains(w, F.lit("'")), "s").otherwise("c")
    rows = rows.withColumn("letters", F.array_join(F.transform(low, letter), "")).withColumn("breaks", F.array_join(F.transform("g", lambda g: F.when(F.rlike(g, F.lit(BREAK)), "b").otherwise("-")), ""))
    places = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - LEAST)).alias("place")).where(F.substring("letters", F.col("place") + 1, F.lit(1)) == "c").select("*", F.explode(F.array(*map(F.lit, range(LEAST, most + 1)))).alias("n_tokens"))
    part = F.substring("letters", F.col("place") + 1, F.col("n_tokens"))
    run = (part == F.repeat(F.lit("c"), F.col("n_tokens"))) & ~F.contains(F.substring("breaks", F.col("place") + 2, F.col("n_tokens") - 1), F.lit("b"))
    chain = F.rlike(part, F.lit("^c(oc)+$")) & F.rlike(F.substring("letters", F.col("place") + 1, F.length("letters")), F.lit("^c(oc)+([cs]|$)"))
    at = lambda low, n: F.array_join(F.zip_with(F.concat(F.array(F.lit("")), F.slice("g", low + 2, n - 1)), F.slice("t", low + 1, n), lambda g, t: F.concat(g, t)), "")
    found = places.where((F.length(part) == F.col("n_tokens")) & (run | chain)).withColumn("surface", at(F.col("place"), F.col("n_tokens")))
    parts = F.when((F.col("n_tokens") == 3) & (part == "ccc"), F.array(normal_concept(at(F.col("place"), F.lit(2))), normal_concept(at(F.col("place") + 1, F.lit(2)))))
    return found.select("doc_id", "chunk_index", "sentence", "place", "n_tokens", "surface", normal_concept(F.col("surface")).alias("concept"), parts.alias("parts"))


def _acts(word: Column, verbs: list[str]) -> Column:
    """Is the word one of the verbs or an inflection of one."""
    known = lambda stem: stem.isin(verbs) | F.concat(stem, F.lit("e")).isin(verbs)
    ends = lambda end: F.endswith(word, F.lit(end)) & (F.length(word) > len(end) + 3) & known(F.left(word, F.length(word) - len(end)))
    return word.isin(verbs) | ends("ed") | ends("es") | ends("s")


def merged(phrases: DataFrame, *keys: str, apart: bool = False) -> DataFrame:
    """keys, concept, n_tokens, occurrences, chunks, surface (the first): candidates as they occur in each group of the keys, or with none in the corpus.

    apart: no chunk stands in several rows and none lacks its ids, so that each row is an occurrence; a chunk's occurrences are then counted first and no row is repeated for a distinct count.
    """
    place = F.struct("doc_id", "chunk_index", "sentence", "place", "n_tokens")
    hyphens = F.rlike("surface", F.lit("^[A-Za-z0-9'’]+(-[A-Za-z0-9'’]+)+$"))
    if apart:
        first = F.min(F.struct(place.alias("at"), "surface")).alias("f")
        own = list(dict.fromkeys([*keys, "concept", "doc_id", "chunk_index"]))
        each = phrases.groupBy(*own).agg(F.min("n_tokens").alias("n_tokens"), F.count("*").alias("occurrences"), first, F.bool_or(hyphens).alias("hyphens"))
        return each.groupBy(*keys, "concept").agg(F.min("n_tokens").alias("n_tokens"), F.sum("occurrences").alias("occurrences"), F.count("*").alias("chunks"), F.min("f")["surface"].alias("surface"), F.bool_or("hyphens").alias("hyphens"))
    return phrases.groupBy(*keys, "concept").agg(F.min("n_tokens").alias("n_tokens"), F.count_distinct(place).alias("occurrences"), F.count_distinct("doc_id", "chunk_index").alias("chunks"), F.min_by("surface", place).alias("surface"), F.bool_or(hyphens).alias("hyphens"))


def inventory(chunks: DataFrame, summaries: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), budget: int = BUDGET, verbs: list[str] = VERBS, apart: bool = False) -> DataFrame:
    """keys, rank (from 0), concept_id, concept, surface, n_tokens, occurrences, chunks: the `budget` best concepts of each group of chunks (doc_id, chunk_index, text, the keys).

    Candidates of over LONGEST tokens, with a head that names nothing, a weak first word or (unless hyphenated) an act go first. A pair that occurs only inside the first of the longer
    candidates that have it goes to that one (longest useful span); concepts of acts go last. What is left is ranked by occurrences, chunks, share of telling words,
    tokens, occurrence in the group's summary (keys, summary), few weak words, and id.

    Null and empty texts have none; everything is counted over all chunks, by joins on (keys, concept): no group is held in one place. apart: see merged.
    """
    keyed = list(keys)
    own = chunks.select("doc_id", "chunk_index", *(k for k in keyed if k != "doc_id"), "text")
    phrases = candidate_phrases(own, LONGEST)
    if keyed != ["doc_id"]:
        phrases = phrases.join(own.drop("text"), ["doc_id", "chunk_index"])
    phrases = written(phrases)
    words = F.split("concept", " ")
    act, last = (lambda w: _acts(w, verbs)), F.element_at(words, -1)
    compound = (F.size(words) == 2) & last.isin(verbs) & ~act(F.get(words, F.lit(0))) & ~F.get(words, F.lit(0)).isin(WEAK)
    gerund = F.regexp_extract(F.get(words, F.lit(0)), "^(.{3,})ing$", 1)
    clause = (F.size(words) >= 3) & (gerund != "") & (gerund.isin(verbs) | F.concat(gerund, F.lit("e")).isin(verbs))
    fragment = ~F.col("hyphens") & ((F.exists(words, act) & ~compound) | clause)
    known = written(merged(phrases, *keyed, apart=apart).where(~last.isin(GENERIC) & ~F.get(words, F.lit(0)).isin(WEAK) & ~fragment))

    longer = phrases.where("parts IS NOT NULL").join(known.select(*keyed, "concept"), [*keyed, "concept"], "left_semi")
    held = longer.select(*keyed, "doc_id", "chunk_index", "sentence", F.col("concept").alias("by"), "place", F.posexplode("parts").alias("k", "part")) if "doc_id" not in keyed else longer.select(*keyed, "chunk_index", "sentence", F.col("concept").alias("by"), "place", F.posexplode("parts").alias("k", "part"))
    each = held.groupBy(*keyed, "part", "by").agg(F.count_distinct(F.struct("doc_id", "chunk_index", "sentence", (F.col("place") + F.col("k")).alias("p"))).alias("inside"))
    first = each.groupBy(*keyed, F.col("part").alias("concept")).agg(F.min_by("inside", "by").alias("inside"))
    kept = known.join(first, [*keyed, "concept"], "left").where((F.col("n_tokens") >= LONGEST) | F.col("inside").isNull() | (F.col("inside") < F.col("occurrences")))
    kept = kept.where(~F.exists(words, act))
    if summaries is not None:
        kept = kept.join(summaries.select(*keyed, normal_concept(F.coalesce("summary", F.lit(""))).alias("said")), keyed, "left")
    told = F.contains("said", F.col("concept")) if summaries is not None else F.lit(False)
    weak = F.size(F.filter(words, lambda w: w.isin(WEAK)))
    concept_id = content_id("concept_", contract=F.lit(CONTRACT), normalized=F.col("concept"))
    density = F.round((F.size(words) - weak) / F.size(words), 3)
    order = [F.desc("occurrences"), F.desc("chunks"), F.desc(density), F.desc("n_tokens"), F.desc(F.coalesce(told, F.lit(False))), weak.asc(), F.desc("concept_id")]
    ranks = F.row_number().over(Window.partitionBy(*keyed).orderBy(*order)) - 1
    return kept.withColumn("concept_id", concept_id).withColumn("rank", ranks).where(F.col("rank") < budget).select(*keyed, "rank", "concept_id", "concept", "surface", "n_tokens", "occurrences", "chunks")


def enriched(summaries: DataFrame, concepts: DataFrame, most: int = 240, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """summaries (keys, summary) with `text`: the summary and the group's concepts by rank, a line each, at most `most` characters longer than the summary."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "surface"))), lambda c: F.concat(F.lit("- "), c["surface"])), "\n")
    met = summaries.join(concepts.groupBy(*keys).agg(lines.alias("lines")), list(keys), "left")
    said = F.coalesce("summary", F.lit(""))
    text = F.concat(F.lit("[DOCUMENT SUMMARY]\n"), F.regexp_replace(said, r"\A\s+|\s+\z", ""), F.lit("\n\n[KEY CONCEPTS]"), F.coalesce(F.concat(F.lit("\n"), "lines"), F.lit("")))
    limit = F.length(said) + most
    return met.select(*keys, "summary", F.when(F.length(text) > limit, F.regexp_replace(F.substring(text, F.lit(1), limit), r"\s+\z", "")).otherwise(text).alias("text"))
