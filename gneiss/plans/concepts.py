"""Queries of concept inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.values import told_apart
from gneiss.operators import concepts as C
from gneiss.operators.admission import GENERIC
from gneiss.operators.chunking import pack_sentences
from gneiss.operators.contractions import resolved
from gneiss.operators.phrases import contractions, corpus_counts, enriched_texts, inventories
from gneiss.plans.text import CHUNKS_CTE
from gneiss.session import table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sentences(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "parent_index", "text")


def _apart(spark: SparkSession, sf_dir: str) -> bool:
    """Does every document, and so every chunk, have an id of its own."""
    return told_apart(table(spark, sf_dir, "documents"), ["doc_id"])


def document_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best concepts of every document."""
    return inventories(table(spark, sf_dir, "documents")) if _apart(spark, sf_dir) else C.inventory(_chunks(spark, sf_dir))


def section_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best concepts of every section."""
    return inventories(table(spark, sf_dir, "documents"), 6, sections=True) if _apart(spark, sf_dir) else C.inventory(_chunks(spark, sf_dir), keys=("doc_id", "parent_index"), budget=6)


def corpus_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of two to five tokens with its counts over the corpus."""
    if _apart(spark, sf_dir):
        return corpus_counts(table(spark, sf_dir, "documents"))
    counts = C.merged(C.candidate_phrases(_chunks(spark, sf_dir)).where("doc_id IS NOT NULL"))
    return counts.select("concept", "n_tokens", "occurrences", "chunks", "surface")


def enriched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of every document with its concepts, and these ranked by whether that sentence has them."""
    first = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.get(C.short_sentences(F.col("text")), F.lit(0)), F.lit("")).alias("summary"))
    if _apart(spark, sf_dir):
        return enriched_texts(first.withColumn("said", C.normal_concept(F.col("summary"))))
    first = first.drop("text")
    return C.enriched(first, C.inventory(_chunks(spark, sf_dir), first)).select("doc_id", "text")


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(w.replace("'", "''") for w in words)) + "]"


def _in(words: list[str]) -> str:
    return "IN (" + _listed(words)[1:-1] + ")"


ACT, WEAK = _in(C.VERBS), _in(C.WEAK)


def _acts_sql(w: str) -> str:
    ends = " OR ".join(f"(length({w}) > {len(e) + 3} AND {w} LIKE '%{e}' AND ({w}[1:length({w}) - {len(e)}] {ACT} OR {w}[1:length({w}) - {len(e)}] || 'e' {ACT}))" for e in ("ed", "es", "s"))
    return f"({w} {ACT} OR {ends})"


NORMAL_SQL = r"trim(regexp_replace(regexp_replace(lower({}), '[-_/]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
TOKEN_SQL, BREAK_SQL = C.TOKEN.replace("'", "''"), C.BREAK.replace("'", "''")
SHORT_SQL = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({}, '\n+', chr(1), 'g'), '([.!?])[ \t\r\x0b\f]+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"""
PHRASES_CTE = rf"""{CHUNKS_CTE},
short AS (SELECT doc_id, chunk_index, parent_index, unnest(range(len(l))) AS sentence, unnest(l) AS s FROM (SELECT *, {SHORT_SQL.format("text")} AS l FROM packed)),
cut AS (SELECT *, regexp_extract_all(s, '{TOKEN_SQL}') AS t, regexp_split_to_array(s, '{TOKEN_SQL}') AS g FROM short),
lettered AS (
  SELECT *, array_to_string(list_transform(t, lambda w: CASE WHEN lower(w) IN ('of', 'per') THEN 'o' WHEN lower(w) {_in(C.STOPS)} OR contains(w, '''') THEN 's' ELSE 'c' END), '') AS letters,
         array_to_string(list_transform(g, lambda x: CASE WHEN regexp_matches(x, '{BREAK_SQL}') THEN 'b' ELSE '-' END), '') AS breaks
  FROM cut WHERE len(t) >= 2
),
places AS (
  SELECT doc_id, chunk_index, parent_index, sentence, i AS place, n AS n_tokens, letters[i + 1:i + n] AS part, letters[i + 1:] AS rest, breaks[i + 2:i + n] AS inner_breaks, t[i + 1:i + n] AS ts, g[i + 2:i + n] AS gs
  FROM lettered, unnest(range(len(t) - 1)) r(i), range(2, 6) q(n) WHERE letters[i + 1] = 'c'
),
phrases AS (
  SELECT doc_id, chunk_index, parent_index, sentence, place, n_tokens, part, ts, gs, list_reduce([ts[1]] || list_transform(range(1, len(ts)), lambda k: gs[k] || ts[k + 1]), lambda a, b: a || b) AS surface
  FROM places WHERE len(ts) = n_tokens AND ((part = repeat('c', n_tokens) AND NOT contains(inner_breaks, 'b')) OR (regexp_matches(part, '^c(oc)+$') AND regexp_matches(rest, '^c(oc)+([cs]|$)')))
),
named AS (SELECT *, {NORMAL_SQL.format("surface")} AS concept, {NORMAL_SQL.format("ts[1] || gs[1] || ts[2]")} AS part_1, {NORMAL_SQL.format("ts[2] || gs[2] || ts[3]")} AS part_2 FROM phrases)"""


def _merged_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}concept, min(n_tokens) AS n_tokens, count(DISTINCT (doc_id, chunk_index, sentence, place, n_tokens)) AS occurrences, count(DISTINCT (doc_id, chunk_index)) AS chunks,
         arg_min(surface, (doc_id, chunk_index, sentence, place, n_tokens)) AS surface, bool_or(regexp_matches(surface, '^[A-Za-z0-9''’]+(-[A-Za-z0-9''’]+)+$')) AS hyphens FROM {source} GROUP BY {keys}concept"""


def _inventory_cte(keys: str, budget: int, said: str = "NULL") -> str:
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    return f"""{PHRASES_CTE},
upto AS (SELECT * FROM named WHERE n_tokens <= 3),
counted AS (SELECT *, string_split(concept, ' ') AS w FROM ({_merged_sql("upto", keys + ", ")})),
judged AS (
  SELECT *, list_bool_or(list_transform(w, lambda x: {_acts_sql("x")})) AS acts, len(w) = 2 AND w[-1] {ACT} AND NOT {_acts_sql("w[1]")} AND w[1] NOT {WEAK} AS compound,
         regexp_extract(w[1], '^(.{{3,}})ing$', 1) AS gerund
  FROM counted
),
known AS (
  SELECT * FROM judged WHERE w[-1] NOT {_in(GENERIC)} AND w[1] NOT {WEAK}
    AND NOT (NOT hyphens AND ((acts AND NOT compound) OR (len(w) >= 3 AND gerund <> '' AND (gerund {ACT} OR gerund || 'e' {ACT}))))
),
longer AS (SELECT y.* FROM upto y WHERE part = 'ccc' AND EXISTS (SELECT 1 FROM known x WHERE {on} AND x.concept = y.concept)),
held AS (SELECT *, part_1 AS piece, place AS p FROM longer UNION ALL SELECT *, part_2, place + 1 FROM longer),
each_held AS (SELECT {keys}, piece, concept AS owner, count(DISTINCT (chunk_index, sentence, p)) AS inside FROM held GROUP BY ALL),
firsts AS (SELECT {keys}, piece AS concept, arg_min(inside, owner) AS inside FROM each_held GROUP BY {keys}, piece),
kept AS (SELECT y.*, x.inside FROM known y LEFT JOIN firsts x ON {on} AND x.concept = y.concept WHERE (y.n_tokens >= 3 OR x.inside IS NULL OR x.inside < y.occurrences) AND NOT acts),
scored AS (
  SELECT *, len(list_filter(w, lambda x: x {WEAK})) AS weak, 'concept_' || sha256('{{"contract":"{C.CONTRACT}","normalized":' || to_json(concept)::VARCHAR || '}}') AS concept_id, coalesce({said}, false) AS told FROM kept
),
inventory AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY occurrences DESC, chunks DESC, round((len(w) - weak) / len(w), 3) DESC, n_tokens DESC, told DESC, weak, concept_id DESC) - 1 AS rank FROM scored) WHERE rank < {budget}
)"""


DOCUMENT_CONCEPTS = f"WITH RECURSIVE {_inventory_cte('doc_id', 8)} SELECT doc_id, rank, concept_id, concept, surface, n_tokens, occurrences, chunks FROM inventory"
SECTION_CONCEPTS = f"WITH RECURSIVE {_inventory_cte('doc_id, parent_index', 6)} SELECT doc_id, parent_index, rank, concept_id, concept, surface, n_tokens, occurrences, chunks FROM inventory"
CORPUS_CONCEPTS = f"WITH RECURSIVE {PHRASES_CTE} SELECT concept, n_tokens, occurrences, chunks, surface FROM ({_merged_sql('named', '')})"
_SAID = f"contains((SELECT {NORMAL_SQL.format('summary')} FROM summary u WHERE u.doc_id = kept.doc_id), concept)"
ENRICHED_DOCUMENTS = rf"""
WITH RECURSIVE summary AS (SELECT doc_id, coalesce({SHORT_SQL.format("coalesce(text, '')")}[1], '') AS summary FROM documents), {_inventory_cte('doc_id', 8, _SAID)},
lines AS (SELECT doc_id, string_agg('- ' || surface, chr(10) ORDER BY rank) AS l FROM inventory GROUP BY doc_id),
texts AS (SELECT doc_id, summary, '[DOCUMENT SUMMARY]' || chr(10) || summary || chr(10) || chr(10) || '[KEY CONCEPTS]' || coalesce(chr(10) || l, '') AS t FROM summary LEFT JOIN lines USING (doc_id))
SELECT doc_id, CASE WHEN length(t) > length(summary) + 240 THEN regexp_replace(substring(t, 1, length(summary) + 240), '[ \t\n\x0B\f\r]+$', '') ELSE t END AS text FROM texts
"""


def phrase_contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of up to four words that a document repeats, with the longer one that each shortens."""
    if _apart(spark, sf_dir):
        return contractions(table(spark, sf_dir, "documents"))
    names = C.merged(C.candidate_phrases(_chunks(spark, sf_dir), 4), "doc_id").where("occurrences > 1").select("doc_id", F.col("concept").alias("surface"), F.lit("Phrase").alias("type"))
    return resolved(names).withColumn("candidates", F.array_join("candidates", "|"))


PHRASE_CONTRACTIONS = f"""
WITH RECURSIVE {PHRASES_CTE},
names AS (
  SELECT doc_id, concept AS surface, regexp_extract_all(concept, '[a-z0-9][a-z0-9-]*') AS t
  FROM (SELECT doc_id, concept, count(DISTINCT (chunk_index, sentence, place, n_tokens)) AS n FROM named WHERE n_tokens <= 4 GROUP BY ALL) WHERE n > 1
),
pairs AS (
  SELECT a.doc_id, a.surface, b.surface AS longer, b.t[1:len(a.t)] = a.t AS starts
  FROM names a JOIN names b ON a.doc_id = b.doc_id AND len(a.t) > 0 AND len(a.t) < len(b.t) AND a.t[1] = b.t[1]
  WHERE b.t[1:len(a.t)] = a.t OR (len(a.t) >= 2 AND a.t[-1] = b.t[-1] AND regexp_matches(' ' || array_to_string(b.t, ' ') || ' ', '^ ' || array_to_string(a.t, ' (?:[^ ]+ )*') || ' $'))
),
best AS (SELECT doc_id, surface, string_agg(longer, '|' ORDER BY longer) AS candidates, count(*) AS n, bool_or(starts) AS starts FROM pairs GROUP BY ALL)
SELECT doc_id, surface, 'Phrase' AS type, CASE WHEN n = 1 THEN 'SAME_ENTITY' ELSE 'ABSTAIN' END AS decision, CASE WHEN n = 1 THEN candidates END AS resolved_to,
       CASE WHEN n = 1 THEN CASE WHEN starts THEN 'anchor-prefix' ELSE 'head-preserving elision' END END AS shape, coalesce(candidates, '') AS candidates
FROM names LEFT JOIN best USING (doc_id, surface)
"""
