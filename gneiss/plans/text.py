"""Queries over texts: chunks, identities, summaries, lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import STOPWORDS, SUMMARY_STOPWORDS, content_id, content_tokens
from gneiss.functions.values import told_apart
from gneiss.operators.chunking import linked_chunks, pack_sentences, section_summaries, sentence_rows, summaries
from gneiss.operators.lexical import lexical_hits
from gneiss.operators.nearest import dimensions
from gneiss.operators.ranking import top_per
from gneiss.session import table
from gneiss.storage import written
from gneiss.sources.html import materialize

TOP = 10
STOP_SQL, SUMMARY_STOP_SQL = ("[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]" for words in (STOPWORDS, SUMMARY_STOPWORDS))
TOKENS_SQL = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+(?:[-_][a-z0-9]+)*')"
SENTENCE_LIST = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n+', chr(1), 'g'),
    '([.!?])[ \t\r\x0b\f]+([A-Z0-9"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"""
SENTENCES_CTE = f"sentence_lists AS (SELECT doc_id, {SENTENCE_LIST} AS s FROM documents)"


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(table(spark, sf_dir, "documents"))


SENTENCE_SPLIT = f"WITH {SENTENCES_CTE} SELECT doc_id, unnest(range(len(s)))::INT AS idx, unnest(s) AS sentence FROM sentence_lists"


def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sentences(table(spark, sf_dir, "documents"))


CHUNKS_CTE = f"""
{SENTENCES_CTE},
walk AS (
  SELECT doc_id, s, 1 AS i, 0 AS chunk, length(s[1]) AS n FROM sentence_lists WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1, chunk + (n + 1 + length(s[i + 1]) > 1200)::INT, CASE WHEN n + 1 + length(s[i + 1]) > 1200 THEN 0 ELSE n END + length(s[i + 1])
  FROM walk WHERE i < len(s)
),
packed AS (
  SELECT doc_id, chunk AS chunk_index, 'chunk_' || sha256('{{"d":"' || doc_id || '","i":' || chunk || ',"t":' || to_json(text)::VARCHAR || '}}') AS chunk_id, chunk // 4 AS parent_index, text, n AS n_sentences
  FROM (SELECT doc_id, chunk, string_agg(s[i], ' ' ORDER BY i) AS text, count(*) AS n FROM walk GROUP BY doc_id, chunk)
)"""
CHUNK_PACKING = f"WITH RECURSIVE {CHUNKS_CTE} SELECT * FROM packed"


def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its parent's id."""
    return linked_chunks(pack_sentences(table(spark, sf_dir, "documents"))).select("doc_id", "chunk_index", "chunk_id", "parent_index", "parent_id")


PARENT_CHUNKS = f"""
WITH RECURSIVE {CHUNKS_CTE},
up AS (
  SELECT doc_id, parent_index, 'chunk_' || sha256('{{"d":"' || doc_id || '","i":"parent:' || parent_index || '","t":' || to_json(text)::VARCHAR || '}}') AS parent_id
  FROM (SELECT doc_id, parent_index, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM packed GROUP BY ALL)
)
SELECT doc_id, chunk_index, chunk_id, parent_index, parent_id FROM packed JOIN up USING (doc_id, parent_index)
"""


def conversation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of four turns each, with the text of the parent before."""
    turns = table(spark, sf_dir, "conversations").withColumn("section", F.floor(F.col("turn") / 4))
    line = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    parents = turns.groupBy("conv_id", "section").agg(F.array_sort(F.collect_list(line)).alias("turns"), F.count("*").alias("n_turns"))
    joined = parents.select("conv_id", "section", "n_turns", F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit(": "), t["text"])), "\n").alias("text"))
    from pyspark.sql import Window

    before = F.lag(F.sha2("text", 256)).over(Window.partitionBy("conv_id").orderBy("section"))
    return joined.withColumn("previous", before)


CONVERSATION_SECTIONS = """
WITH p AS (SELECT conv_id, turn // 4 AS section, count(*) AS n_turns, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY ALL)
SELECT *, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY section) AS previous FROM p
"""


def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the ids of its neighbours in the same section of four."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", F.xxhash64("text"))
    same = lambda c: F.when(F.floor(c / 4) == F.floor(F.col("turn") / 4), c)
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", same(F.lag("turn").over(w)).alias("previous"), same(F.lead("turn").over(w)).alias("next"))


TURN_CONTEXT = """
SELECT conv_id, turn, role, CASE WHEN p // 4 = turn // 4 THEN p END AS previous, CASE WHEN n // 4 = turn // 4 THEN n END AS next
FROM (SELECT *, lag(turn) OVER w AS p, lead(turn) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(content_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


DOCUMENT_FREQUENCY = f"""
SELECT token, count(*) AS df FROM (
  SELECT unnest(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[-_][a-z0-9]+)*')), lambda t: NOT list_contains({STOP_SQL}, t))) AS token FROM documents
) GROUP BY token
"""


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def summary_ctes(name: str, source: str, keys: str, most: int, most_chars: int) -> str:
    """CTEs that end with `name` (keys, summary) of the texts of `source` (keys, text)."""
    return f"""
{name}_s AS (SELECT {keys}, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (SELECT {keys}, {SENTENCE_LIST} AS s FROM {source})),
{name}_w AS (SELECT {keys}, idx, unnest(list_filter(list_transform(regexp_extract_all(sentence, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'), lambda x: lower(x)), lambda x: NOT list_contains({SUMMARY_STOP_SQL}, x))) AS w FROM {name}_s),
{name}_u AS (SELECT {keys}, idx, w, count(*) AS uses FROM {name}_w GROUP BY ALL),
{name}_df AS (SELECT {keys}, w, count(*) AS df FROM {name}_u GROUP BY ALL),
{name}_total AS (SELECT {keys}, count(*) AS total FROM {name}_w GROUP BY ALL),
{name}_n AS (SELECT {keys}, count(*) AS n FROM {name}_s GROUP BY ALL),
{name}_scored AS (
  SELECT {keys}, idx, sum(uses * (df / total * ln((n + 1) / (1 + df) + 1.0))) / sum(uses) + 0.6 / (1 + idx) AS score
  FROM {name}_u JOIN {name}_df USING ({keys}, w) JOIN {name}_total USING ({keys}) JOIN {name}_n USING ({keys}) GROUP BY {keys}, idx
),
{name}_best AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(coalesce(score, 0), 9) DESC, idx) AS r FROM {name}_s LEFT JOIN {name}_scored USING ({keys}, idx)),
{name} AS (
  SELECT {keys}, CASE WHEN length(t) <= {most_chars} THEN t ELSE coalesce(nullif(regexp_replace(regexp_replace(t[1:{most_chars}], ' [^ ]*$', ''), '[.,;:-]+$', ''), ''), t[1:{most_chars}]) END AS summary
  FROM (SELECT {keys}, string_agg(sentence, ' ' ORDER BY idx) AS t FROM {name}_best WHERE r <= {most} GROUP BY {keys})
)"""


EXTRACTIVE_SUMMARY = f"WITH {summary_ctes('d', 'documents', 'doc_id', 4, 900)} SELECT * FROM d"


def child_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_summaries(written(pack_sentences(table(spark, sf_dir, "documents"))))


SECTION_SUMMARIES_CTE = f"""{CHUNKS_CTE},
{summary_ctes('kid', 'packed', 'doc_id, parent_index, chunk_index', 1, 220)},
kid_lines AS (SELECT doc_id, parent_index, string_agg(summary, chr(10) ORDER BY chunk_index) AS text FROM kid GROUP BY ALL),
{summary_ctes('section', 'kid_lines', 'doc_id, parent_index', 3, 600)}"""
CHILD_SUMMARIES = f"WITH RECURSIVE {SECTION_SUMMARIES_CTE} SELECT * FROM section"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match each benchmark text best."""
    hits = lexical_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], asked(spark, sf_dir), TOP)
    return top_per(hits, ["query_id"], TOP, F.desc("score"), F.asc("doc_id"))


QUERY_TERMS_CTE = f"""
q AS (SELECT item_id AS query_id, {TOKENS_SQL.format('text')} AS terms FROM benchmark),
t AS (SELECT query_id, len(terms) AS n, term, count(*) AS times FROM (SELECT query_id, terms, unnest(terms) AS term FROM q) WHERE NOT list_contains({STOP_SQL}, term) GROUP BY ALL)"""


def lexical_ctes(name: str, source: str, keys: str) -> str:
    """CTEs that end with `name` (query_id, keys, score) over the texts of `source`."""
    return f"""
{name}_d AS (SELECT {keys}, lower(coalesce(text, '')) AS body FROM {source}),
{name}_f AS (SELECT {keys}, term, (length(body) - length(replace(body, term, ''))) / length(term) AS c FROM {name}_d, (SELECT DISTINCT term FROM t) WHERE contains(body, term)),
{name} AS (SELECT query_id, {keys}, round(sum(times * (1 + ln(1 + c) * 1.2)) / n, 9) AS score FROM {name}_f JOIN t USING (term) GROUP BY query_id, {keys}, n)"""


LEXICAL_TOP = f"""
WITH {QUERY_TERMS_CTE}, {lexical_ctes('s', 'documents', 'doc_id')},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s)
SELECT * FROM r WHERE rank < 10
"""


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse unit vectors of 512 hashed 3-grams that span no space: doc_id, dim, value."""
    docs = table(spark, sf_dir, "documents")
    if told_apart(docs, ["doc_id"]):
        low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        return low.select("doc_id", F.explode(dimensions("text")).alias("d")).select("doc_id", F.col("d.dim").alias("dim"), F.round("d.value", 9).alias("value"))
    clean = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9 ]", "")
    grams = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("clean") - 2)), lambda i: F.substring(F.col("clean"), i, F.lit(3))), lambda g: (F.length(g) == 3) & ~F.contains(g, F.lit(" ")))
    counted = docs.select("doc_id", clean.alias("clean")).select("doc_id", F.explode(grams).alias("g")).groupBy("doc_id", "g").agg(F.count("*").alias("c"))
    dim = F.pmod(F.conv(F.substring(F.sha2("g", 256), 1, 8), 16, 10).cast("long"), F.lit(512))
    dims = counted.groupBy("doc_id", dim.alias("dim")).agg(F.sum("c").alias("c"))
    norms = dims.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return dims.join(norms, "doc_id").select("doc_id", "dim", F.round(F.col("c") / F.col("norm"), 9).alias("value"))


HASH_EMBEDDING = """
WITH g AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(1, length(clean) - 1)), lambda i: substr(clean, i, 3))) AS g
  FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g') AS clean FROM documents)
),
c AS (SELECT doc_id, ('0x' || sha256(g)[1:8])::BIGINT % 512 AS dim, count(*) AS c FROM g WHERE length(g) = 3 AND NOT contains(g, ' ') GROUP BY ALL)
SELECT doc_id, dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 9) AS value FROM c
"""


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_id("doc_", s=F.col("source"), t=F.col("text")).alias("content_id"))


CONTENT_IDS = """SELECT doc_id, 'doc_' || sha256('{"s":' || coalesce(to_json(source)::VARCHAR, 'null') || ',"t":' || coalesce(to_json(text)::VARCHAR, 'null') || '}') AS content_id FROM documents"""


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(table(spark, sf_dir, "pages"))
