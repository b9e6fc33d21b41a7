"""Queries of discourse: what definite descriptions in documents and conversations refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import spans as S
from gneiss.operators.discourse import DESCRIPTION, ORDINALS, ORGANIZATIONS, antecedents
from gneiss.session import table

ENTITY = "[A-Z][A-Za-z]{2,}"


def _entities(marks: DataFrame, *own: str) -> DataFrame:
    return marks.select(*own, "start", F.col("mark").alias("surface"), F.when(F.length("mark") % 4 == 0, "Organization").otherwise("Thing").alias("type"))


def document_antecedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every definite description of every document with what it refers to, capitalised words being the entities (those of four, eight, ... letters organisations)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = antecedents(_entities(S.marks(docs, ENTITY), "doc_id"), S.marks(docs, DESCRIPTION).select("doc_id", "start", "mark"), "doc_id", ["start"])
    return found.withColumnRenamed("start", "place")


def conversation_antecedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same along the turns of every conversation."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    place = lambda df: df.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"), "start", "mark")
    found = antecedents(_entities(place(S.marks(turns, ENTITY)), "conv_id", "turn"), place(S.marks(turns, DESCRIPTION)), "conv_id", ["turn", "start"])
    return found.withColumnRenamed("start", "place")


def _marks_sql(pattern: str, keys: str, source: str) -> str:
    return f"""SELECT {keys}, upto - length(mark) AS start, mark FROM (
    SELECT {keys}, mark, sum(length(gap) + length(mark)) OVER (PARTITION BY {keys} ORDER BY k) AS upto FROM (
      SELECT {keys}, unnest(range(len(m))) AS k, unnest(m) AS mark, unnest(g[1:len(m)]) AS gap
      FROM (SELECT {keys}, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS g FROM {source})))"""


def _sql(source: str, keys: str, key: str, order: str) -> str:
    """keys identify a text, key the group, order the place in it."""
    orders = ", ".join(f"'{w}'" for w in ORDINALS)
    nth = "CASE " + " ".join(f"WHEN lower(string_split(mark, ' ')[2]) = '{w}' THEN {n}" for w, n in ORDINALS.items()) + " END"
    firms = ", ".join(f"'{w}'" for w in ORGANIZATIONS)
    at = f"({order})"
    return f"""
WITH e AS (SELECT {keys}, start, lower(mark) AS surface, length(mark) % 4 = 0 AS firm, lower(mark) AS head FROM ({_marks_sql(ENTITY, keys, source)})),
d AS (SELECT *, lower(regexp_extract(mark, '([^ ]+)$', 1)) AS head, {nth} AS nth FROM ({_marks_sql(DESCRIPTION, keys, source)})),
firsts AS (SELECT {key}, head, surface, min({at}) AS o FROM e GROUP BY ALL),
firm_firsts AS (SELECT {key}, surface, min({at}) AS o FROM e WHERE firm GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key}, head ORDER BY o, surface) AS nth FROM firsts),
ranked_firms AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY o, surface) AS n FROM firm_firsts),
plain AS (
  SELECT d.*, 'UNIQUE_HEAD' AS rule, coalesce(r.nth, 0) AS seen, CASE WHEN r.nth = 1 THEN r.surface END AS antecedent
  FROM (SELECT *, {at} AS o FROM d WHERE nth IS NULL AND head NOT IN ({firms})) d ASOF LEFT JOIN ranked r ON d.{key} = r.{key} AND d.head = r.head AND d.o > r.o
),
companies AS (
  SELECT d.*, 'UNIQUE_ORGANIZATION' AS rule, coalesce(r.n, 0) AS seen, CASE WHEN r.n = 1 THEN r.surface END AS antecedent
  FROM (SELECT *, {at} AS o FROM d WHERE nth IS NULL AND head IN ({firms})) d ASOF LEFT JOIN ranked_firms r ON d.{key} = r.{key} AND d.o > r.o
),
ordinals AS (
  SELECT d.*, {at} AS o, 'ORDINAL' AS rule, coalesce(r.o < {at.replace("start", "d.start").replace("turn", "d.turn")}, false)::INT AS seen, CASE WHEN r.o < {at.replace("start", "d.start").replace("turn", "d.turn")} THEN r.surface END AS antecedent
  FROM d LEFT JOIN ranked r ON r.{key} = d.{key} AND r.head = d.head AND r.nth = d.nth WHERE d.nth IN (1, 2, 3, 4, 5)
)
SELECT {keys}, start::BIGINT AS place, mark, head, rule, seen::BIGINT AS seen, antecedent FROM plain UNION ALL BY NAME SELECT {keys}, start::BIGINT AS place, mark, head, rule, seen::BIGINT AS seen, antecedent FROM companies
UNION ALL BY NAME SELECT {keys}, start::BIGINT AS place, mark, head, rule, seen::BIGINT AS seen, antecedent FROM ordinals
"""


DOCUMENT_ANTECEDENTS = _sql("documents", "doc_id", "doc_id", "start")
CONVERSATION_ANTECEDENTS = _sql("conversations", "conv_id, turn", "conv_id", "turn, start")
