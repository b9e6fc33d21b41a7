"""Queries over spans, provenance, admitted entities, claims and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.text import content_tokens, query_tokens
from gneiss.operators import control as K
from gneiss.operators import evidence as E
from gneiss.operators import graph as G
from gneiss.operators import spans as S
from gneiss.functions.values import first_year, lookup_form, uuid5
from gneiss.operators.structure import regions
from gneiss.operators.admission import corpus_scope, group_decisions, registry
from gneiss.plans.state import FACTS_CTE, dense_lane, facts
from gneiss.plans.text import STOP_SQL, TOKENS_SQL, asked, lexical_top
from gneiss.session import table
from gneiss.sources.files import materialized

# spans: capitalised words as entities, a few function words as triggers, lines as frames

ENTITY, TRIGGER = "[A-Z][A-Za-z]{2,}", " (?:and|for|the|with|on) "


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = S.pieces(docs, r"\n")
    return S.inside(S.marks(docs, TRIGGER).drop("k"), lines), S.inside(S.marks(docs, ENTITY).drop("k"), lines)


def line_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words with the line that holds them."""
    return _spans(spark, sf_dir)[1].select("doc_id", "frame", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "mark")


def surface_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a subject and an object around each trigger of a line, or why there are none."""
    return S.line_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), TRIGGER, ENTITY).withColumnRenamed("start", "trigger_start")


def _marks_sql(pattern: str) -> str:
    return f"""SELECT doc_id, upto - length(mark) AS a, upto AS b, mark FROM (
    SELECT doc_id, mark, sum(length(gap) + length(mark)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM (
      SELECT doc_id, unnest(range(len(m))) AS k, unnest(m) AS mark, unnest(g[1:len(m)]) AS gap
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS g FROM documents)))"""


SPANS_CTE = rf"""
lines AS (
  SELECT doc_id, frame, upto - length(line) AS a, upto AS b FROM (
    SELECT doc_id, frame, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY frame) - 1 AS upto FROM (
      SELECT doc_id, unnest(range(len(l))) AS frame, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))
  WHERE regexp_matches(line, '\S')
),
entities AS (SELECT doc_id, frame, m.a, m.b, mark FROM ({_marks_sql(ENTITY)}) m JOIN lines l USING (doc_id) WHERE m.a >= l.a AND m.b <= l.b),
triggers AS (SELECT doc_id, frame, m.a, m.b, mark FROM ({_marks_sql(TRIGGER)}) m JOIN lines l USING (doc_id) WHERE m.a >= l.a AND m.b <= l.b)"""
LINE_ENTITIES = f"WITH {SPANS_CTE} SELECT doc_id, frame, a::BIGINT AS span_start, b::BIGINT AS span_end, mark FROM entities"
SURFACE_CANDIDATES = f"""
WITH {SPANS_CTE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, frame ORDER BY a) AS n FROM entities),
firsts AS (
  SELECT t.doc_id, t.frame, t.a, t.mark, l.n AS ln, r.n AS rn
  FROM triggers t ASOF LEFT JOIN ranked l ON l.doc_id = t.doc_id AND l.frame = t.frame AND t.a >= l.b ASOF LEFT JOIN ranked r ON r.doc_id = t.doc_id AND r.frame = t.frame AND t.b <= r.a
),
total AS (SELECT doc_id, frame, count(*) AS all_n FROM entities GROUP BY ALL),
judged AS (
  SELECT f.*, CASE WHEN ln IS NULL THEN 'SUBJECT_UNAVAILABLE' WHEN rn IS NULL THEN 'OBJECT_UNAVAILABLE' WHEN ln > 1 AND all_n - rn + 1 > 1 THEN 'AMBIGUOUS' ELSE 'PAIR' END AS outcome
  FROM firsts f LEFT JOIN total USING (doc_id, frame)
),
pairs AS (
  SELECT j.doc_id, j.a, l.mark AS subject, r.mark AS object, l.a AS subject_start, r.a AS object_start
  FROM judged j JOIN ranked l ON l.doc_id = j.doc_id AND l.frame = j.frame AND l.n BETWEEN j.ln - 2 AND j.ln JOIN ranked r ON r.doc_id = j.doc_id AND r.frame = j.frame AND r.n BETWEEN j.rn AND j.rn + 2
  WHERE outcome = 'PAIR' AND l.mark <> r.mark
)
SELECT j.doc_id, j.frame, j.a::BIGINT AS trigger_start, j.mark, outcome, subject, object, subject_start::BIGINT AS subject_start, object_start::BIGINT AS object_start
FROM judged j LEFT JOIN pairs p ON p.doc_id = j.doc_id AND p.a = j.a
"""

# provenance of facts: lines are their evidence, orders the documents, customers the runs


def fact_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact with its names, its evidence's documents and segments, and whether any document is open."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey"))
    runs = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # each order once with each of its segments, one of them leading, so that documents are counted without distinct counts
    by_run = orders.join(runs, "c_custkey").repartition("o_orderkey").groupBy("o_orderkey", "c_mktsegment").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("is_open"))
    leads = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("c_mktsegment")) == 1
    met = lines.join(by_run.withColumn("leads", leads), "o_orderkey")
    fact = ["l_partkey", "l_suppkey", "l_returnflag"]
    by_order = met.groupBy(*fact, "o_orderkey", "c_mktsegment", "leads").agg(F.bool_or("is_open").alias("is_open"))
    by_segment = by_order.repartition(*fact).groupBy(*fact, "c_mktsegment").agg(F.count_if("leads").alias("documents"), F.bool_or("is_open").alias("any_open"))
    by_fact = by_segment.groupBy(*fact).agg(F.sum("documents").alias("documents"), F.count("c_mktsegment").alias("segments"), F.bool_or("any_open").alias("any_open"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    named = by_fact.join(parts, "l_partkey", "left").join(supp, "l_suppkey", "left")
    return named.select("l_partkey", "l_suppkey", "l_returnflag", F.coalesce("p_name", F.lit("?")).alias("subject"), F.coalesce("s_name", F.lit("?")).alias("object"), "documents", "segments", "any_open")


FACT_PROVENANCE = """
SELECT l_partkey, l_suppkey, l_returnflag, coalesce(p_name, '?') AS subject, coalesce(s_name, '?') AS object, documents, segments, any_open FROM (
  SELECT l_partkey, l_suppkey, l_returnflag, count(DISTINCT o_orderkey) AS documents, count(DISTINCT c_mktsegment) AS segments, bool_or(o_orderstatus = 'O') AS any_open
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
) LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = F.concat(F.lit("part:"), "l_partkey", F.lit("|"), "l_returnflag", F.lit("|supp:"), "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(fact.alias("fact"), F.col("l_orderkey").alias("doc_id"))


def _orders(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("doc_id"))


def authorized_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with evidence in an open order, or with none."""
    return G.authorized(facts(spark, sf_dir), _evidence(spark, sf_dir), _orders(spark, sf_dir, "O")).select("fact")


EVIDENCE_CTE = "evidence AS (SELECT 'part:' || l_partkey || '|' || l_returnflag || '|supp:' || l_suppkey AS fact, l_orderkey AS doc_id FROM lineitem)"
AUTHORIZED_FACTS = f"""
WITH {FACTS_CTE}, {EVIDENCE_CTE} SELECT fact FROM facts f
WHERE fact IN (SELECT fact FROM evidence JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'O') OR NOT EXISTS (SELECT 1 FROM evidence e WHERE e.fact = f.fact)
"""


def retired_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and entities that would go if finished orders went."""
    return G.residue(facts(spark, sf_dir), _evidence(spark, sf_dir), _orders(spark, sf_dir, "F"))


RETIRED_RESIDUE = f"""
WITH {FACTS_CTE}, {EVIDENCE_CTE},
alive AS (SELECT DISTINCT fact FROM evidence WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')),
gone AS (SELECT * FROM facts WHERE fact IN (SELECT fact FROM evidence) AND fact NOT IN (SELECT fact FROM alive)),
kept AS (SELECT subject AS e FROM facts WHERE fact NOT IN (SELECT fact FROM gone) UNION SELECT object FROM facts WHERE fact NOT IN (SELECT fact FROM gone))
SELECT 'fact' AS kind, fact AS id FROM gone UNION ALL SELECT 'entity', e FROM (SELECT subject AS e FROM gone UNION SELECT object FROM gone) WHERE e NOT IN (SELECT e FROM kept)
"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    queries = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.filter(query_tokens(F.col("p_name")), lambda t: F.length(t) > 3).alias("terms"))
    evidenced = _evidence(spark, sf_dir).join(_orders(spark, sf_dir, "O").withColumn("open", F.lit(True)), "doc_id", "left")
    key = F.regexp_extract("fact", r"part:(\d+)", 1).cast("long").alias("p_partkey")
    held = evidenced.groupBy(key).agg(F.coalesce(F.bool_or("open"), F.lit(False)).alias("preferred"))
    entities = part.where("p_size >= 5 OR p_size IS NULL").join(held, "p_partkey").select(F.concat(F.lit("part:"), "p_partkey").alias("entity"), F.lower("p_name").alias("surface"), "preferred")
    return G.surface_seeds(queries, entities)


def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts with evidence for the name of every part whose key is divisible by 100, those in open orders first."""
    return _seeds(spark, sf_dir)


SEEDS_CTE = f"""
asked AS (SELECT p_partkey AS query_id, list_filter({TOKENS_SQL.format('p_name')}, lambda t: length(t) > 3) AS terms FROM part WHERE p_partkey % 100 = 0),
terms AS (SELECT query_id, unnest(list_slice(list_distinct(terms), 1, 12)) AS term FROM asked),
known AS (
  SELECT 'part:' || p_partkey AS entity, lower(p_name) AS surface, bool_or(o_orderstatus IS NOT NULL) AS preferred
  FROM part JOIN lineitem ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON o_orderkey = l_orderkey WHERE p_size >= 5 OR p_size IS NULL GROUP BY ALL
),
matched AS (SELECT DISTINCT query_id, entity, preferred FROM terms JOIN known ON contains(surface, term) OR contains(term, surface)),
seeds AS (SELECT query_id, entity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY preferred DESC, entity) - 1 AS rank FROM matched) WHERE rank < 8)"""
GRAPH_SEEDS = f"WITH {SEEDS_CTE} SELECT * FROM seeds"


def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty authorised facts at the seeds of each query."""
    return G.expansion(_seeds(spark, sf_dir), G.authorized(facts(spark, sf_dir), _evidence(spark, sf_dir), _orders(spark, sf_dir, "O")))


GRAPH_FACTS = f"""
WITH {FACTS_CTE}, {EVIDENCE_CTE}, {SEEDS_CTE},
allowed AS (SELECT * FROM facts WHERE fact IN (SELECT fact FROM evidence JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'O')),
near AS (SELECT DISTINCT query_id, fact FROM seeds JOIN allowed ON entity = subject OR entity = object)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fact) - 1 AS rank FROM near) WHERE rank < 20
"""

# registries

KIND = "CASE p_type WHEN 'ECONOMY' THEN 'Product' WHEN 'SMALL' THEN 'Person' WHEN 'PROMO' THEN 'Technology' ELSE 'Widget' END"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.expr(KIND).alias("core_type"), F.col("p_name").alias("surface"))


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("red ring", "small ring"), ("red ring", "Blue Bolt.")], "canonical string, alias string")


def canonical_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(_entities(spark, sf_dir), "parts", _aliases(spark))


NAMED_CTE = f"""
e AS (SELECT p_partkey AS entity, {KIND} AS core_type, lower(trim(p_name)) AS own_name FROM part),
n AS (SELECT *, CASE WHEN own_name IN ('small ring', 'blue bolt') THEN 'red ring' ELSE own_name END AS name FROM e),
g AS (SELECT *, name = 'red ring' AS declared, own_name <> name AS aliased, core_type IN ('Product', 'Technology') AS merges, core_type = 'Person' AS homonym,
      min(entity) OVER w AS first_member, count(*) OVER w AS members FROM n WINDOW w AS (PARTITION BY name, core_type))"""
CANONICAL_REGISTRY = f"""
WITH {NAMED_CTE}, m AS (SELECT *, merges OR (homonym AND declared) AS one FROM g)
SELECT entity, core_type, name, 'cent_' || sha256('{{"c":"parts","e":"' || CASE WHEN one THEN '' ELSE entity::VARCHAR END || '","n":"' || name || '","t":"' || core_type || '","v":"canonicalizer-v1"}}') AS canonical_id,
       CASE WHEN one AND members > 1 AND aliased THEN 'ALIAS_OF' WHEN one AND members > 1 THEN 'SAME_AS' ELSE 'SELF' END AS decision,
       CASE WHEN one AND members = 1 THEN 'singleton' WHEN one AND (aliased OR NOT merges) THEN 'explicit_source_alias' WHEN one THEN 'normalized_exact_match,compatible_core_type,mergeable_type_class'
            WHEN homonym THEN 'homonym_risk_type_class' ELSE 'unknown_core_type' END AS basis, first_member, members
FROM m
"""


def registry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_decisions(_entities(spark, sf_dir), _aliases(spark))


REGISTRY_DECISIONS = f"""
WITH {NAMED_CTE},
s AS (SELECT name, core_type, declared, merges, homonym, bool_or(aliased) AS aliased, min(entity) AS first_member, count(*) AS members FROM g GROUP BY name, core_type, declared, merges, homonym)
SELECT name, core_type, core_type AS other_type, CASE WHEN merges OR (homonym AND declared) THEN CASE WHEN aliased THEN 'ALIAS_OF' ELSE 'SAME_AS' END WHEN homonym THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS decision,
       members * (members - 1) // 2 AS pairs, first_member, first_member AS other_member FROM s WHERE members > 1
UNION ALL SELECT a.name, a.core_type, b.core_type, 'DISTINCT', a.members * b.members, a.first_member, b.first_member FROM s a JOIN s b ON a.name = b.name AND a.core_type < b.core_type
"""


def corpus_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a fact has and that are more than a mention."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("entity"), F.when(F.col("p_size") < 5, "MENTION_ONLY").when(F.col("p_size") < 10, "DOCUMENT_SCOPED").alias("admission"))
    return corpus_scope(part, facts(spark, sf_dir)).select("entity")


CORPUS_ENTITIES = "SELECT DISTINCT 'part:' || p_partkey AS entity FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size >= 10 OR p_size IS NULL"

# claims: a turn of an assistant against all turns before it


def grounded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, how many of its tokens stand in earlier turns of its conversation, and whether all do."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode_outer(content_tokens(F.col("text"))).alias("t"))
    first = rows.withColumn("since", F.min("turn").over(Window.partitionBy("conv_id", "t")))
    n = F.count("t")
    known = F.count(F.when(F.col("since") < F.col("turn"), F.col("t")))
    return first.groupBy("conv_id", "turn").agg(n.alias("n_tokens"), known.alias("n_known"), ((n > 0) & (n == known)).alias("grounded"))


GROUNDED_TURNS = f"""
WITH r AS (SELECT conv_id, turn, list_filter(list_distinct({TOKENS_SQL.format('text')}), lambda t: NOT list_contains({STOP_SQL}, t)) AS ts FROM conversations),
x AS (SELECT conv_id, turn, t, min(turn) OVER (PARTITION BY conv_id, t) AS since FROM (SELECT conv_id, turn, unnest(ts) AS t FROM r))
SELECT conv_id, turn, count(t) AS n_tokens, count(t) FILTER (since < turn) AS n_known, count(t) > 0 AND count(t) = count(t) FILTER (since < turn) AS grounded
FROM (SELECT conv_id, turn FROM r GROUP BY ALL) LEFT JOIN x USING (conv_id, turn) GROUP BY ALL
"""

# run state

STAGES = ["view", "click", "signup", "purchase"]


def event_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.funnel(table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("stage")), STAGES)


EVENT_FUNNEL = """
WITH u AS (SELECT user_id, list(DISTINCT event_type) AS has FROM events GROUP BY user_id),
f AS (SELECT coalesce(list_min(list_filter([0, 1, 2, 3], lambda i: NOT list_contains(has, ['view', 'click', 'signup', 'purchase'][i + 1]))), 4) AS first FROM u)
SELECT ['view', 'click', 'signup', 'purchase'][i + 1] AS stage, count(*) FILTER (first > i) AS reached, count(*) FILTER (first = i) AS first_lost FROM f, range(4) r(i) GROUP BY i
"""


def run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a run of the stages: its first gap, by the latest outcomes."""
    e = table(spark, sf_dir, "events").withColumn("outcome", F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "ok").otherwise("failed"))
    latest = K.latest_attempts(e, "user_id", "event_type", "outcome", "ts", "event_id")
    return K.stage_gaps(latest.select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "outcome", F.col("attempts").alias("n")), STAGES)


RUN_GAPS = """
WITH l AS (SELECT user_id AS run, event_type AS stage, arg_max(CASE WHEN (props::JSON->>'k')::INT % 2 = 0 THEN 'ok' ELSE 'failed' END, (ts, event_id)) AS outcome, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT run, coalesce(list(stage) FILTER (outcome = 'ok'), []) AS ok, coalesce(list(stage) FILTER (outcome <> 'ok' AND n >= 3), []) AS worn FROM l GROUP BY run),
g AS (SELECT *, list_filter(['view', 'click', 'signup', 'purchase'], lambda s: NOT list_contains(ok, s))[1] AS gap FROM r)
SELECT run, CASE WHEN gap IS NULL THEN 'READY' WHEN list_contains(worn, gap) THEN 'FAILED' ELSE 'GAP' END AS state, gap,
       len(list_filter(['view', 'click', 'signup', 'purchase'], lambda s: list_contains(ok, s))) AS done FROM g
"""


def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's artifact: the last properties of each type of event."""
    return K.merged_artifacts(table(spark, sf_dir, "events"), "user_id", "event_type", "props", "ts", "event_id")


RUN_ARTIFACTS = """
SELECT user_id, string_agg(event_type || '=' || coalesce(v, ''), chr(10) ORDER BY event_type) AS artifact
FROM (SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS v FROM events GROUP BY ALL) GROUP BY user_id
"""


def fact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by whether their lines were shipped before 1998, since, or both."""
    lines = table(spark, sf_dir, "lineitem").withColumn("fact", F.concat(F.lit("part:"), "l_partkey", F.lit("|"), "l_returnflag", F.lit("|supp:"), "l_suppkey"))
    return K.delta(lines.where("l_shipdate < timestamp'1998-01-01'"), lines.where("l_shipdate >= timestamp'1998-01-01'"), "fact")


FACT_CHANGES = f"""
WITH f AS (SELECT 'part:' || l_partkey || '|' || l_returnflag || '|supp:' || l_suppkey AS fact, bool_or(l_shipdate < TIMESTAMP '1998-01-01') AS b, bool_or(l_shipdate >= TIMESTAMP '1998-01-01') AS a FROM lineitem GROUP BY ALL)
SELECT fact, CASE WHEN a AND b THEN 'KEPT' WHEN a THEN 'ADDED' ELSE 'LOST' END AS change FROM f
"""


def source_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest (English ones enabled) against those with labels as known (a toxic one failed; a text whose length is odd had changed)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("enabled"), F.pmod(F.length("text"), F.lit(2)).alias("odd"))
    known = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.when(F.col("odd") == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("toxic") == 1, "failed").otherwise("ok").alias("status"))
    return K.manifest_plan(docs.select("source", "content_hash", "enabled"), known)


SOURCE_PLAN = """
WITH d AS (SELECT doc_id, doc_id::VARCHAR AS source, sha256(coalesce(text, '')) AS h, coalesce(lang = 'en', false) AS enabled, length(text) % 2 AS odd FROM documents),
k AS (SELECT doc_id, CASE WHEN odd = 1 THEN 'old' ELSE h END AS known_hash, toxic = 1 AS failed FROM d JOIN labels USING (doc_id))
SELECT source, CASE WHEN NOT enabled AND k.doc_id IS NOT NULL THEN 'RETIRE' WHEN NOT enabled THEN 'SKIP' WHEN k.doc_id IS NULL THEN 'INGEST' WHEN h <> known_hash THEN 'UPDATE' WHEN failed THEN 'RETRY' ELSE 'NOOP' END AS action,
       true AS in_manifest, known_hash FROM d LEFT JOIN k USING (doc_id)
"""

# evaluation and counts


def lane_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10, precision at 10 and reciprocal rank of the vector lane, a hit being a vector of the query's label."""
    v = table(spark, sf_dir, "embeddings")
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")).join(sizes.withColumnRenamed("label", "own"), "own")
    hits = dense_lane(spark, sf_dir).join(q, "query_id")
    good = F.col("label") == F.col("own")
    at10 = F.count(F.when(good & (F.col("rank") < 10), 1))
    first = F.min(F.when(good, F.col("rank") + 1))
    m = hits.groupBy("query_id", "relevant").agg(at10.alias("at10"), first.alias("first"))
    return m.select("query_id", F.round(F.when(F.col("relevant") > 0, F.col("at10") / F.col("relevant")), 9).alias("recall_10"), F.round(F.col("at10") / 10, 9).alias("precision_10"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("reciprocal_rank"))


LANE_METRICS = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS own, count(*) OVER (PARTITION BY label) - 1 AS relevant FROM embeddings),
s AS (
  SELECT query_id, own, relevant, v.vec_id, v.label, round(list_dot_product(q, e) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e))), 6) AS score
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) v JOIN q ON v.vec_id <> query_id WHERE query_id % 100 = 0
),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s) WHERE rank < 50),
m AS (SELECT query_id, relevant, count(*) FILTER (label = own AND rank < 10) AS at10, min(rank + 1) FILTER (label = own) AS first FROM h GROUP BY ALL)
SELECT query_id, round(CASE WHEN relevant > 0 THEN at10 / relevant END, 9) AS recall_10, round(at10 / 10, 9) AS precision_10, round(coalesce(1 / first, 0), 9) AS reciprocal_rank FROM m
"""


def common_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent tokens of each source."""
    tokens = table(spark, sf_dir, "documents").select("source", F.explode(query_tokens(F.col("text"))).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n"))
    return tokens.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token")) - 1).where("rank < 20")


COMMON_TOKENS = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) - 1 AS rank FROM (
  SELECT source, token, count(*) AS n FROM (SELECT source, unnest({TOKENS_SQL.format('text')}) AS token FROM documents) GROUP BY ALL)) WHERE rank < 20
"""


def order_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order, how many of its facts have each predicate, as text."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    line = F.concat(F.col("l_returnflag"), F.lit(":"), F.col("n"))
    return n.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("predicates"))


ORDER_PREDICATES = """
SELECT l_orderkey, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag || ':' || n) AS predicates FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey
"""


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each benchmark text's ten best documents an excerpt around its rarest long token."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("passage"))
    terms = asked(spark, sf_dir).select("query_id", content_tokens(F.col("text")).alias("terms"))
    met = lexical_top(spark, sf_dir).select("query_id", "doc_id", "rank").join(docs, "doc_id").repartition("query_id", "doc_id").join(terms, "query_id")
    return met.select("query_id", "rank", "doc_id", E.excerpt(F.col("passage"), F.col("terms")).alias("excerpt"))


# sources


def plain_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of bytes with a mark, CRLF and several names, read back."""
    body = F.concat(F.lit(b"\xef\xbb\xbf"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n")).cast("binary"))
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".TXT", ".bin"))), F.pmod(F.col("doc_id"), F.lit(4)).cast("int") + 1)
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), ending).alias("path"), body.alias("content"), F.lit(None).cast("string").alias("media_type"))
    return materialized(files).select("path", "format", "doc_id", "content_hash", "status", "error", F.get("parts", F.lit(0))["end"].alias("n_chars"))


PLAIN_SOURCES = r"""
WITH f AS (SELECT doc_id::VARCHAR || ['.txt', '.md', '.TXT', '.bin'][doc_id % 4 + 1] AS path, nfc_normalize(coalesce(text, '')) AS t, ['text', 'markdown', 'text', NULL][doc_id % 4 + 1] AS format FROM documents)
SELECT path, format, 'doc_' || sha256(t) AS doc_id, CASE WHEN format IS NOT NULL THEN sha256(t) END AS content_hash,
       CASE WHEN format IS NULL THEN 'FAILED' WHEN NOT regexp_matches(t, '\S') THEN 'EMPTY' ELSE 'OK' END AS status, CASE WHEN format IS NULL THEN 'UNSUPPORTED_FORMAT' END AS error,
       CASE WHEN format IS NOT NULL THEN length(t) END AS n_chars
FROM f
"""


def document_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document a name-based id, its first year and the lookup form of its first line."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", uuid5("00000000-0000-0000-0000-000000000000", F.concat(F.lit("documents:"), "doc_id")).alias("point"), first_year(text).alias("year"), lookup_form(F.substring_index(text, "\n", 1)).alias("form"))


DOCUMENT_FORMS = r"""
WITH s AS (SELECT doc_id, text, sha1(unhex(repeat('00', 16)) || ('documents:' || doc_id)::BLOB) AS x FROM documents)
SELECT doc_id, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || lower(printf('%02x', (('0x' || x[17:18])::INT & 63) | 128)) || x[19:20] || '-' || x[21:32] AS point,
       nullif(regexp_extract(' ' || coalesce(text, '') || ' ', '[^0-9A-Za-z]([12][0-9]{3})[^0-9A-Za-z]', 1), '')::INT AS year,
       regexp_replace(trim(regexp_replace(regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[1]), '[-_/]', ' ', 'g'), '\s+', ' ', 'g')), '^(?:the|a|an) ', '') AS form
FROM s
"""


def document_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines of one kind in every document."""
    return regions(table(spark, sf_dir, "documents"))
