"""Queries over vectors, facts and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.admission import reference_class
from gneiss.operators.control import heartbeat_sessions, latest_attempts, reconcile, state_hash
from gneiss.operators.graph import conflicts, eligible, endpoints, hop
from gneiss.operators.nearest import array_vectors, nearest
from gneiss.operators.ranking import mmr, top_per
from gneiss.session import table
from gneiss.streaming.outbox import deliver_once, last_result, run_to_end, windowed_counts


VECTOR = {"vec_id": T.LongType(), "label": T.IntegerType()}


def _asked(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_lane(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """The n vectors most like each vector whose id is divisible by 100, itself left out."""
    v = table(spark, sf_dir, "embeddings")
    best = nearest(v, VECTOR, array_vectors, _asked(v), n + 1).where("vec_id <> query_id")
    return top_per(best.select("query_id", "vec_id", "label", "score"), ["query_id"], n, F.desc("score"), F.asc("vec_id"))


DENSE_CTE = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
scored AS (
  SELECT query_id, vec_id, label, round(list_dot_product(q, e) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e))), 6) AS score
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) v JOIN q ON vec_id <> query_id
),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM scored) WHERE rank < 50)"""
DENSE_LANE = f"WITH {DENSE_CTE} SELECT * FROM dense"


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best sections (labels) of each query in the dense lane, and the three best children of each among all vectors of the section."""
    hits = dense_lane(spark, sf_dir)
    sections = top_per(hits.groupBy("query_id", "label").agg(F.min("rank").alias("best")), ["query_id"], 2, F.asc("best"), F.asc("label"), name="section_rank")
    v = table(spark, sf_dir, "embeddings")
    best = nearest(v, VECTOR, array_vectors, _asked(v), 4, group="label").where("vec_id <> query_id").join(sections, ["query_id", "label"])
    return top_per(best, ["query_id", "label"], 3, F.desc("score"), F.asc("vec_id"), name="child_rank").select("query_id", "label", "section_rank", "vec_id", "child_rank")


SECTION_CHILDREN = f"""
WITH {DENSE_CTE},
sections AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, label) - 1 AS section_rank FROM (SELECT query_id, label, min(rank) AS best FROM dense GROUP BY ALL)),
kids AS (SELECT query_id, label, section_rank, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) - 1 AS child_rank FROM scored JOIN sections USING (query_id, label) WHERE section_rank < 2)
SELECT * FROM kids WHERE child_rank < 3
"""


def diverse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each query's fifteen nearest by marginal relevance."""
    near = dense_lane(spark, sf_dir, 15).select("query_id", "vec_id", "score")
    return mmr(near.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id"), "query_id", "vec_id", "score", "embedding", 5, 0.7)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts supplied by suppliers, as facts with the return flag as predicate: fact, subject, predicate, object, lines."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("predicate")).agg(F.count("*").alias("lines"))
    subject, object_ = F.concat(F.lit("part:"), "p"), F.concat(F.lit("supp:"), "s")
    return rows.select(F.concat_ws("|", subject, "predicate", object_).alias("fact"), subject.alias("subject"), "predicate", object_.alias("object"), "lines")


FACTS_CTE = """facts AS (
  SELECT 'part:' || l_partkey || '|' || l_returnflag || '|supp:' || l_suppkey AS fact, 'part:' || l_partkey AS subject, l_returnflag AS predicate, 'supp:' || l_suppkey AS object, count(*) AS lines
  FROM lineitem GROUP BY ALL)"""


def entity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints(facts(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("facts"), F.countDistinct("predicate").alias("predicates"))


ENTITY_DEGREE = f"""
WITH {FACTS_CTE} SELECT entity, count(*) AS facts, count(DISTINCT predicate) AS predicates
FROM (SELECT subject AS entity, predicate FROM facts UNION ALL SELECT object, predicate FROM facts WHERE object <> subject) GROUP BY entity
"""


def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts at every part and supplier whose key is divisible by 100, once for each seed."""
    part = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("seed"))
    supp = table(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0").select(F.concat(F.lit("supp:"), "s_suppkey").alias("seed"))
    return hop(facts(spark, sf_dir), part.unionByName(supp)).select("seed", "fact", "lines")


ONE_HOP = f"""
WITH {FACTS_CTE}, seeds AS (SELECT 'part:' || p_partkey AS seed FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT 'supp:' || s_suppkey FROM supplier WHERE s_suppkey % 100 = 0)
SELECT seed, fact, lines FROM facts JOIN seeds ON seed = subject UNION SELECT seed, fact, lines FROM facts JOIN seeds ON seed = object
"""


def eligible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of admitted parts (of at least size 5) and all suppliers; a part's null size counts as unknown, so it stays."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("entity"), F.when(F.col("p_size") < 5, "MENTION_ONLY").alias("admission"))
    supp = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supp:"), "s_suppkey").alias("entity"), F.lit("GLOBAL").alias("admission"))
    return eligible(facts(spark, sf_dir), part.unionByName(supp)).select("fact", "lines")


ELIGIBLE_FACTS = f"""
WITH {FACTS_CTE} SELECT fact, lines FROM facts
WHERE subject IN (SELECT 'part:' || p_partkey FROM part WHERE p_size >= 5 OR p_size IS NULL) AND object IN (SELECT 'supp:' || s_suppkey FROM supplier)
"""


def competing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(facts(spark, sf_dir).select("fact", "subject", "predicate", "object")).select("fact", "subjects", "predicates")


COMPETING_FACTS = f"""
WITH {FACTS_CTE}, o AS (SELECT predicate, object, count(DISTINCT subject) AS subjects FROM facts GROUP BY ALL), p AS (SELECT subject, object, count(DISTINCT predicate) AS predicates FROM facts GROUP BY ALL)
SELECT fact, subjects, predicates FROM facts JOIN o USING (predicate, object) JOIN p USING (subject, object) WHERE subjects > 1 OR predicates > 1
"""


def admission_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", reference_class(F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("reference_class"))


def projection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not finished as what should be, returned lines as receipts, open lines as what is stored: each key's state."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").alias("key")
    desired = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("key"))
    return reconcile(desired, lines.where("l_returnflag = 'R'").select(key), lines.where("l_linestatus = 'O'").select(key))


PROJECTION_STATES = """
WITH k AS (SELECT o_orderkey AS key, 'd' AS w FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT l_orderkey, 'r' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 's' FROM lineitem WHERE l_linestatus = 'O'),
m AS (SELECT key, bool_or(w = 'd') AS d, bool_or(w = 'r') AS r, bool_or(w = 's') AS s FROM k GROUP BY key)
SELECT key, CASE WHEN d AND r AND s THEN 'ok' WHEN d AND r THEN 'lost' WHEN d AND s THEN 'missing_receipt' WHEN d THEN 'pending' WHEN r AND s THEN 'orphan' WHEN r THEN 'orphan_receipt' ELSE 'untracked' END AS state FROM m
"""


def missing_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


MISSING_PROJECTIONS = "SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)"


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("outcome", F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "ok").otherwise("failed"))
    return latest_attempts(e, "user_id", "event_type", "outcome", "ts", "event_id")


CENSUS = """
SELECT user_id, event_type, arg_max(CASE WHEN (props::JSON->>'k')::INT % 2 = 0 THEN 'ok' ELSE 'failed' END, (ts, event_id)) AS outcome, count(*) AS attempts FROM events GROUP BY ALL
"""


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heartbeat_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600).select("user_id", "session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "beats")


HEARTBEATS = """
WITH g AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS beats FROM n GROUP BY user_id, session
"""


def order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_hash(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


ORDER_STATE = """
WITH b AS (
  SELECT o_custkey, o_orderkey // 1024 AS block, sha256(string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY ALL
)
SELECT o_custkey, sha256(string_agg(digest, chr(10) ORDER BY block)) AS state FROM b GROUP BY o_custkey
"""


def outbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered through a stream, each once. A file stream takes a folder or a pattern, so the one file is named by a pattern."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return run_to_end(deliver_once(spark.readStream.schema(schema).parquet(f"{path[:-1]}[t]"), "event_id", "ts")).groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("keys"))


OUTBOX_STREAM = "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS keys FROM events GROUP BY event_type"


def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts per type through a stream in complete mode: all windows, as of its last batch."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    counts = windowed_counts(spark.readStream.schema(schema).parquet(f"{path[:-1]}[t]"), "ts", "event_type", "1 day")
    return last_result(counts.select(F.unix_seconds("w.start").alias("day_s"), "event_type", "count"))


WINDOWED_STREAM = "SELECT epoch(date_trunc('day', ts))::BIGINT AS day_s, event_type, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY ALL"


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a plain rule on the quality labels, per source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.rlike(F.coalesce("text", F.lit("")), F.lit("###|[|]|!!")).alias("odd"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bad = F.col("quality") == 0
    m = rows.groupBy("source").agg(hit(F.col("odd") & bad).alias("tp"), hit(F.col("odd") & ~bad).alias("fp"), hit(~F.col("odd") & bad).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 9)
    return m.select("source", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


QUALITY_METRICS = """
WITH r AS (SELECT source, regexp_matches(coalesce(text, ''), '###|[|]|!!') AS odd, quality = 0 AS bad FROM documents JOIN labels USING (doc_id)),
m AS (SELECT source, count(*) FILTER (odd AND bad) AS tp, count(*) FILTER (odd AND NOT bad) AS fp, count(*) FILTER (NOT odd AND bad) AS fn FROM r GROUP BY source)
SELECT source, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM m
"""
