"""Queries of manifests and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import intake as I
from gneiss.operators.control import latest_attempts
from gneiss.session import table

STAGES = ["view", "click", "signup", "purchase"]


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    entries = docs.select(
        F.concat(F.lit("c"), F.col("doc_id") % 2).alias("corpus_id"), F.col("doc_id").cast("string").alias("source"), F.coalesce(F.col("lang") != "de", F.lit(False)).alias("enabled"),
        F.when(F.col("doc_id") % 17 != 0, F.col("h")).alias("content_hash"), F.when(F.col("doc_id") % 13 != 0, "text").alias("format"),
    )
    held = docs.join(labels, "doc_id")
    stored = held.select(F.concat(F.lit("c"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2)).alias("corpus_id"), F.col("doc_id").cast("string").alias("source"), F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("h")).alias("content_hash"))
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "query_ready").otherwise("reconciling")
    runs = held.where("doc_id % 3 <> 0 AND doc_id % 5 <> 0").select(F.concat(F.lit("c"), F.col("doc_id") % 2).alias("corpus_id"), F.col("h").alias("content_hash"), status.alias("status"))
    return I.intake_plan(entries, stored, runs)


def manifest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the manifests of two corpora (none in German enabled, some missing, some of no known format) against the labelled ones as stored."""
    return _plan(spark, sf_dir)


def manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.intake_report(_plan(spark, sf_dir))


def run_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs of the stages that events are attempts at: all their gaps, failures and promotions."""
    events = table(spark, sf_dir, "events").withColumn("outcome", F.when(F.get_json_object("props", "$.k").cast("int") % 4 != 0, "ok").otherwise("failed"))
    latest = latest_attempts(events, "user_id", "event_type", "outcome", "ts", "event_id").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "outcome", F.col("attempts").alias("n"))
    lost = events.where("event_type = 'purchase' AND event_id % 11 = 0").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"))
    return I.run_census(runs, latest, STAGES, lost)


PLAN_CTE = """
d AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS h FROM documents),
e AS (SELECT 'c' || doc_id % 2 AS corpus_id, doc_id::VARCHAR AS source, coalesce(lang <> 'de', false) AS enabled, CASE WHEN doc_id % 17 <> 0 THEN h END AS ch, doc_id % 13 <> 0 AS known FROM d),
k AS (SELECT * FROM d JOIN labels USING (doc_id)),
st AS (SELECT 'c' || CASE WHEN doc_id % 5 = 0 THEN 1 - doc_id % 2 ELSE doc_id % 2 END AS corpus_id, doc_id::VARCHAR AS source, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE h END AS ch FROM k),
r AS (
  SELECT corpus_id, ch, arg_min(s, CASE s WHEN 'query_ready' THEN 0 WHEN 'failed' THEN 2 ELSE 1 END) AS run_status
  FROM (SELECT 'c' || doc_id % 2 AS corpus_id, h AS ch, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'query_ready' ELSE 'reconciling' END AS s FROM k WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0) GROUP BY ALL
),
judged AS (
  SELECT e.corpus_id, e.source, run_status, (SELECT max(ch) FROM st WHERE st.corpus_id = e.corpus_id AND st.source = e.source) AS previous,
         CASE WHEN NOT enabled THEN 'disabled' WHEN e.ch IS NULL THEN 'missing' WHEN NOT known THEN 'invalid' WHEN run_status = 'query_ready' THEN 'query_ready' WHEN run_status = 'failed' THEN 'failed_retryable'
           WHEN run_status IS NOT NULL THEN 'currently_running' WHEN EXISTS (SELECT 1 FROM st WHERE st.ch = e.ch AND st.corpus_id <> e.corpus_id) THEN 'elsewhere'
           WHEN EXISTS (SELECT 1 FROM st WHERE st.corpus_id = e.corpus_id AND st.source = e.source) THEN 'changed_content' ELSE 'new' END AS state
  FROM e LEFT JOIN r ON r.corpus_id = e.corpus_id AND r.ch = e.ch
),
plan AS (
  SELECT corpus_id, source, CASE state WHEN 'disabled' THEN 'SKIP_DISABLED' WHEN 'missing' THEN 'ERROR_MISSING' WHEN 'invalid' THEN 'ERROR_INVALID' WHEN 'failed_retryable' THEN 'RETRY' WHEN 'changed_content' THEN 'INGEST' WHEN 'new' THEN 'INGEST' ELSE 'NOOP' END AS action,
         state, run_status, CASE WHEN state = 'changed_content' THEN previous END AS previous FROM judged
)"""
MANIFEST_ACTIONS = f"WITH {PLAN_CTE} SELECT * FROM plan"
MANIFEST_REPORT = f"WITH {PLAN_CTE} SELECT corpus_id, action, state, count(*) AS sources FROM plan GROUP BY ALL"
RUN_CENSUS = """
WITH v AS (SELECT *, CASE WHEN (props::JSON->>'k')::INT % 4 <> 0 THEN 'ok' ELSE 'failed' END AS outcome FROM events),
l AS (SELECT user_id AS run, event_type AS stage, arg_max(outcome, (ts, event_id)) AS outcome, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT c_custkey AS run, c_custkey IN (SELECT run FROM l) AS has FROM customer),
c AS (SELECT run, has, unnest(CASE WHEN has THEN ['view', 'click', 'signup', 'purchase'] ELSE ['view'] END) AS stage FROM r),
g AS (
  SELECT run, stage, CASE WHEN outcome = 'failed' AND n >= 3 THEN 'FAIL' ELSE 'GAP' END AS kind,
         CASE WHEN NOT has THEN 'no attempt recorded' WHEN outcome = 'failed' AND n >= 3 THEN 'stage ' || stage || ' failed for good' WHEN outcome = 'failed' THEN 'stage ' || stage || ' failed; retry ' || n || '/3' ELSE 'stage ' || stage || ' missing' END AS reason
  FROM c LEFT JOIN l USING (run, stage) WHERE outcome IS NULL OR outcome <> 'ok'
),
w AS (SELECT run FROM r WHERE run NOT IN (SELECT run FROM g)),
m AS (SELECT user_id AS run, count(*) AS n FROM events WHERE event_type = 'purchase' AND event_id % 11 = 0 GROUP BY user_id)
SELECT run, kind, stage, reason FROM g
UNION ALL SELECT run, 'GAP', 'purchase', n || ' projection receipts missing' FROM w JOIN m USING (run)
UNION ALL SELECT run, 'PROMOTE', NULL, 'all stages ok' FROM w WHERE run NOT IN (SELECT run FROM m)
"""
