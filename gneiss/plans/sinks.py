"""Queries of sinks: upserts by attempt, replaced groups, batches committed with their receipts, and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.store import Store, active_claims, commit_stream, upsert
from gneiss.session import table
from gneiss.storage import shared_folder


def order_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in one load, the open ones again as delivered in a second that is run twice."""
    store = Store(spark, shared_folder(spark))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit("first").alias("load"))
    store.commit("load-1", {"orders": upsert(orders, "o_orderkey")})
    late = orders.where("o_orderstatus = 'O'").withColumn("o_orderstatus", F.lit("D")).withColumn("load", F.lit("second"))
    for _ in range(2):
        store.commit("load-2", {"orders": upsert(late, "o_orderkey")}, {"rows": "open"})
    return store.read("orders")


ORDER_UPSERTS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'D' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 'second' ELSE 'first' END AS load FROM orders"


def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a registry of each nation: every second nation is replaced by its customers in credit; both versions can be read."""
    store = Store(spark, shared_folder(spark))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") > 0).alias("credit"))
    one = store.commit("all", {"registry": upsert(rows, "c_nationkey")})
    two = store.commit("even", {"registry": upsert(rows.where("c_nationkey % 2 = 0 AND credit"), "c_nationkey")})
    return store.read("registry", one).withColumn("version", F.lit(one)).unionByName(store.read("registry", two).withColumn("version", F.lit(two)))


REGISTRY_VERSIONS = """
SELECT c_nationkey, c_custkey, c_acctbal > 0 AS credit, 1 AS version FROM customer
UNION ALL SELECT c_nationkey, c_custkey, c_acctbal > 0, 2 FROM customer WHERE c_nationkey % 2 <> 0 OR c_acctbal > 0
"""


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into two tables, its batches committed with their receipts; the whole stream is delivered twice."""
    store, at = Store(spark, shared_folder(spark)), shared_folder(spark)
    schema = table(spark, sf_dir, "events").schema

    def changes(batch: DataFrame) -> dict:
        rows = batch.select("event_id", "user_id", "event_type").dropDuplicates(["event_id"])
        return {"events": upsert(rows, "event_id"), "users": upsert(rows.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")}

    for k in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        commit_stream(stream, store, "events", changes, f"{at}/{k}")
    state = store.snapshot({"buckets": store.buckets})
    version = store.validated(state, {"buckets": store.buckets}).version
    committed = store.receipts().agg(F.sum(F.get_json_object("receipt", "$.rows").cast("long"))).first()[0] or 0
    return store.read("events", version).join(store.read("users", version), "user_id").select("event_id", "user_id", "event_type", "n", F.lit(committed).cast("long").alias("committed"))


EVENT_COMMITS = "SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, (SELECT count(*) FROM events) AS committed FROM events"


def projection_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts to project users, every seventh of them as the loss of what was projected."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("projection"), F.lit("user").alias("kind"), F.col("user_id").alias("entity"), F.sha2(F.col("props"), 256).alias("receipt_hash"), F.col("ts").alias("at"), F.col("event_id").alias("attempt"))
    return active_claims(events.where("attempt % 7 <> 0"), events.where("attempt % 7 = 0"))


PROJECTION_CLAIMS = """
WITH e AS (SELECT event_type AS projection, 'user' AS kind, user_id AS entity, sha256(props) AS receipt_hash, ts AS t, event_id AS attempt FROM events),
l AS (SELECT projection, kind, entity, arg_max(receipt_hash, (t, attempt)) AS receipt_hash, max(t) AS t, count(*) AS attempts FROM e WHERE attempt % 7 <> 0 GROUP BY ALL),
g AS (SELECT projection, entity, max(t) AS gone FROM e WHERE attempt % 7 = 0 GROUP BY ALL)
SELECT projection, kind, entity, receipt_hash, t AS "at", attempts, gone IS NULL OR gone < t AS active FROM l LEFT JOIN g USING (projection, entity)
"""
