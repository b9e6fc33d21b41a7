"""Queries of reprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import reprocess as R
from gneiss.session import table


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    part = lambda key: F.concat(F.lit("part:"), key)
    fact = lambda key: F.concat_ws("|", part(key), "l_returnflag", "l_suppkey").alias("fact")
    least = F.col("l_partkey") - F.col("l_partkey") % 3
    rows = lambda df, key: df.select(fact(key), F.col("l_returnflag").alias("predicate"), part(key).alias("subject"), F.concat(F.lit("supp:"), "l_suppkey").alias("object"))
    before = rows(lines.where("l_shipdate < timestamp'1998-01-01'"), F.col("l_partkey"))
    after = rows(lines.where("l_shipdate >= timestamp'1993-01-01'"), least)
    moves = table(spark, sf_dir, "part").select(part(F.col("p_partkey")).alias("old"), part(F.col("p_partkey") - F.col("p_partkey") % 3).alias("new"))
    return R.fact_delta(before, after, moves)


def reprocessed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of lines shipped before 1998 against those since 1993, each three parts having become one."""
    return _delta(spark, sf_dir)


def reprocessed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delta_counts(_delta(spark, sf_dir))


DELTA_CTE = """
b AS (SELECT DISTINCT l_partkey AS p, l_returnflag AS f, l_suppkey AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
a AS (SELECT DISTINCT l_partkey - l_partkey % 3 AS p, l_returnflag AS f, l_suppkey AS s FROM lineitem WHERE l_shipdate >= TIMESTAMP '1993-01-01'),
m AS (SELECT *, p - p % 3 AS t, p % 3 <> 0 AS moved FROM b WHERE p IN (SELECT p_partkey FROM part) OR p % 3 = 0),
j AS (SELECT m.p AS old_p, m.f AS of, m.s AS os, m.moved, a.p AS new_p, a.f AS nf, a.s AS ns FROM m FULL JOIN a ON a.p = m.t AND a.f = m.f AND a.s = m.s),
n AS (SELECT new_p, nf, ns, count(old_p) AS n FROM j WHERE new_p IS NOT NULL GROUP BY ALL),
delta AS (
  SELECT CASE WHEN old_p IS NULL THEN 'GAINED' WHEN j.new_p IS NULL THEN 'LOST' WHEN moved AND n > 1 THEN 'MERGED' WHEN moved THEN 'MOVED' ELSE 'KEPT' END AS change,
         'part:' || old_p || '|' || of || '|' || os AS old_fact, 'part:' || j.new_p || '|' || j.nf || '|' || j.ns AS new_fact, coalesce(n, 0) AS sources
  FROM j LEFT JOIN n ON n.new_p = j.new_p AND n.nf = j.nf AND n.ns = j.ns
)"""
REPROCESSED_FACTS = f"WITH {DELTA_CTE} SELECT * FROM delta"
REPROCESSED_COUNTS = f"WITH {DELTA_CTE} SELECT change, count(*) AS facts, count(DISTINCT new_fact) AS targets FROM delta GROUP BY change"
