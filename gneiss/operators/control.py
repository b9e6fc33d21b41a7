"""Desired against observed state: reconciliation, latest attempts, sessions of heartbeats, state hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(desired: DataFrame, receipts: DataFrame, stored: DataFrame) -> DataFrame:
    """Tables of distinct `key`: each key with what should be, is receipted and is stored, as a state."""
    mark = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    every = mark(desired, "d").join(mark(receipts, "r"), "key", "full").join(mark(stored, "s"), "key", "full")
    d, r, s = (F.coalesce(c, F.lit(False)) for c in ("d", "r", "s"))
    state = (
        F.when(d & r & s, "ok").when(d & r, "lost").when(d & s, "missing_receipt").when(d, "pending")
        .when(r & s, "orphan").when(r, "orphan_receipt").otherwise("untracked")
    )
    return every.select("key", state.alias("state"))


def latest_attempts(attempts: DataFrame, run: str, stage: str, outcome: str, at: str, tie: str) -> DataFrame:
    """Per run and stage: the last outcome and the number of attempts."""
    return attempts.groupBy(run, stage).agg(F.max_by(outcome, F.struct(at, tie)).alias("outcome"), F.count("*").alias("attempts"))


def heartbeat_sessions(beats: DataFrame, owner: str, at: str, tie: str, gap_seconds: int) -> DataFrame:
    """Spells of an owner without a silence above the gap: owner, session (from 0), start, end, beats."""
    beats = beats.withColumn(at, F.col(at).cast("timestamp"))
    w = Window.partitionBy(owner).orderBy(at, tie)
    silent = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) > gap_seconds * 1_000_000
    numbered = beats.withColumn("session", F.sum(F.when(silent, 1).otherwise(0)).over(w))
    return numbered.groupBy(owner, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("beats"))


def stage_gaps(attempts: DataFrame, stages: list[str], tries: int = 3) -> DataFrame:
    """attempts (run, stage, outcome, n: the latest outcome and how many) to run, state, gap, done: READY when all stages of the chain are ok, FAILED when the first that is not has
    failed `tries` times, GAP otherwise, with that stage."""
    ok = F.collect_set(F.when(F.col("outcome") == "ok", F.col("stage")))
    worn = F.collect_set(F.when((F.col("outcome") != "ok") & (F.col("n") >= tries), F.col("stage")))
    runs = attempts.groupBy("run").agg(ok.alias("ok"), worn.alias("worn"))
    chain = F.array(*map(F.lit, stages))
    gap = F.get(F.filter(chain, lambda s: ~F.array_contains("ok", s)), F.lit(0))
    state = F.when(gap.isNull(), "READY").when(F.array_contains("worn", gap), "FAILED").otherwise("GAP")
    return runs.select("run", state.alias("state"), gap.alias("gap"), F.size(F.array_intersect("ok", chain)).alias("done"))


def funnel(reached: DataFrame, stages: list[str]) -> DataFrame:
    """reached (item, stage) to stage, reached, first_lost: how many items have it and every stage before it, and for how many it is the first they lack."""
    chain = F.array(*map(F.lit, stages))
    own = reached.groupBy("item").agg(F.collect_set("stage").alias("has"))
    first = F.get(F.filter(F.transform(chain, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: ~F.array_contains("has", x["s"])), F.lit(0))["i"]
    lost = own.groupBy(F.coalesce(first, F.lit(len(stages))).alias("first")).count()
    each = lost.withColumn("x", F.explode(F.transform(chain, lambda s, i: F.struct(s.alias("stage"), i.alias("i")))))
    return each.groupBy("x.stage").agg(F.sum(F.when(F.col("first") > F.col("x.i"), F.col("count")).otherwise(0)).alias("reached"), F.sum(F.when(F.col("first") == F.col("x.i"), F.col("count")).otherwise(0)).alias("first_lost"))


def merged_artifacts(rows: DataFrame, run: str, key: str, value: str, *order: str) -> DataFrame:
    """run, artifact: its keys with their last values, as key=value lines by key."""
    last = rows.groupBy(run, key).agg(F.max_by(value, F.struct(*order)).alias("v"))
    line = F.concat(F.col(key), F.lit("="), F.coalesce(F.col("v").cast("string"), F.lit("")))
    return last.groupBy(run).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("artifact"))


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: KEPT, ADDED or LOST between two tables of keys."""
    marked = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    met = marked(before, "b").join(marked(after, "a"), key, "full")
    return met.select(key, F.when(F.col("b") & F.col("a"), "KEPT").when(F.col("a"), "ADDED").otherwise("LOST").alias("change"))


def manifest_plan(entries: DataFrame, known: DataFrame) -> DataFrame:
    """entries (source, content_hash, enabled) of a manifest and known (source, content_hash, status) to source, action, in_manifest, known_hash.

    INGEST what is new, UPDATE what changed, RETRY what failed, NOOP what is there, RETIRE what is known and no longer listed or disabled; DUPLICATE all but the first entry of one source.
    """
    first = entries.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("enabled"), "content_hash")))
    met = first.select("source", F.col("content_hash").alias("new_hash"), "enabled", "n").join(known.select("source", F.col("content_hash").alias("known_hash"), "status"), "source", "full")
    listed, there = F.coalesce(F.col("enabled"), F.lit(False)), F.col("status").isNotNull()
    action = (
        F.when(F.col("n") > 1, "DUPLICATE").when(~listed & there, "RETIRE").when(~listed, "SKIP").when(~there, "INGEST")
        .when(F.col("new_hash") != F.col("known_hash"), "UPDATE").when(F.col("status") == "failed", "RETRY").otherwise("NOOP")
    )
    return met.select("source", action.alias("action"), F.col("n").isNotNull().alias("in_manifest"), "known_hash")


#: Order keys of one block of a state hash.
SPAN = 1024


def state_hash(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """Per group: SHA-256 over the digests of its blocks in order; a block is the rows whose first order column, an integer, has the same quotient by
    SPAN, and its digest the SHA-256 over their JSON in order. So a group of any size is hashed in arrays of a block's rows, and of 64 bytes a block."""
    row = F.struct(*order)
    lines = lambda xs, f: F.array_join(F.transform(F.array_sort(xs), f), "\n")
    blocks = rows.withColumn("block", F.floor(F.col(order[0]) / SPAN)).groupBy(by, "block").agg(F.sha2(lines(F.collect_list(row), lambda r: F.to_json(r)), 256).alias("digest"))
    return blocks.groupBy(by).agg(F.sha2(lines(F.collect_list(F.struct("block", "digest")), lambda b: b["digest"]), 256).alias("state"))
