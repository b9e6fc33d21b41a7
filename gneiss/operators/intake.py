"""Manifests against what is stored, and runs against their stages: what is to be done next, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intake_plan(entries: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """corpus_id, source, action, state, run_status, previous: a row for each entry of a manifest.

    entries: corpus_id, source, enabled, content_hash (null: the file can't be read), format (null: none that is known); documents: corpus_id, source, content_hash of what is stored;
    runs: corpus_id, content_hash, status. The first that holds: disabled entries are SKIP_DISABLED; a missing file is ERROR_MISSING, an unknown format ERROR_INVALID; a run of this content is
    NOOP if it is ready for queries or still going, RETRY if it failed; content that another corpus has is NOOP; all else is INGEST, as
    changed_content, with the content that the source had, or new. Repeated documents and runs don't multiply entries: of several runs one that is ready counts, then one that goes on.
    """
    place = F.when(F.col("status") == "query_ready", 0).when(F.col("status") == "failed", 2).otherwise(1)
    run = runs.groupBy("corpus_id", "content_hash").agg(F.min(F.struct(place.alias("p"), "status"))["status"].alias("run_status"))
    owner = documents.groupBy("content_hash").agg(F.min("corpus_id").alias("low"), F.max("corpus_id").alias("high"))
    prior = documents.groupBy("corpus_id", "source").agg(F.max("content_hash").alias("previous"))
    met = entries.join(run, ["corpus_id", "content_hash"], "left").join(owner, "content_hash", "left").join(prior, ["corpus_id", "source"], "left")
    elsewhere = F.coalesce((F.col("low") != F.col("corpus_id")) | (F.col("high") != F.col("corpus_id")), F.lit(False))
    state = (
        F.when(~F.coalesce("enabled", F.lit(False)), "disabled").when(F.col("content_hash").isNull(), "missing").when(F.col("format").isNull(), "invalid").when(F.col("run_status") == "query_ready", "query_ready")
        .when(F.col("run_status") == "failed", "failed_retryable").when(F.col("run_status").isNotNull(), "currently_running").when(elsewhere, "elsewhere").when(F.col("previous").isNotNull(), "changed_content").otherwise("new")
    )
    action = (
        F.when(F.col("state") == "disabled", "SKIP_DISABLED").when(F.col("state") == "missing", "ERROR_MISSING").when(F.col("state") == "invalid", "ERROR_INVALID")
        .when(F.col("state") == "failed_retryable", "RETRY").when(F.col("state").isin("changed_content", "new"), "INGEST").otherwise("NOOP")
    )
    judged = met.withColumn("state", state)
    return judged.select("corpus_id", "source", action.alias("action"), "state", "run_status", F.when(F.col("state") == "changed_content", F.col("previous")).alias("previous"))


def intake_report(plan: DataFrame) -> DataFrame:
    """corpus_id, action, state, sources of a plan."""
    return plan.groupBy("corpus_id", "action", "state").agg(F.count("*").alias("sources"))


def run_census(runs: DataFrame, attempts: DataFrame, stages: list[str], missing: DataFrame | None = None, tries: int = 3) -> DataFrame:
    """run, kind, stage, reason: every gap of every run, or that it failed, or that it may be promoted.

    runs: run; attempts: run, stage, outcome, n (the latest outcome and how many); missing: run, stage, n of receipts that its projections lack. A run without any attempt has the gap of its first
    stage alone. Each stage of the chain that isn't ok is a GAP with its reason, or FAIL once it failed `tries` times. A run whose stages are all ok has a GAP for each
    stage that lacks receipts, and is PROMOTE if none does. Each run is judged by itself.
    """
    last = attempts.groupBy("run", "stage").agg(F.max_by("outcome", "n").alias("outcome"), F.max("n").alias("n"))
    some = last.select("run").distinct().withColumn("some", F.lit(True))
    chain = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage")) for i, s in enumerate(stages)))
    every = runs.select("run").distinct().join(some, "run", "left").select("run", "some", F.explode(F.when(F.col("some"), chain).otherwise(F.slice(chain, 1, 1))).alias("c")).select("run", "some", "c.i", "c.stage")
    met = every.join(last, ["run", "stage"], "left").where("outcome IS NULL OR outcome <> 'ok'")
    failed = F.col("outcome") == "failed"
    kind = F.when(failed & (F.col("n") >= tries), "FAIL").otherwise("GAP")
    reason = F.when(F.col("some").isNull(), F.lit("no attempt recorded")).when(failed, F.concat_ws("", F.lit("stage "), "stage", F.lit(" failed; retry "), F.col("n").cast("string"), F.lit(f"/{tries}"))).otherwise(F.concat(F.lit("stage "), "stage", F.lit(" missing")))
    gaps = met.select("run", kind.alias("kind"), "stage", F.when(kind == "FAIL", F.concat(F.lit("stage "), "stage", F.lit(" failed for good"))).otherwise(reason).alias("reason"))
    whole = runs.select("run").distinct().join(gaps.select("run").distinct(), "run", "left_anti")
    if missing is None:
        return gaps.unionByName(whole.select("run", F.lit("PROMOTE").alias("kind"), F.lit(None).cast("string").alias("stage"), F.lit("all stages ok").alias("reason")))
    lacking = missing.where("n > 0").groupBy("run", "stage").agg(F.sum("n").alias("n"))
    lost = whole.join(lacking, "run").select("run", F.lit("GAP").alias("kind"), "stage", F.concat(F.col("n").cast("string"), F.lit(" projection receipts missing")).alias("reason"))
    fine = whole.join(lacking.select("run").distinct(), "run", "left_anti")
    return gaps.unionByName(lost).unionByName(fine.select("run", F.lit("PROMOTE").alias("kind"), F.lit(None).cast("string").alias("stage"), F.lit("all stages ok").alias("reason")))
