"""Manifest actions and the census of runs on small cases."""

from gneiss.operators import intake as I


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_manifest_actions(spark):
    entries = spark.createDataFrame(
        [("c", "a", True, "1", "text"), ("c", "b", True, "2", "text"), ("c", "d", False, "2", "text"), ("c", "e", True, None, "text"), ("c", "f", True, "9", None), ("c", "g", True, "3", "text"), ("c", "h", True, "4", "text"), ("c", "i", True, "5", "text"), ("c", "j", None, "5", "text"), ("c", "b", True, "2", "text")],
        "corpus_id string, source string, enabled boolean, content_hash string, format string",
    )
    documents = spark.createDataFrame([("c", "b", "2"), ("c", "b", "2"), ("o", "x", "4"), ("c", "i", "old")], "corpus_id string, source string, content_hash string")
    runs = spark.createDataFrame([("c", "2", "failed"), ("c", "2", "query_ready"), ("c", "3", "failed"), ("o", "1", "query_ready")], "corpus_id string, content_hash string, status string")
    got = rows(I.intake_plan(entries, documents, runs).select("source", "action", "state", "previous"))
    assert got == sorted([
        ("a", "INGEST", "new", None), ("b", "NOOP", "query_ready", None), ("b", "NOOP", "query_ready", None), ("d", "SKIP_DISABLED", "disabled", None), ("e", "ERROR_MISSING", "missing", None), ("f", "ERROR_INVALID", "invalid", None),
        ("g", "RETRY", "failed_retryable", None), ("h", "NOOP", "elsewhere", None), ("i", "INGEST", "changed_content", "old"), ("j", "SKIP_DISABLED", "disabled", None),
    ], key=str)
    assert {(r.action, r.state): r.sources for r in I.intake_report(I.intake_plan(entries, documents, runs)).collect()}["NOOP", "query_ready"] == 2


def test_census_has_every_gap_with_its_reason(spark):
    runs = spark.createDataFrame([(i,) for i in range(1, 8)], "run int")
    attempts = spark.createDataFrame([(1, "x", "ok", 1), (1, "y", "ok", 2), (2, "x", "failed", 2), (3, "x", "failed", 3), (3, "y", "ok", 1), (5, "x", "ok", 1), (5, "y", "ok", 1), (6, "y", "ok", 1), (7, "x", "ok", 1), (7, "y", "ok", 1)], "run int, stage string, outcome string, n long")
    missing = spark.createDataFrame([(5, "y", 2), (7, "y", 0), (2, "y", 9)], "run int, stage string, n long")
    assert rows(I.run_census(runs, attempts, ["x", "y"], missing)) == sorted([
        (1, "PROMOTE", None, "all stages ok"), (2, "GAP", "x", "stage x failed; retry 2/3"), (2, "GAP", "y", "stage y missing"), (3, "FAIL", "x", "stage x failed for good"), (4, "GAP", "x", "no attempt recorded"),
        (5, "GAP", "y", "2 projection receipts missing"), (6, "GAP", "x", "stage x missing"), (7, "PROMOTE", None, "all stages ok"),
    ], key=str)
    assert (5, "PROMOTE", None, "all stages ok") in rows(I.run_census(runs, attempts, ["x", "y"]))
