"""An incremental ledger of secret scans over content-addressed blobs (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and its least length.
    group: int
    least: int


#: The kinds in the order that breaks ties.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Forms of keys that name themselves.
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
    Rule("bearer", r"(Bearer\x20+)([A-Za-z0-9._~+/=-]+)", 2, 20),
)
#: Versions of rules: a changed rule takes a new name, and then only it is scanned anew. Kinds keep their order across versions.
VERSIONS = {"base-1": BASE, "more-1": MORE}
#: Matches walked one after another in one array.
PIECE = 256
LEDGER = "blob string, rule_version string, spans array<struct<start: int, ord: int, kind: string, end: int>>"
EMPTY = "cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>)"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's leftmost non-overlapping matches as structs (start, ord, kind, end), in code points."""
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    matches = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), held.alias("held"))
    span = lambda start, end: F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        spans = F.when(F.length(x["held"]) >= rule.least, F.concat(state["spans"], F.array(span(start, end)))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    # arrays that grow are copied at each match, so matches are walked in pieces of bounded size, whose places are then shifted
    begin = F.struct(F.lit(0).alias("at"), F.expr(EMPTY).alias("spans"))
    walked = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PIECE).cast("int")), lambda i: F.aggregate(F.slice(matches, i * PIECE + 1, F.lit(PIECE)), begin, step))
    shifts = F.aggregate(walked, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(F.try_element_at(out, F.lit(-1)) + x["at"])))
    shifted = F.zip_with(walked, shifts, lambda x, by: F.transform(x["spans"], lambda s: span(s["start"] + by, s["end"] + by)))
    return F.when(F.size(found) > 0, F.flatten(F.filter(shifted, lambda x: x.isNotNull()))).otherwise(F.expr(EMPTY))


def address(text: Column) -> Column:
    """The content address of a version; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: dict[str, tuple[Rule, ...]] = VERSIONS) -> DataFrame:
    """Scan the pairs of a blob of `versions` (path, text) and a rule version that `ledger` has not seen.

    Returns and writes the new ledger rows: blob, rule_version, spans. A blob is scanned once, whatever the number of paths and
    versions that have it, and by the rules of those versions alone that are new to it.
    """
    named = versions.select(
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), address(F.col("text")).alias("blob")
    )
    chosen = named.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*map(F.lit, rules))
    if ledger is None:
        chosen = chosen.withColumn("unseen", every)
    else:
        seen = ledger.where(F.col("rule_version").isin(*rules)).groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        chosen = chosen.join(seen, "blob", "left").withColumn("unseen", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("unseen") > 0)
    order = {rule: i for i, rule in enumerate(rule for of in rules.values() for rule in of)}
    spans_by = {v: F.array_sort(F.concat(*(spans_of(F.col("text"), r, order[r]) for r in of))) for v, of in rules.items()}
    row = lambda v: F.struct(F.lit(v).alias("rule_version"), spans_by[v].alias("spans"))
    pairs = F.array_compact(F.array(*(F.when(F.array_contains("unseen", v), row(v)) for v in rules)))
    scanned = named.join(chosen.select("blob", "path", "unseen"), ["blob", "path"]).select("blob", F.explode(pairs).alias("pair")).select("blob", "pair.*")
    # one path may hold one blob twice
    return written(scanned.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans")))


def update_ledger(path: str, versions: DataFrame, rules: dict[str, tuple[Rule, ...]] = VERSIONS) -> DataFrame:
    """Append what the ledger at `path` has not seen of `versions`, and return the whole ledger. A path without one begins one.

    New rows are written whole before they are appended, so that a job that fails and runs again adds no half of them.
    """
    read = versions.sparkSession.read.schema(LEDGER)
    try:
        old = read.parquet(path)
    except AnalysisException:
        old = None
    scan_unseen(versions, old, rules).write.mode("append").parquet(path)
    return read.parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, rules: dict[str, tuple[Rule, ...]] = VERSIONS) -> DataFrame:
    """Join the ledger's spans under these rule versions back to every path: path, blob, spans.

    versions: path, text (every historical version of every path is a row). A null text is the
    empty blob; a null path is kept; repeated rows come back as often as they are in versions. Other columns aren't read.
    """
    at = versions.select("path", address(F.col("text")).alias("blob"))
    known = ledger.where(F.col("rule_version").isin(*rules) & (F.size("spans") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return at.join(known, "blob", "left").select("path", "blob", F.coalesce("spans", F.expr(EMPTY)).alias("spans"))
