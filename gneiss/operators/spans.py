"""Spans in texts: offsets, the frame that holds a span, the nearest spans on each side, overlaps, bounded pairs, scope."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gneiss.functions.values import told_apart

#: Texts of which a task keeps the rows at once.
TEXTS = 256
BLANK = re.compile(r"\s*", re.ASCII)
#: Members of a list on one side of a trigger at most.
LIST = 3
#: Cues of scope.
NEGATION = ["not", "no", "never", "n't", "neither", "nor", "without", "fails to", "unable to", "cannot", "can't", "doesn't", "don't", "didn't", "won't"]
HEDGE = ["may", "might", "could", "can", "possibly", "perhaps", "likely", "probably", "suggest", "suggests", "hypothesize", "appears to", "seems to", "reportedly"]
CONDITIONAL = ["if", "unless", "provided that", "whenever", "in case", "would", "should"]
ATTRIBUTION = ["said", "says", "according to", "reported", "reports", "claims", "claimed", "stated", "stated that", "noted", "argues", "wrote", "per", "as noted by"]
#: What may open a new part of a sentence.
COORDINATOR = r"(?:\b(?:and|but|or|while)\b|;)[ \t\n\f\r]*"
PLAIN_COORDINATOR = re.compile(r"(and|but|or|while|;)[ \t\n\f\r]*")
HYPOTHETICAL, COMPARISON = ["would", "plans to", "intends to"], ["unlike", "compared to", "in contrast"]


def marks(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, k, start, end, mark: each match of the pattern in the text, with its place in characters."""
    text = F.coalesce("text", F.lit(""))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("mark"))
    rows = docs.select("doc_id", F.posexplode(zipped).alias("k", "x")).select("doc_id", "k", "x.gap", "x.mark").where("mark IS NOT NULL")
    upto = F.sum(F.length("gap") + F.length("mark")).over(Window.partitionBy("doc_id").orderBy("k"))
    return rows.select("doc_id", "k", (upto - F.length("mark")).alias("start"), upto.alias("end"), "mark")


def _in_word(text: str, at: int) -> bool:
    """Does Java's word boundary take the character for one of a word: a letter, a decimal digit, "_", or a mark on such a letter or digit."""
    if not 0 <= at < len(text):
        return False
    c = text[at]
    while at > 0 and unicodedata.category(text[at]) == "Mn":
        at -= 1
    return c == "_" or text[at].isalpha() or text[at].isdecimal()


def joints_in(text: str) -> Iterator[tuple[int, int]]:
    """What `marks` finds by COORDINATOR: where each ends without the white space behind it, and where with it."""
    for m in PLAIN_COORDINATOR.finditer(text):
        if m[1] == ";" or not (_in_word(text, m.start() - 1) or _in_word(text, m.end(1))):
            yield m.end(1), m.end()


def pieces(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, frame, start, end: what lies between matches of the pattern, blank pieces left out, with its running place."""
    text = F.coalesce("text", F.lit(""))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("mark"))
    rows = docs.select("doc_id", F.posexplode(zipped).alias("frame", "x")).select("doc_id", "frame", "x.piece", F.coalesce(F.length("x.mark"), F.lit(0)).alias("gap"))
    upto = F.sum(F.length("piece") + F.col("gap")).over(Window.partitionBy("doc_id").orderBy("frame")) - F.col("gap")
    return rows.select("doc_id", "frame", (upto - F.length("piece")).alias("start"), upto.alias("end"), "piece").where(F.rlike("piece", F.lit(r"\S"))).drop("piece")


def inside(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """spans (doc_id, start, end, ...) that lie within one of the frames (doc_id, frame, start, end), with it.

    Frames don't overlap, so a span's only candidate is the last frame that begins at or before it: one ordered pass over a document instead of all pairs.
    """
    own = [c for c in spans.columns if c not in ("doc_id", "start", "end")]
    left = frames.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.struct("frame", "end").alias("f"), F.lit(None).alias("s"))
    right = spans.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("side"), F.lit(None).alias("f"), F.struct("start", "end", *own).alias("s"))
    before = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = left.select("doc_id", "at", "side", "f", F.lit(None).cast(right.schema["s"].dataType).alias("s")).unionByName(right.select("doc_id", "at", "side", F.lit(None).cast(left.schema["f"].dataType).alias("f"), "s"))
    found = met.withColumn("f", F.last("f", ignorenulls=True).over(before)).where("side = 1 AND f IS NOT NULL AND s.end <= f.end")
    return found.select("doc_id", "f.frame", "s.*")


def nearby(triggers: DataFrame, entities: DataFrame, left: bool, by: tuple[str, ...] = (), most: int = LIST) -> DataFrame:
    """t, a trigger as a struct, and near: at most `most` entities of its document, frame and columns `by` that end before it begins (left) or begin after it ends, the nearest first.

    One ordered pass counts the entities before each trigger; these counts are the ranks of its neighbours, which are fetched by
    equality. A trigger in several rows that differ in `by` alone gets the nearest of all of them.
    """
    keys = ["doc_id", "frame", *by]
    place = ["end", "start", "mark"] if left else ["start", "end", "mark"]
    ranks = entities.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*place)))
    t = F.struct(*(c for c in triggers.columns if c not in by))
    # on the left an entity that ends where the trigger begins counts; on the right one that begins where it ends is the first
    events = ranks.select(*keys, F.col(place[0]).alias("at"), F.lit(1).alias("side"), F.lit(1).alias("one"), F.lit(None).cast(triggers.select(t.alias("t")).schema["t"].dataType).alias("t"))
    events = events.unionByName(triggers.select(*keys, F.col("start" if left else "end").alias("at"), F.lit(2 if left else 0).alias("side"), F.lit(0).alias("one"), t.alias("t")))
    upto = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("c", F.sum("one").over(upto)).where("t IS NOT NULL")
    wanted = F.sequence(F.greatest(F.col("c") - (most - 1), F.lit(1)), F.greatest(F.col("c"), F.lit(1))) if left else F.sequence(F.col("c") + 1, F.col("c") + most)
    met = counted.select(*keys, "t", F.explode(wanted).alias("n")).join(ranks.select(*keys, "n", F.struct(*(c for c in entities.columns if c not in keys), *by).alias("e")), [*keys, "n"], "left")
    fits = (F.col("e.end") <= F.col("t.start")) if left else (F.col("e.start") >= F.col("t.end"))
    order = [-F.col("e.end"), -F.col("e.start")] if left else [F.col("e.start"), F.col("e.end")]
    near = F.array_sort(F.collect_list(F.when(fits, F.struct(order[0].alias("a"), order[1].alias("b"), "e"))))
    return met.groupBy("t").agg(F.slice(F.transform(near, lambda x: x["e"]), 1, most).alias("near"))


def sides(triggers: DataFrame, entities: DataFrame) -> DataFrame:
    """triggers and entities (doc_id, frame, start, end, mark) to one row a trigger: doc_id, frame, start, end, mark, left, right: of the frame's entities the LIST nearest on either side."""
    left = nearby(triggers, entities, True).withColumnRenamed("near", "left")
    return left.join(nearby(triggers, entities, False).withColumnRenamed("near", "right"), "t").select("t.*", "left", "right")


def candidates(triggers: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, frame, start, mark, outcome, subject, object, subject_start, object_start: a trigger's pairs of a subject before and an object behind it.

    With one entity on a side and several on the other, the nearest LIST of those each make a pair; several on both are ambiguous, and a side without any is unavailable: such a
    trigger has one row without a pair. Equal words are no pair.
    """
    near = sides(triggers, entities)
    n, m = F.size("left"), F.size("right")
    outcome = F.when(n == 0, "SUBJECT_UNAVAILABLE").when(m == 0, "OBJECT_UNAVAILABLE").when((n > 1) & (m > 1), "AMBIGUOUS").otherwise("PAIR")
    pairs = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = near.withColumn("outcome", outcome).withColumn("pair", F.explode_outer(F.when(F.col("outcome") == "PAIR", F.filter(pairs, lambda p: p["a"]["mark"] != p["b"]["mark"]))))
    return rows.select("doc_id", "frame", "start", "mark", "outcome", F.col("pair.a.mark").alias("subject"), F.col("pair.b.mark").alias("object"), F.col("pair.a.start").alias("subject_start"), F.col("pair.b.start").alias("object_start"))


def line_candidates(docs: DataFrame, trigger: str, entity: str) -> DataFrame:
    """`candidates` of what two patterns mark within lines, in one pass over each text. Patterns match alike in Java and Python, as plain classes of ASCII characters do. Texts whose keys don't tell them apart take the ordered passes."""
    if not told_apart(docs, ["doc_id"]):
        lines = pieces(docs, r"\n")
        return candidates(*(inside(marks(docs, p).drop("k"), lines) for p in (trigger, entity)))
    triggers, entities = re.compile(trigger), re.compile(entity)
    schema = T.StructType([docs.schema["doc_id"]])
    for name, kind in zip(("frame", "start", "mark", "outcome", "subject", "object", "subject_start", "object_start"), (T.IntegerType, T.LongType, *(T.StringType,) * 4, T.LongType, T.LongType)):
        schema = schema.add(name, kind())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [(i, *row) for i, text in enumerate(part.column("text").to_pylist()) for row in _pairs_in(text, triggers, entities)]
                columns = list(zip(*found)) or [()] * len(arrow)
                ids = part.column("doc_id").take(pa.array(columns[0], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns[1:], list(arrow)[1:]))], schema=arrow)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _pairs_in(text: str, triggers: re.Pattern, entities: re.Pattern) -> Iterator[tuple]:
    """frame, start, mark, outcome, subject, object, subject_start, object_start of one text."""
    starts, lines = [0], text.split("\n")
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    told = [not BLANK.fullmatch(line) for line in lines]

    def within(pattern: re.Pattern) -> Iterator[tuple[int, int, int, str]]:
        frame = 0
        for m in pattern.finditer(text):
            while starts[frame + 1] <= m.start():
                frame += 1
            if told[frame] and m.end() < starts[frame + 1]:
                yield frame, m.start(), m.end(), m[0]

    by_line: dict[int, list] = {}
    for frame, a, b, mark in within(entities):
        by_line.setdefault(frame, []).append((a, b, mark))
    for frame, a, b, mark in within(triggers):
        own = by_line.get(frame, [])
        left = own[: bisect_right(own, a, key=lambda e: e[1])][-LIST:]
        right = own[bisect_left(own, b, key=lambda e: e[0]) :][:LIST]
        if not left or not right or len(left) > 1 and len(right) > 1:
            outcome, pairs = "SUBJECT_UNAVAILABLE" if not left else "OBJECT_UNAVAILABLE" if not right else "AMBIGUOUS", []
        else:
            outcome, pairs = "PAIR", [(x[2], y[2], x[0], y[0]) for x in left for y in right if x[2] != y[2]]
        for pair in pairs or [(None,) * 4]:
            yield frame, a, mark, outcome, *pair


def regions_of(triggers: DataFrame, docs: DataFrame, frames: DataFrame) -> DataFrame:
    """triggers (doc_id, frame, start, end, ...) with `low` and `high`, the bounds of their part of the frame.

    A part ends where a coordinator (COORDINATOR) is followed at once by another trigger; null bounds are those of the frame.
    """
    joints = inside(marks(docs, COORDINATOR).drop("k"), frames).select("doc_id", "frame", (F.col("start") + F.length(F.regexp_replace("mark", r"\s+\z", ""))).alias("joint"), F.col("end").alias("next"))
    opens = triggers.select("doc_id", "frame", F.col("start").alias("next")).distinct()
    cuts = joints.join(opens, ["doc_id", "frame", "next"]).select("doc_id", "frame", "joint").distinct()
    t = F.struct(*triggers.columns)
    kind = triggers.select(t.alias("t")).schema["t"].dataType

    def bound(df: DataFrame, low: bool) -> DataFrame:
        """The last cut at or before the trigger, or the first at or after its end."""
        at = F.col("start" if low else "end")
        rows = df.select("doc_id", "frame", at.alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("joint"), t.alias("t"))
        cut = cuts.select("doc_id", "frame", F.col("joint").alias("at"), F.lit(0 if low else 2).alias("side"), F.col("joint").cast("int").alias("joint"), F.lit(None).cast(kind).alias("t"))
        order = Window.partitionBy("doc_id", "frame").orderBy("at", "side")
        frame = order.rowsBetween(Window.unboundedPreceding, 0) if low else order.rowsBetween(0, Window.unboundedFollowing)
        value = (F.last if low else F.first)("joint", ignorenulls=True).over(frame)
        return rows.unionByName(cut).withColumn("bound", value).where("t IS NOT NULL").select("t.*", F.col("bound").alias("low" if low else "high"))

    return bound(triggers, True).join(bound(triggers, False), triggers.columns)


def typed_candidates(triggers: DataFrame, entities: DataFrame, signatures: DataFrame) -> DataFrame:
    """A trigger's pairs of entities that some rule of its class may join, or why it has none: the trigger's columns, outcome, subject, object (structs of start, end, mark, type).

    triggers: doc_id, frame, start, end, mark, evidence_class, low, high (see regions_of) and more; entities: doc_id, frame, start, end, mark, type; signatures: evidence_class,
    subject_type, object_type. On each side only entities of a type that some signature of the class has there count, and only those
    within the trigger's part of the frame: a nearer entity of another type doesn't stand in the way. One on one side and up to LIST on the other make
    pairs; several on both are ambiguous. A pair of one text and type is no pair; one that no signature accepts is OBJECT_TYPE_INCOMPATIBLE.
    """
    t = F.struct(*triggers.columns)

    def side(left: bool) -> DataFrame:
        types = signatures.select("evidence_class", F.col("subject_type" if left else "object_type").alias("type")).distinct()
        return nearby(triggers.join(types, "evidence_class").select(*triggers.columns, "type"), entities, left, ("type",)).withColumnRenamed("near", "left" if left else "right")

    rows = triggers.select(t.alias("t")).join(side(True), "t", "left").join(side(False), "t", "left")
    return paired(rows, signatures)


def paired(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """typed_candidates from rows that have a trigger as a struct t and its nearest entities (start, end, mark, type) as arrays left and right (null: none)."""
    columns = rows.schema["t"].dataType.names
    rows = rows.withColumn("left", F.filter("left", lambda e: e["start"] >= F.coalesce("t.low", F.lit(0)))).withColumn("right", F.filter("right", lambda e: F.coalesce(e["start"] <= F.col("t.high"), F.lit(True))))
    n, m = F.coalesce(F.size("left"), F.lit(0)), F.coalesce(F.size("right"), F.lit(0))
    outcome = F.when(n <= 0, "SUBJECT_ENDPOINT_UNAVAILABLE").when(m <= 0, "OBJECT_ENDPOINT_UNAVAILABLE").when((n > 1) & (m > 1), "ARGUMENT_BINDING_AMBIGUOUS").otherwise("PAIR")
    pairs = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.struct(a.alias("a"), b.alias("b")))))
    other = lambda p: (p["a"]["mark"] != p["b"]["mark"]) | (p["a"]["type"] != p["b"]["type"])
    found = rows.withColumn("outcome", outcome).withColumn("p", F.explode_outer(F.when(F.col("outcome") == "PAIR", F.filter(pairs, other)))).select("t.*", F.when((F.col("outcome") == "PAIR") & F.col("p").isNull(), "SELF_PAIR").otherwise(F.col("outcome")).alias("outcome"), F.col("p.a").alias("subject"), F.col("p.b").alias("object"))
    known = signatures.select("evidence_class", "subject_type", "object_type").distinct().withColumn("known", F.lit(True))
    typed = found.withColumn("subject_type", F.col("subject.type")).withColumn("object_type", F.col("object.type")).join(known, ["evidence_class", "subject_type", "object_type"], "left")
    named = F.when(F.col("outcome") != "PAIR", F.col("outcome")).when(F.col("known"), "CANDIDATE_CREATED").otherwise("OBJECT_TYPE_INCOMPATIBLE")
    return typed.select(*columns, named.alias("outcome"), "subject", "object")


def overlapping(tokens: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """tokens (doc_id, start, end, mark) with the best of the spans (doc_id, start, end, name) that overlap it: doc_id, start, end, mark, name, tier.

    Tier 0: the span is the token's; 1: it holds the token; 2: it overlaps it. Then longer spans, then earlier ones. Spans and tokens meet by the cells of `width` characters
    that they touch.
    """
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest("start", F.col("end") - 1) / width))))
    t, s = cells(tokens).alias("t"), cells(spans).alias("s")
    met = t.join(s, (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("t.cell") == F.col("s.cell")) & (F.col("s.start") < F.col("t.end")) & (F.col("t.start") < F.col("s.end")))
    tier = F.when((F.col("s.start") == F.col("t.start")) & (F.col("s.end") == F.col("t.end")), 0).when((F.col("s.start") <= F.col("t.start")) & (F.col("s.end") >= F.col("t.end")), 1).otherwise(2)
    order = F.struct(tier.alias("tier"), (F.col("s.start") - F.col("s.end")).alias("length"), F.col("s.start").alias("at"), F.col("s.name").alias("name"))
    best = met.groupBy("t.doc_id", "t.start", "t.end", "t.mark").agg(F.min(order).alias("b"))
    return best.select("doc_id", "start", "end", "mark", "b.name", "b.tier")


def best_spans(spans: DataFrame, *by: str) -> DataFrame:
    """spans (start, end, score, ...) with one of each place (by, start, end): the greatest score, among equals the first `name`."""
    return spans.withColumn("r", F.row_number().over(Window.partitionBy(*by, "start", "end").orderBy(F.desc("score"), "name"))).where("r = 1").drop("r")


def _near(text: Column, cues: list[str]) -> Column:
    """Does any cue stand in the text as words."""
    words = F.array_join(F.regexp_extract_all(text, F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0)), " ")
    spaced = F.concat(F.lit(" "), words, F.lit(" "))
    return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(text, c) & F.contains(spaced, F.concat(F.lit(" "), c, F.lit(" "))))


def scope(sentence: Column, start: Column, end: Column, reach: int = 200) -> Column:
    """A trigger's scope in its sentence: question, negated, speculative, conditional, hypothetical, attributed, comparison, and attribution_source.

    The source is the word before the longest attributing cue that stands before the trigger, without commas and full stops at its end; null if nothing stands there.
    """
    low = F.lower(sentence)
    span = F.substring(low, F.greatest(F.lit(0), start - reach) + 1, end + reach - F.greatest(F.lit(0), start - reach))
    before = F.substring(low, F.lit(1), start)
    has = lambda text, cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(text, c))
    cue = F.coalesce(*(F.when(F.contains(before, F.lit(c)), F.lit(c)) for c in sorted(ATTRIBUTION, key=lambda c: (-len(c), c))))
    source = F.regexp_replace(F.regexp_extract(F.substring(sentence, F.lit(1), F.position(cue, low) - 1), r"(\S+)\s*\z", 1), r"[,.]+\z", "")
    return F.struct(
        F.rlike(sentence, F.lit("[?？]")).alias("question"), _near(span, NEGATION).alias("negated"), _near(span, HEDGE).alias("speculative"), _near(span, CONDITIONAL).alias("conditional"),
        has(before, HYPOTHETICAL).alias("hypothetical"), cue.isNotNull().alias("attributed"), has(low, COMPARISON).alias("comparison"), F.nullif(source, F.lit("")).alias("attribution_source"),
    )


def modality(flags: Column) -> Column:
    """What becomes of a candidate by its scope: REJECT_ and why for questions, negations and conditions, QUALIFY for what is speculative, hypothetical or said by someone, else ACCEPT."""
    return (
        F.when(flags["question"], "REJECT_QUESTION").when(flags["negated"], "REJECT_NEGATED").when(flags["conditional"], "REJECT_CONDITIONAL")
        .when(flags["speculative"] | flags["hypothetical"] | flags["attributed"], "QUALIFY").otherwise("ACCEPT")
    )
