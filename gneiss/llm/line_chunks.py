"""Removal of repeated multi-line chunks with content-defined boundaries, and of repeated passages of whole lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, unfolded, written
from .components import numbered

#: One boundary in so many lines; a chunk of fewer lines than this goes only as part of a passage.
SPACING, LEAST_LINES = 4, 2
#: A run of whole lines with more words than this is a passage.
PASSAGE_WORDS = 50
#: Rows of about 60 bytes: 20 MB at most.
BROADCAST_ROWS = 300_000
PRIME = 1_000_003


def line_hash(line: Column) -> Column:
    """60 bits of the line's MD5, a non-negative long."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _chunks(text: Column, spacing: int) -> Column:
    """The text's chunks, in order, as an array of (line, chunk): where it begins, and strings that "\\n" joins to the text again.

    A rolling hash over each line and the one before it ends a chunk where it is 0 modulo
    `spacing`: inserting or removing lines moves boundaries near them only.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    short = F.transform(lines, lambda x: F.pmod(line_hash(x), F.lit(PRIME)))
    ends = F.zip_with(short, F.concat(F.array(F.lit(None).cast("long")), short), lambda h, before: F.pmod(before * 31 + h, F.lit(spacing)) == 0)
    # lines begin with their number and L and a line B alone is a boundary, so that one split makes chunks of any text
    numbered = F.transform(lines, lambda x, i: F.concat(i.cast("string"), F.lit("L"), x))
    marked = F.array_join(F.zip_with(numbered, ends, lambda x, end: F.concat(x, F.when(end, "\nB").otherwise(""))), "\n")
    return F.transform(
        F.split(F.regexp_replace(marked, r"\nB\z", ""), "\nB\n", -1),
        lambda c: F.struct(F.substring_index(c, "L", 1).cast("int").alias("line"), F.regexp_replace(c, r"(\A|\n)\d+L", "$1").alias("chunk")),
    )


def _lines(text: Column) -> Column:
    """The text's lines that are not blank, as an array of (pos, hash, words)."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("hash"), F.regexp_count(x, F.lit(r"\S+")).alias("words")))
    return F.filter(every, lambda x: x["words"] > 0)


def _run(lines: Column, first: Column, last: Column) -> Column:
    """The lines from first to last that are not blank, as one string."""
    return F.array_join(F.filter(F.slice(lines, first + 1, last - first + 1), lambda x: F.rlike(x, F.lit(r"\S"))), "\n")


def _count(chunk: Column) -> Column:
    """A chunk's lines."""
    return F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def _once(values: dict[str, Column], use) -> Column:
    """use(a struct of the values), each evaluated once a row: a column named in a lambda would be evaluated for every element."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use), F.lit(0))


def _parsed(spacing: int, use) -> Column:
    """use(a struct of the text's lines, its chunks and, for each line, the number of its chunk)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    of = lambda s: F.flatten(F.transform(s["chunks"], lambda c, k: F.array_repeat(k, _count(c["chunk"]))))
    return _once({"lines": lines, "chunks": _chunks(F.col("text"), spacing)}, lambda s: _once({"lines": s["lines"], "chunks": s["chunks"], "of": of(s)}, use))


def _later_passages(lines: DataFrame) -> DataFrame:
    """(key, start, stop, first_key, first_start, first_stop): runs of lines that stand, by hashes, earlier in the corpus too.

    lines: doc_id, key, idx among the lines that are not blank, pos among all, hash, words. From each line a run goes
    forward and one backward until it has over PASSAGE_WORDS words. Every line of a longer run is in one of
    these, so the runs that occur earlier cover each repeated passage to its ends. Only lines that occur more than once can be in one.
    """
    again = _sized(lines.groupBy("hash").count().where("count > 1").select("hash"))
    by, at = Window.partitionBy("key").orderBy("idx"), Window.partitionBy("key", "run")
    near = lines.join(again, "hash").repartition("key").dropDuplicates(["key", "idx"]).withColumn("run", F.col("idx") - F.row_number().over(by)).withColumn("upto", F.sum("words").over(by))
    near = near.withColumn("before", F.col("upto") - F.col("words"))

    def whole(frame, first, last):
        ends = F.struct(first("idx").over(frame).alias("idx"), last("idx").over(frame).alias("end"), first("pos").over(frame).alias("start"), last("pos").over(frame).alias("stop"), F.xxhash64(F.collect_list("hash").over(frame)).alias("hash"))
        return F.when(F.sum("words").over(frame) > PASSAGE_WORDS, ends)

    runs = F.array(whole(at.orderBy("before").rangeBetween(0, PASSAGE_WORDS), F.min, F.max), whole(at.orderBy("upto").rangeBetween(-PASSAGE_WORDS, 0), F.min, F.max))
    places = written(near.select("doc_id", "key", runs.alias("r")).select("doc_id", "key", F.explode(F.array_distinct(F.array_compact("r"))).alias("r")).select("doc_id", "key", "r.*"))
    first = places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "idx", "end", "start", "stop")).alias("first")).where("n > 1").drop("n")
    # a run that overlaps its own first occurrence is not a copy
    later = places.join(first, "hash").where((F.col("key") != F.col("first.key")) | (F.col("idx") > F.col("first.end")))
    later = later.select("key", "idx", "end", "start", "stop", F.col("first.key").alias("first_key"), (F.col("first.idx") - F.col("idx")).alias("shift"), F.col("first.start").alias("first_start"), F.col("first.stop").alias("first_stop"))
    same = ["key", "first_key", "shift"]
    along = Window.partitionBy(*same).orderBy("idx", "end")
    fresh = F.coalesce(F.col("idx") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    pieces = later.withColumn("fresh", fresh).withColumn("piece", F.sum(F.col("fresh").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy(*same, "piece").agg(*(f(c).alias(c) for f, c in ((F.min, "start"), (F.max, "stop"), (F.min, "first_start"), (F.max, "first_stop")))).drop("shift", "piece")


def remove_repeated_chunks(docs: DataFrame, spacing: int = SPACING, least: int = LEAST_LINES) -> DataFrame:
    """Return docs with `text` rewritten and a column `chunks_removed`, all other columns as they were, whatever their names.

    Of each chunk of at least `least` lines (not all blank) that occurs more than once, by bytes, in the
    corpus, the occurrence in the smallest (doc_id, position) stays and the others go. So do, wherever chunks
    end, the lines of each passage (a run of whole lines with over PASSAGE_WORDS words, blank lines not counted)
    that occurs earlier too. `chunks_removed` counts the chunks that lost lines.

    The corpus crosses the network once, by id. Hashes find repetitions; only texts of repeated chunks and
    passages are compared, each with the kept occurrence. Under one hash with unequal bytes nothing goes.

    A null text stays null and an empty one empty; a document whose chunks all go has an empty text; a
    null doc_id or repeated ids, and repeated rows, are handled by row (each row gets an own key, and of a null id the first row stays whole). Blank chunks stay.
    """
    docs = docs.drop("chunks_removed")
    keyed = numbered(folded(docs, "doc_id", "text")).withColumnRenamed("row", "__key")
    none = F.lit(None).cast("int")
    parts = F.concat(
        F.transform(
            F.filter(_chunks(F.col("text"), spacing), lambda c: (_count(c["chunk"]) >= least) & F.rlike(c["chunk"], F.lit(r"\S"))),
            lambda c: F.struct(c["line"].alias("pos"), line_hash(c["chunk"]).alias("hash"), none.alias("words"), none.alias("idx")),
        ),
        F.transform(_lines(F.col("text")), lambda x, i: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), x["words"].alias("words"), i.alias("idx"))),
    )
    parts = written(keyed.select("doc_id", F.col("__key").alias("key"), F.explode(parts).alias("p")).select("doc_id", "key", "p.*"))
    where = parts.where("idx IS NULL").select("doc_id", "key", "pos", "hash")
    first = where.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "pos")).alias("first")).where("n > 1")
    chunks = (
        where.join(first, "hash")
        .where((F.col("key") != F.col("first.key")) | (F.col("pos") != F.col("first.pos")))
        .select("key", F.col("pos").alias("start"), none.alias("stop"), F.col("first.key").alias("first_key"), F.col("first.pos").alias("first_start"), none.alias("first_stop"))
    )
    later = written(chunks.unionByName(_later_passages(parts.where("idx IS NOT NULL"))))

    place = ["first_key", "first_start", "first_stop"]
    places = written(later.select(*place).distinct())
    wanted = places.groupBy(F.col("first_key").alias("__key")).agg(F.collect_list(F.struct("first_start", "first_stop")).alias("__wanted"))
    wanted = F.broadcast(wanted) if places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    held = keyed.join(wanted, "__key").select("__key", "__wanted", "text")
    chunk_at = lambda s, at: F.get(s["chunks"], F.get(s["of"], at))
    shown = lambda s, w: F.when(w["first_stop"].isNull(), chunk_at(s, w["first_start"])["chunk"]).otherwise(_run(s["lines"], w["first_start"], w["first_stop"]))
    shown_all = _parsed(spacing, lambda s: F.transform("__wanted", lambda w: F.struct(w["first_start"].alias("first_start"), w["first_stop"].alias("first_stop"), shown(s, w).alias("first_text"))))
    firsts = held.select(F.col("__key").alias("first_key"), F.explode(shown_all).alias("f")).select("first_key", "f.*")
    # a chunk has no stop
    none_as = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c)
    firsts = firsts.select("first_key", "first_start", none_as("first_stop"), "first_text")
    edits = later.select("key", "start", "stop", "first_key", "first_start", none_as("first_stop")).join(firsts, place).groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("start", "stop", "first_text")).alias("__edits"))

    touched = _sized(later.select(F.col("key").alias("__key")).distinct())
    edited = keyed.join(touched, "__key", "left_semi").join(edits, "__key", "left")

    def result(s: Column) -> Column:
        """The text and the number of chunks that lost lines, from the lines that verified edits name."""
        whole = lambda e: (chunk_at(s, e["start"])["line"] == e["start"]) & (chunk_at(s, e["start"])["chunk"] == e["first_text"])
        same = F.filter("__edits", lambda e: F.when(e["stop"].isNull(), whole(e)).otherwise(_run(s["lines"], e["start"], e["stop"]) == e["first_text"]))
        last = lambda e: F.coalesce(e["stop"], e["start"] + _count(e["first_text"]) - 1)
        gone = F.array_distinct(F.flatten(F.transform(same, lambda e: F.sequence(e["start"], last(e)))))
        kept = lambda g: F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), g)
        return _once({"gone": gone}, lambda g: F.struct(
            F.array_join(F.transform(kept(g["gone"]), lambda i: F.get(s["lines"], i)), "\n").alias("text"),
            F.size(F.array_distinct(F.transform(g["gone"], lambda i: F.get(s["of"], i)))).alias("chunks_removed"),
        ))

    edited = edited.withColumn("__new", F.when(F.col("__edits").isNotNull(), _parsed(spacing, result)))
    shown = lambda df, text, gone: unfolded(df, docs.columns, {"doc_id": F.col("doc_id"), "text": text}, {"chunks_removed": gone})
    whole = shown(keyed.join(touched, "__key", "left_anti"), F.col("text"), F.lit(0))
    return whole.unionByName(shown(edited, F.when(F.col("__new").isNotNull(), F.col("__new.text")).otherwise(F.col("text")), F.coalesce("__new.chunks_removed", F.lit(0))))


def _sized(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast only if their rows are few; otherwise Spark chooses, from what it measures."""
    keys = written(keys)
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys
