"""Triggers of a rule pack in texts: surface forms of its lemmas, and a token trie that finds all of them in one pass."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gneiss.storage import written

#: Forms of one trie; a larger pack is searched in parts, a pass each.
MOST_FORMS = 200_000
#: Surfaces of verbs that no rule gives.
IRREGULAR = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "am": "be",
    "made": "make", "did": "do", "led": "lead", "ran": "run", "built": "build", "wrote": "write", "held": "hold", "took": "take",
}
#: A word with what an apostrophe ties to it.
WORD = re.compile(r"\w+(?:'\w+)?")
FOUND = "doc_id long, span_start int, span_end int, mark string, kind string, lemma string, predicate string, rule int, evidence_class string, covered boolean"


def verb_surfaces(lemma: Column) -> Column:
    """An array of (order, surface): the bounded inflections of a lemma; of lemmas with one surface the one with the smallest order has it."""
    n, stem = F.length(lemma), F.left(lemma, F.length(lemma) - 1)
    e, y = F.endswith(lemma, F.lit("e")), F.endswith(lemma, F.lit("y"))
    form = lambda order, when, surface: F.when(when, F.struct(F.lit(order).alias("order"), surface.alias("surface")))
    regular = [
        form(0, n > 0, lemma), form(2, y & (n > 2), F.concat(stem, F.lit("ies"))), form(3, e & (n > 2), F.concat(stem, F.lit("ing"))), form(4, n > 1, F.concat(lemma, F.lit("ing"))), form(5, e & (n > 2), F.concat(stem, F.lit("ed"))),
        form(6, n > 1, F.concat(lemma, F.lit("ed"))), form(7, y & (n > 1), F.concat(stem, F.lit("ied"))), form(8, n > 1, F.concat(lemma, F.right(lemma, F.lit(1)), F.lit("ed"))), form(9, e & (n > 2), F.concat(stem, F.lit("es"))), form(10, n > 2, F.concat(lemma, F.lit("s"))),
    ]
    return F.array_compact(F.array(*regular, *(form(1, lemma == v, F.lit(k)) for k, v in IRREGULAR.items())))


def trigger_forms(pack: DataFrame) -> DataFrame:
    """surface, kind, lemma, predicate, rule, evidence_class of a pack (rule, predicate, evidence_class, kind, phrase), a row for each rule, kind and surface.

    Kinds: VERB (a lemma, with its inflections), NOUN and MULTIWORD (as they are; the lemma of the latter is its first word). Null and empty phrases have no form.
    """
    low = F.lower(F.trim("phrase"))
    rows = pack.select("rule", "predicate", "evidence_class", "kind", low.alias("phrase")).where("phrase <> ''").distinct()
    same = F.struct(F.lit(0).alias("order"), F.col("phrase").alias("surface"))
    forms = rows.select("*", F.explode(F.when(F.col("kind") == "VERB", verb_surfaces(F.col("phrase"))).otherwise(F.array(same))).alias("f"))
    lemma = F.when(F.col("kind") == "MULTIWORD", F.substring_index("phrase", " ", 1)).otherwise(F.col("phrase"))
    first = F.min(F.struct(F.col("f.order").alias("order"), lemma.alias("lemma")))["lemma"]
    return forms.groupBy("rule", "predicate", "evidence_class", "kind", F.col("f.surface").alias("surface")).agg(first.alias("lemma"))


def lemmas(tokens: DataFrame, verbs: DataFrame) -> DataFrame:
    """tokens (token, ...) with `lemma`: the verb (lemma) of which the token is a bounded inflection, null if none; of several the first by order, then by name."""
    forms = verbs.select("lemma", F.explode(verb_surfaces(F.col("lemma"))).alias("f")).groupBy(F.col("f.surface").alias("token")).agg(F.min(F.struct(F.col("f.order").alias("order"), "lemma"))["lemma"].alias("lemma"))
    return tokens.join(forms, "token", "left")


def _trie(forms: list[tuple]) -> dict:
    """word -> [matches that end here, {gap -> {word -> ...}}] of the surfaces."""
    root: dict = {}
    for surface, *found in forms:
        at, node, last = root, None, 0
        for m in WORD.finditer(surface):
            if node is not None:
                at = node[1].setdefault(surface[last : m.start()], {})
            node, last = at.setdefault(m[0], [[], {}]), m.end()
        if node is not None and last == len(surface) and WORD.match(surface):
            node[0].append(tuple(found))
    return root


def lowered(text: str) -> str:
    """Lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _matches(text: str, root: dict) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, match) of every surface, from each word on as far as the trie goes."""
    low = lowered(text)
    words = [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
    for i, (word, start, end) in enumerate(words):
        node, k = root.get(word), i
        while node:
            for found in node[0]:
                yield start, end, found
            k += 1
            if k == len(words) or not node[1]:
                break
            after = node[1].get(low[end : words[k][1]])
            node, end = after and after.get(words[k][0]), words[k][2]


def _spans(text: str, root: dict) -> Iterator[tuple]:
    """(start, end, mark, *match, covered) of every surface in order of place."""
    far, far_at = -1, -1
    for start, end, found in sorted(_matches(text, root), key=lambda m: (m[0], -m[1])):
        # of what began at or before this match the one that reaches farthest, and where it began
        if end > far:
            far, far_at = end, start
        yield start, end, text[start:end], *found, end <= far and (start, end) != (far_at, far)


def _forms(pack: DataFrame) -> tuple[DataFrame, int]:
    """The written forms of a pack, and the number of tries that they take."""
    forms = written(trigger_forms(pack).select("surface", "kind", "lemma", "predicate", F.col("rule").cast("int").alias("rule"), "evidence_class"))
    return forms, max(1, -(-forms.count() // MOST_FORMS))


def _loaded(forms: DataFrame) -> dict:
    rows = forms.orderBy(*forms.columns).toArrow()
    return _trie(list(zip(*(c.to_pylist() for c in rows.columns)))) if rows.num_rows else {}


def trigger_spans(docs: DataFrame, pack: DataFrame) -> DataFrame:
    """FOUND: every surface of the pack (see trigger_forms) in the texts, whole words, in characters; `covered` tells that a longer match holds it.

    All forms are in one trie of words, so a text is passed once however many there are; packs of over MOST_FORMS forms are
    searched in parts, and longer matches looked for across parts. Words between which a phrase has something other than a space must have just that between them.
    A null text has no match; null and repeated doc_ids stay; an empty pack finds nothing.
    """
    forms, parts = _forms(pack)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")

    def part(k: int) -> DataFrame:
        trie = _loaded(forms.where(F.pmod(F.xxhash64("surface"), F.lit(parts)) == k))
        schema = pa.schema([("doc_id", pa.int64()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("mark", pa.string()), ("kind", pa.string()), ("lemma", pa.string()), ("predicate", pa.string()), ("rule", pa.int32()), ("evidence_class", pa.string()), ("covered", pa.bool_())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    out.extend((doc, *found) for found in _spans(text, trie))
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return texts.mapInArrow(run, FOUND)

    if parts == 1:
        return part(0)
    every = reduce(DataFrame.unionByName, map(part, range(parts)))
    upto = Window.partitionBy("doc_id").orderBy("span_start", F.desc("span_end"))
    reach = F.max(F.struct("span_end", (-F.col("span_start")).alias("s"))).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn("r", reach).withColumn("covered", (F.col("span_end") <= F.col("r.span_end")) & ((F.col("span_end") != F.col("r.span_end")) | (F.col("span_start") != -F.col("r.s")))).drop("r")


# triggers with their neighbours, frame by frame

SIDE = "array<struct<start:bigint,end:bigint,mark:string,type:string>>"
BOUND = f"doc_id long, frame int, begin long, sentence string, triggers array<struct<start:bigint,end:bigint,mark:string,kind:string,lemma:string,predicate:string,evidence_class:string,low:int,high:int,left:{SIDE},right:{SIDE}>>"


def _bounds(joints: list[tuple[int, int]], found: list[tuple]) -> Iterator[tuple[int | None, int | None]]:
    """Of each match the last joint at or before it and the first at or after it, of those (joint, next) at which a match follows at once."""
    opens = {m[0] for m in found}
    cuts = sorted({joint for joint, after in joints if after in opens})
    for start, end, *_ in found:
        i, j = bisect_right(cuts, start), bisect_left(cuts, end)
        yield cuts[i - 1] if i else None, cuts[j] if j < len(cuts) else None


def _nearest(entities: dict[str, tuple[list, list, list]], types: tuple[str, ...], at: int, left: bool, most: int) -> list[dict]:
    """Of entities, which don't overlap, the `most` of these types that end before the place (left) or begin after it, the nearest first; entities: type -> starts, ends, marks."""
    near = []
    for t in types:
        starts, ends, marks = entities.get(t, ((), (), ()))
        i = bisect_right(ends, at) if left else bisect_left(starts, at)
        near += [{"start": starts[k], "end": ends[k], "mark": marks[k], "type": t} for k in (range(max(0, i - most), i) if left else range(i, min(len(starts), i + most)))]
    return sorted(near, key=lambda e: e["start"], reverse=left)[:most]


def bound_triggers(docs: DataFrame, pack: DataFrame, frame: str, entity: str, joints_in: Callable[[str], Iterator[tuple[int, int]]], type_of: Callable[[str], str], sides: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], most: int) -> DataFrame | None:
    """BOUND: each frame of a text that has triggers, with those that no longer one covers, their part of the frame and the nearest entities on both sides. None if the pack takes several tries.

    It gives what trigger_spans, spans.inside, spans.regions_of and spans.nearby give, in one pass over each text and without a shuffle, if no match
    of entity, nor a joint that a trigger follows, nor a trigger, goes from one frame into the next. sides: the types that count on the left and on
    the right of a trigger's class; a class without types has no neighbours. Places are those of the text; null ids and texts have no frames.
    """
    forms, parts = _forms(pack)
    if parts > 1:
        return None
    trie, patterns = _loaded(forms), [re.compile(p) for p in (frame, entity)]

    def found_in(sentence: str, begin: int) -> list[dict]:
        found = [(begin + a, begin + b, mark, kind, lemma, predicate, cls) for a, b, mark, kind, lemma, predicate, _, cls, covered in _spans(sentence, trie) if not covered]
        if not found:
            return []
        entities: dict[str, tuple[list, list, list]] = {}
        for m in patterns[1].finditer(sentence):
            for column, value in zip(entities.setdefault(type_of(m[0]), ([], [], [])), (begin + m.start(), begin + m.end(), m[0])):
                column.append(value)
        joints = [(begin + a, begin + b) for a, b in joints_in(sentence)]
        out = []
        for (a, b, mark, kind, lemma, predicate, cls), (low, high) in zip(found, _bounds(joints, found)):
            before, behind = sides.get(cls, ((), ()))
            out.append({"start": a, "end": b, "mark": mark, "kind": kind, "lemma": lemma, "predicate": predicate, "evidence_class": cls, "low": low, "high": high, "left": _nearest(entities, before, a, True, most), "right": _nearest(entities, behind, b, False, most)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for k, m in enumerate(patterns[0].finditer(text)):
                    triggers = found_in(m[0], m.start())
                    if triggers:
                        out.append((doc, k, m.start(), m[0], triggers))
                        size += len(m[0]) + 100 * len(triggers)
                    if size > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = to_arrow_schema(T.StructType.fromDDL(BOUND))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, BOUND)
