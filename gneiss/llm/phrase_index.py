"""A positional inverted index in segments, and phrase and proximity search by offset-adjusted lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, written

#: Words of one segment at least (but for a task's last); words of test items searched at once.
SEGMENT_WORDS, BLOCK_WORDS = 400_000, 500_000
#: A-Z to a-z; 0-9, a-z and bytes from 128 stay; all else separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = T.StructType(
    [
        # segment: its number; terms: distinct words, one a line; ends: where each term's postings end; postings: positions,
        # ascending by term, 32 bits; doc_ids and doc_ends: documents and where their positions end.
        T.StructField("segment", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("ends", T.BinaryType()), T.StructField("postings", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_ends", T.BinaryType()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def build_index(docs: DataFrame) -> DataFrame:
    """Write the postings of every word of every whole text, in segments of consecutive documents; nothing is shuffled.

    A segment holds whole documents, so phrases never leave it. A null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        keys, ends, terms, total = [], [], [], 0
        serial = count(TaskContext.get().partitionId() << 33)

        def segment() -> pa.RecordBatch:
            term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
            order = np.argsort(term, kind="stable").astype(np.int32)
            values = (next(serial), b"\n".join(number), np.cumsum(np.bincount(term, minlength=len(number))).astype(np.int32).tobytes(), order.tobytes(), keys, np.array(ends, np.int64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()))], names=INDEX.names)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                words = words_of(text)
                terms.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                total += len(words)
                keys.append(key)
                ends.append(total)
                if total >= SEGMENT_WORDS:
                    yield segment()
                    number, keys, ends, terms, total = {}, [], [], [], 0
        if keys:
            yield segment()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), {"parquet.block.size": str(16 << 20), "compression": "zstd"})


class Segment:
    """One segment's lists, and searches in it."""

    def __init__(self, terms: bytes, ends: bytes, postings: bytes, doc_ends: bytes):
        self.number = {w: i for i, w in enumerate(terms.split(b"\n"))} if terms else {}
        self.ends = np.frombuffer(ends, np.int32)
        self.postings, self.doc_ends = np.frombuffer(postings, np.int32), np.frombuffer(doc_ends, np.int64)

    def positions(self, word: bytes) -> np.ndarray:
        i = self.number.get(word)
        return self.postings[:0] if i is None else self.postings[self.ends[i - 1] if i else 0 : self.ends[i]]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, positions, side="right")

    def phrase(self, words: list[bytes]) -> np.ndarray:
        """Where the words stand next to each other in one document, from the rarest word's list outward."""
        lists = sorted(((self.positions(w), k) for k, w in enumerate(words)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for other, k in lists[1:]:
            if not len(found):
                return found
            at = np.searchsorted(other, found + k)
            found = found[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == found + k)]
        return found[(found >= 0) & (self.doc_of(found) == self.doc_of(found + len(words) - 1))] if len(found) else found

    def near(self, words: list[bytes], span: int) -> np.ndarray:
        """Positions of the rarest word that have every word within `span` words, in the same document."""
        lists = sorted((self.positions(w) for w in set(words)), key=len)
        found = lists[0]
        for other in lists[1:]:
            if not len(found) or not len(other):
                return found[:0]
            at = np.searchsorted(other, found)
            ok = np.zeros(len(found), bool)
            for side in (np.maximum(at - 1, 0), np.minimum(at, len(other) - 1)):
                ok |= (np.abs(other[side] - found) <= span) & (self.doc_of(other[side]) == self.doc_of(found))
            found = found[ok]
        return found


FOUND = T.StructType(
    [
        # segment and place: the document's row
        T.StructField("segment", T.LongType()), T.StructField("place", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def search(index: DataFrame, items: list[tuple[str, bytes]], window: int, near: int | None = None) -> DataFrame:
    """All documents of the index, a row each, with the spans [first word, end) where windows of the items occur, and those items.

    Windows are every `window` consecutive words of an item, or the whole of a shorter one. With
    `near`, spans are instead the places of a window's rarest word with all its words within `near`. A segment looks only at the
    windows whose anchor it has: the word of the window that the fewest windows have.
    """
    asked: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            asked.setdefault(tuple(words[i : i + window]), set()).add(item)
    windows = Counter(w for words in asked for w in set(words))
    anchored: dict[bytes, list[tuple[bytes, ...]]] = {}
    for words in asked:
        anchored.setdefault(min(words, key=lambda w: (windows[w], w)), []).append(words)
    schema = pa.schema([("segment", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment, terms, ends, postings, keys, doc_ends = (batch.column(c)[row].as_py() for c in INDEX.names)
                seg = Segment(terms, ends, postings, doc_ends)
                spans, hits = [[] for _ in keys], [set() for _ in keys]
                begins = np.concatenate([[0], seg.doc_ends[:-1]])
                for words in (x for anchor in anchored.keys() & seg.number.keys() for x in anchored[anchor]):
                    if any(w not in seg.number for w in words):
                        continue
                    found = seg.phrase(list(words)) if near is None else seg.near(list(words), near)
                    for p, d in zip(found.tolist(), seg.doc_of(found).tolist()):
                        spans[d].append((p - int(begins[d]), p - int(begins[d]) + (len(words) if near is None else 1)))
                        hits[d] |= asked[words]
                merged = [_union(s) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([segment] * len(keys), range(len(keys)), keys, seg.doc_ends - begins, merged, [sorted(h) for h in hits]), schema)], schema=schema)

    return index.mapInArrow(run, FOUND)


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The test items, in blocks of about block_words words."""
    block, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((r.item_id, r.text.encode()))
        n += len(r.text) // 5 + 1
        if n >= block_words:
            yield block
            block, n = [], 0
    yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, near: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (merged word spans inside occurrences), items (ids, sorted as strings).

    The items are searched in blocks, each in one pass over the index whose hits are written, so that a block is all that the
    driver and a task hold of the benchmark. Hits of several blocks meet by the document's row in the index.

    Null texts have no words; null items and items without words match nothing; repeated items count by
    id; an empty benchmark hits nothing; repeated or null doc_ids stay separate rows. Other columns of either table aren't read.
    """
    index = build_index(docs)
    blocks = item_blocks(benchmark, block_words)
    every = search(index, next(blocks), window, near)
    more = [written(search(index, items, window, near).where(F.size("items") > 0)) for items in blocks if items]
    if more:
        every = written(every)
        row = ["segment", "place"]
        found = reduce(DataFrame.unionByName, more, every.where(F.size("items") > 0))
        found = found.groupBy(*row).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found"))
        every = every.join(found, row, "left").select("doc_id", "n_words", F.when(F.col("all").isNotNull(), _joined("all")).otherwise(F.col("spans")).alias("spans"), F.coalesce("found", "items").alias("items"))
    return every.select("doc_id", "n_words", "spans", "items")


def _joined(spans: str) -> Column:
    """Ascending spans, those that meet joined."""
    last = lambda out: F.try_element_at(out, F.lit(-1))
    return F.aggregate(
        spans, F.expr("cast(array() as array<array<bigint>>)"),
        lambda out, s: F.when((F.size(out) > 0) & (last(out)[1] >= s[0]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.array(last(out)[0], F.greatest(last(out)[1], s[1]))))).otherwise(F.concat(out, F.array(s))),
    )
