"""Ranked lexical search by K2-treaps: compressed quadtrees over the term-document grid whose cells store impact maxima."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, written
from .direct_codes import Codes, pack
from .phrase_index import item_blocks, words_of

#: Postings of one segment at least (but for a task's last); words of items searched at once; document ranges expanded at once.
SEGMENT_POSTINGS, BLOCK_WORDS, WAVE = 1_000_000, 50_000, 256
#: Parts into which an item's candidates are ranked before they meet.
SALTS = 32
SCALE = 1_000_000_000

INDEX = T.StructType(
    [
        # terms: distinct words, one a line, from the one in most documents of the segment on; df: documents that hold each;
        # height: levels below the root; masks: four bits for each cell of a level, two cells a byte; drops: codes of what each
        # child's maximum is below its parent's; top: the root's maximum; doc_ids: the columns.
        T.StructField("segment", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("df", T.BinaryType()), T.StructField("height", T.IntegerType()),
        T.StructField("masks", T.ArrayType(T.BinaryType())), T.StructField("drops", T.ArrayType(T.BinaryType())), T.StructField("top", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    ]
)
HITS = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def term_totals(docs: DataFrame) -> tuple[int, int]:
    """The documents with at least one term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for text in raw_texts(batch):
                size = len(words_of(text))
                n, total = n + (size > 0), total + size
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    row = docs.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of x (below 2**31) with a zero above each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> tuple[list[bytes], list[bytes], int]:
    """The quadtree of the cells (row, column), all different and at least one: masks and drops of each level from the root down, and the greatest value.

    A cell's quadrant is 2 * row bit + column bit. Level k has the cells of side 2**(height - k) that are not empty, in the
    order of their parents, so that a child's place is the number of set bits before its own.
    """
    code = spread(rows) << np.uint64(1) | spread(columns)
    order = np.argsort(code)
    code, values = code[order], values[order]
    masks, drops = [], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        most = np.maximum.reduceat(values, starts)
        bits = np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), starts)
        bits = np.append(bits, np.uint8(0)) if len(bits) % 2 else bits
        masks.append((bits[::2] | bits[1::2] << 4).astype(np.uint8).tobytes())
        drops.append(pack(np.repeat(most, np.diff(np.append(starts, len(code)))) - values))
        code, values = parent[starts], most
    return masks[::-1], drops[::-1], int(values[0])


class Treap:
    """One segment's quadtree, all levels opened into one array of cells. ranks: each column's place among equal scores."""

    def __init__(self, masks: list[bytes], drops: list[bytes], top: int, ranks: np.ndarray):
        self.height, self.ranks = len(masks), ranks
        most, child, upto = [np.array([top], np.int32)], [], 1
        for mask, drop in zip(masks, drops):
            packed = np.frombuffer(mask, np.uint8)
            cells = len(most[-1])
            bits = np.unpackbits(np.stack([packed & 15, packed >> 4], 1).reshape(-1, 1)[:cells], axis=1, bitorder="little", count=4).astype(bool)
            place = np.zeros((cells, 4), np.int32)
            place[bits] = np.arange(upto, upto + int(bits.sum()), dtype=np.int32)
            child.append(place)
            most.append(np.repeat(most[-1], bits.sum(1)) - Codes(drop).all().astype(np.int32))
            upto += len(most[-1])
        # cell 0 is the empty one: its maximum is 0 and its children are empty; the root is cell 1
        self.most = np.concatenate([np.zeros(1, np.int32), *most])
        self.child = np.concatenate([np.zeros((1, 4), np.int32), *(c + (c > 0) for c in child)])

    def best(self, rows: np.ndarray, weights: np.ndarray, limit: int, least: int) -> Iterator[tuple[int, int]]:
        """(column, score) of the `limit` columns with the greatest sums of weight * value over the rows, the first by rank of equal ones, and of others that were met; none below `least` or 1.

        The rows' paths descend together: a state is a range of columns with each row's cell over it, and its bound the
        weighted sum of the cells' maxima. The ranges with the highest bounds are halved, WAVE of them at once, until
        no range left can hold a column that comes before the `limit`-th found.
        """
        height, columns = self.height, len(self.ranks)
        cells, level, start = np.ones((1, len(rows)), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        heap, found, least = [(-int(weights.sum() * int(self.most[1])), 0)], [], (max(least, 1), -columns)
        used, steps = 1, np.arange(height + 1)
        # the half of the rows in which each row's path goes on below each level
        sides = (rows[None, :] >> np.maximum(height - 1 - steps, 0)[:, None] & 1) * 2
        while heap and -heap[0][0] >= least[0]:
            some = []
            for _ in range(min(WAVE, len(heap))):
                bound, i = heapq.heappop(heap)
                if -bound < least[0]:
                    break
                first, deep = int(start[i]), int(level[i])
                if -bound == least[0] and len(found) == limit and -int(self.ranks[first : first + (1 << (height - deep))].min()) <= least[1]:
                    continue
                if deep < height:
                    some.append(i)
                    continue
                yield first, -bound
                heapq.heappush(found, (-bound, -int(self.ranks[first])))
                if len(found) > limit:
                    heapq.heappop(found)
                least = max(least, found[0]) if len(found) == limit else least
            if not some:
                continue
            deep = level[some]
            both = self.child[cells[some][:, None, :], sides[deep][:, None, :] + np.array([0, 1])[:, None]]
            bounds = self.most[both].astype(np.int64) @ weights
            begins = start[some][:, None] + (np.array([0, 1]) << (height - 1 - deep)[:, None])
            keep = (bounds >= least[0]) & (begins < columns)
            new = int(keep.sum())
            while used + new > len(level):
                cells, level, start = np.concatenate([cells, np.empty_like(cells)]), np.tile(level, 2), np.tile(start, 2)
            to = slice(used, used + new)
            cells[to], start[to], level[to] = both[keep], begins[keep], np.broadcast_to(deep[:, None] + 1, keep.shape)[keep]
            for i, bound in enumerate(bounds[keep].tolist(), used):
                heapq.heappush(heap, (-bound, i))
            used += new


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 20 * m), with m = 50 + (50 * n * documents) div terms."""
    m = 50 + (50 * n * documents) // terms
    return SCALE * tf // (1000 * tf + 20 * m)


def build_treaps(docs: DataFrame, documents: int, terms: int) -> DataFrame:
    """Write a K2-treap of every word of every whole text, for segments of consecutive rows; nothing is shuffled. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        keys, held, tfs, sizes, total = [], [], [], [], 0
        serial = count(TaskContext.get().partitionId() << 33)

        def segment() -> pa.RecordBatch:
            term, tf = np.concatenate(held), np.concatenate(tfs).astype(np.int64)
            # documents of like length have like impacts: side by side, their maxima are tight
            by_size = np.argsort(np.array(sizes), kind="stable")
            column = np.empty(len(keys), np.int64)
            column[by_size] = np.arange(len(keys))
            each = np.array([len(h) for h in held])
            df = np.bincount(term, minlength=len(number))
            order = np.argsort(-df, kind="stable")
            row = np.empty(len(order), np.int64)
            row[order] = np.arange(len(order))
            height = max(1, int(max(len(order), len(keys)) - 1).bit_length())
            masks, drops, top = build(row[term], np.repeat(column, each), impact(tf, np.repeat(np.array(sizes, np.int64), each), documents, terms), height)
            words = list(number)
            values = (next(serial), b"\n".join(words[i] for i in order), df[order].astype("<i4").tobytes(), height, masks, drops, top, [keys[i] for i in by_size])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, INDEX_ARROW)], schema=INDEX_ARROW)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                words = words_of(text)
                if not words:
                    continue
                each, times = np.unique(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)), return_counts=True)
                keys.append(key)
                held.append(each)
                tfs.append(times)
                sizes.append(len(words))
                total += len(each)
                if total >= SEGMENT_POSTINGS:
                    yield segment()
                    number, keys, held, tfs, sizes, total = {}, [], [], [], [], 0
        if keys:
            yield segment()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), {"parquet.block.size": str(16 << 20), "compression": "zstd"})


INDEX_ARROW = pa.schema(
    [("segment", pa.int64()), ("terms", pa.binary()), ("df", pa.binary()), ("height", pa.int32()), ("masks", pa.list_(pa.binary())), ("drops", pa.list_(pa.binary())), ("top", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
)


def document_counts(index: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """In how many documents each asked word stands; the words are those of one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for terms, df in zip(batch.column("terms"), batch.column("df")):
                counts = np.frombuffer(df.as_py(), "<i4")
                for i, w in enumerate(terms.as_py().split(b"\n")):
                    if w in asked:
                        held[w] = held.get(w, 0) + int(counts[i])
        yield pa.RecordBatch.from_pydict({"term": pa.array(held.keys(), pa.binary()), "df": pa.array(held.values(), pa.int64())})

    found = index.select("terms", "df").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    return dict(zip(found.column("term").to_pylist(), found.column("df").to_pylist()))


def search(index: DataFrame, items: list[list[tuple[bytes, int]]], limit: int) -> DataFrame:
    """(item, doc_id, score): of each task's segments at least the `limit` best documents with a score above 0 for each item, a list of words and weights.

    A task keeps each item's `limit`-th score from segment to segment, and later segments are searched above it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[int, int]]] = [[] for _ in items]
        asked = {w for item in items for w, _ in item}
        for batch in batches:
            for k in range(batch.num_rows):
                terms, masks, drops, top, keys = (batch.column(c)[k].as_py() for c in ("terms", "masks", "drops", "top", "doc_ids"))
                row = {w: i for i, w in enumerate(terms.split(b"\n")) if w in asked}
                ranks = np.empty(len(keys), np.int64)
                ranks[sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0))] = np.arange(len(keys))
                treap = Treap(masks, drops, top, ranks)
                for i, item in enumerate(items):
                    here = [(row[w], weight) for w, weight in item if w in row and weight > 0]
                    if not here:
                        continue
                    least = kept[i][-1][0] if len(kept[i]) == limit else 1
                    rows, weights = (np.array(x, np.int64) for x in zip(*here))
                    new = [(score, keys[c]) for c, score in treap.best(rows, weights, limit, least)]
                    kept[i] = sorted(kept[i] + new, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:limit]
        columns = list(zip(*((i, d, s) for i, best in enumerate(kept) for s, d in best))) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=HITS.names)

    return index.select("terms", "masks", "drops", "top", "doc_ids").mapInArrow(run, HITS)


def ranked(docs: DataFrame, items: DataFrame, limit: int = 50, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per item its `limit` best documents with a score above 0: item_id, rank (from 1), doc_id, score; equal scores by doc_id.

    Items are searched in blocks, each in one pass over the index whose best rows are written, so that a block's words and
    weights are all that the driver and a task hold of the items. Candidates are ranked in salted parts first.

    Null texts have no words and are no documents; null items, items without words and words that no document has
    find nothing; repeated item_ids are ranked apart, with the same rows; repeated doc_ids stay separate rows, a null one comes
    first of equal scores; empty tables give no rows. Other columns of either table aren't read.
    """
    documents, terms = term_totals(docs)
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    if not documents:
        return out
    index = build_treaps(docs, documents, terms)
    for block in item_blocks(items, block_words):
        if not block:
            continue
        words = [sorted(set(words_of(text))) for _, text in block]
        df = document_counts(index, {w for ws in words for w in ws})
        weight = {w: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for w, n in df.items()}
        hits = search(index, [[(w, weight[w]) for w in ws if w in weight] for ws in words], limit)
        order = [F.desc("score"), F.asc_nulls_first("doc_id")]
        salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= limit)
        best = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= limit)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item long, item_id string")
        out = out.unionByName(written(best.join(names, "item").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")))
    return out
