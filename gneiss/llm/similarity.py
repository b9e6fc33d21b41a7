"""Size-aware heavy-light Jaccard join of shingle sets.

Small sets meet by enumerated subsets: two sets of sizes n and m reach the threshold exactly if they share a
subset of some size o(n, m), so equal subsets are links. Large sets meet in inverted lists: two such sets share
l of their first n - ceil(0.8 n) + l shingles in any order that all sets use, for any l up to their overlap: here a
sixteenth of the smaller set, and 5 at least. The boundary size is the one of least estimated cost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, raw_texts, total_bytes, written
from .components import components, sized

#: Words of a shingle; the threshold as a fraction; sets of more than this are never enumerated.
WORDS, NUM, DEN, MOST_LIGHT = 5, 80, 100, 16
#: Shingles of a task counted at once; how often one must be among them to be reported; the count from which it is frequent; the most
#: frequent ones that go to every task (16 MB). Frequency only orders a set's shingles: any order gives the same links.
COUNTED, LOCAL, FREQUENT, MOST_FREQUENT = 3_000_000, 6, 24, 1_000_000
#: List entries that linked sets share at least, and the part of the smaller set that they are; text bytes per bucket of inverted lists, and the most buckets of that size; one in so many keys
#: serves to find each set's first comparison.
SHARED, PART, BUCKET_BYTES, MOST_BUCKETS, FIRST_KEYS = 5, 16, 1 << 20, 200_000, 8
#: Rounds of joining at most; sets that a list offers in a round; which part of the links of the best round, or of a list's members, is few; how many pairs a member are few; members of a long list, and of the pieces of the longest. Text bytes per bucket where there would be more than MOST_BUCKETS. Pairs of members looked at, and held, at once.
MOST_ROUNDS, CENTRES, FEW, FEW_PAIRS, LONG_LIST, LIST_PIECE, LARGE_BUCKET, PAIRS_AT_ONCE, HELD_PAIRS = 12, 4, 32, 4, 400, 16_000, 1 << 24, 250_000, 1_000_000
#: 64-bit words of a set's parity sketch; at most so many rows with one are broadcast (20 MB).
SKETCH, BROADCAST_SKETCHES = 8, 150_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class WordHashes(dict):
    """64 bits of each word, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    if len(h) < WORDS:
        return _mix((h * _FACTORS[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[: len(h) - WORDS + 1] * _FACTORS[0]
    for k in range(1, WORDS):
        total = total + h[k : len(h) - WORDS + 1 + k] * _FACTORS[k]
    return np.unique(_mix(total))


def parity_sketch(hashes: np.ndarray) -> list[int]:
    """One bit of 64 * SKETCH for each class of hashes: is the number of members odd? Two sets differ in at least as many members as their sketches in bits."""
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def set_name(hashes: np.ndarray) -> str:
    """128 bits that tell sets apart; equal sets are one class."""
    return xxhash.xxh3_128_hexdigest(hashes.tobytes()) if len(hashes) else ""


def overlap(n: int, m: int) -> int:
    """The least intersection of linked sets of sizes n and m."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_size(n: int) -> int:
    return min(n, n - -(-NUM * n // DEN) + max(SHARED, n // PART))


def subset_sizes(n: int, most: int) -> list[int]:
    """o(n, m) of all partners' sizes m up to `most`."""
    return sorted({overlap(n, m) for m in range(-(-NUM * n // DEN), min(most, DEN * n // NUM) + 1)})


def boundary(sizes: dict[int, int], partners: float) -> int:
    """The largest size whose sets are enumerated, by least cost.

    sizes: sets by size. A small set costs its subsets; a large one its list entries, each met by `partners` others of as many shingles.
    """
    heavy = lambda n: prefix_size(n) * (1 + partners * n)
    cost = lambda b: sum(c * (sum(comb(n, k) for k in subset_sizes(n, b)) if n <= b else heavy(n)) for n, c in sizes.items() if n <= 2 * MOST_LIGHT)
    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


PROFILE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("set", T.StringType()), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("uses", T.LongType())])


def profiles(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: doc_id, set, n of each document; key, uses of shingles that a task found often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, total = WordHashes(), set(), [], 0
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def often() -> pa.RecordBatch:
            keys, uses = np.unique(np.concatenate(held), return_counts=True)
            keys, uses = keys[uses >= LOCAL].astype(np.int64), uses[uses >= LOCAL]
            none = [pa.nulls(len(keys), t) for t in types[:3]]
            return pa.RecordBatch.from_arrays([*none, pa.array(keys), pa.array(uses, pa.int64())], names=PROFILE.names)

        for batch in batches:
            names, sizes = [], []
            for text in raw_texts(batch):
                s = shingle_set(text, hashes)
                names.append(set_name(s))
                sizes.append(len(s))
                if names[-1] not in seen:
                    seen.add(names[-1])
                    held.append(s)
                    total += len(s)
                    if total >= COUNTED:
                        yield often()
                        held, total = [], 0
                        seen.clear()
            rest = [pa.nulls(batch.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), *rest], names=PROFILE.names)
        if held:
            yield often()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PROFILE))


def frequent_shingles(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of frequent shingles, ascending, and the binary order of magnitude of their use; at most MOST_FREQUENT, the most frequent."""
    uses = written(profile.where("key is not null").groupBy("key").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= FREQUENT).withColumn("level", F.floor(F.log2("uses")).cast("int")))
    at_level = {r.level: r["count"] for r in uses.groupBy("level").count().collect()}
    least, total = 99, 0
    for level in sorted(at_level, reverse=True):
        total += at_level[level]
        if total > MOST_FREQUENT:
            break
        least = level
    rows = uses.where(F.col("level") >= least).select("key", "level").toPandas()
    keys = rows["key"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["level"].to_numpy(np.int8)[order]


LISTED = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("common", T.IntegerType())])
PACKED = T.StructType(
    [
        # negative buckets: entries of frequent shingles, known to be shared; others: entries of one bucket of keys
        T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("common", T.BinaryType()),
    ]
)


def shared_keys(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], light: int, buckets: int) -> DataFrame:
    """(key, id, n, common) of all keys that more than one document may have: n is the set's size; common is the subset's size, 0 for an inverted list.

    A task packs its entries by bucket of keys, so that few large rows are shuffled.
    """
    often, level = frequent

    def entries(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, subset sizes, and whether each is a frequent shingle."""
        keys, sizes, known = [], [], []
        n = len(s)
        if n <= light:
            for c in subset_sizes(n, light):
                got = np.array([s[list(k)].sum() for k in combinations(range(n), c)], np.uint64)
                keys.append(_mix(_mix(got) + np.uint64(c)))
                sizes.append(np.full(len(got), c, np.int8))
                known.append(np.zeros(len(got), bool))
        if n * DEN > light * NUM:
            at = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
            rank = np.where(often[at] == s, level[at], 0) if len(often) else np.zeros(n, np.int8)
            first = np.argsort(rank, kind="stable")[: prefix_size(n)]
            keys.append(s[first])
            sizes.append(np.zeros(len(first), np.int8))
            known.append(rank[first] > 0)
        return tuple(np.concatenate(x) for x in (keys, sizes, known))

    def pack_all(ids: list[int], ns: list[int], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, common, known = (np.concatenate([p[k] for p in parts]) for k in range(3))
        each = [len(p[0]) for p in parts]
        owner, sizes = np.repeat(np.array(ids, np.int64), each), np.repeat(np.array(ns, np.int32), each)
        bucket = np.where(known, -1 - owner % buckets, (_mix(keys) % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        cuts = np.nonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1))[0]
        columns = (keys, owner, sizes, common)
        rows = [(int(bucket[order[a]]), *(c[order[a:b]].tobytes() for c in columns)) for a, b in zip(cuts, [*cuts[1:], len(order)])]
        for low in range(0, len(rows), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[low : low + 200]), (pa.int32(), *[pa.binary()] * 4))], names=PACKED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, ns, parts, total = WordHashes(), [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                s = shingle_set(text, hashes)
                if doc is None or not len(s):
                    continue
                ids.append(doc)
                ns.append(len(s))
                parts.append(entries(s))
                total += len(parts[-1][0])
                if total >= COUNTED:
                    yield from pack_all(ids, ns, parts)
                    ids, ns, parts, total = [], [], [], 0
        if parts:
            yield from pack_all(ids, ns, parts)

    def repeated(name: tuple, table: pa.Table) -> pa.Table:
        keys, ids, sizes, common = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in zip(PACKED.names[1:], (np.int64, np.int64, np.int32, np.int8)))
        if name[0].as_py() >= 0:
            _, at, uses = np.unique(keys, return_inverse=True, return_counts=True)
            more = uses[at] > 1
            keys, ids, sizes, common = keys[more], ids[more], sizes[more], common[more]
        return pa.table([pa.array(keys), pa.array(ids), pa.array(sizes), pa.array(common.astype(np.int32))], names=LISTED.names)

    return docs.mapInArrow(run, PACKED).groupBy("bucket").applyInArrow(repeated, LISTED)


def _contents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes, sketch) of the documents of these ids: their texts are read again."""
    longs = T.ArrayType(T.LongType())
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("hashes", longs), T.StructField("sketch", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                sets = [shingle_set(t, hashes) for t in raw_texts(some)]
                columns = [s.astype(np.int64) for s in sets], [parity_sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays([some.column("id"), *(pa.array(c, pa.list_(pa.int64())) for c in columns)], names=out.names)

    texts = docs.withColumnRenamed("doc_id", "id").join(sized(written(ids)), "id", "left_semi")
    return written(texts.select("id", "text").mapInArrow(run, out), {"compression": "zstd"})


def _linked(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets reach the threshold, exactly."""
    left = contents.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = contents.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    linked = same * (NUM + DEN) >= (F.size("x") + F.size("y")) * NUM
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b").distinct()


def _shared_sizes(contents: DataFrame) -> DataFrame:
    """(id, shared): how many of a set's shingles any other of these sets has. No set can share more with another."""
    each = contents.select("id", F.explode("hashes").alias("h"))
    more = each.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("h")
    return each.join(more, "h", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))


#: What a list says of a member.
MEMBER = ("id", "n", "shared", "sketch")


def _mixed(placed: DataFrame) -> DataFrame:
    """The lists whose members are of several parts."""
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    return placed.join(sized(written(several)), "key", "left_semi")


def _may_link(x: np.ndarray, y: np.ndarray, of: dict[str, np.ndarray], light: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the members x and y may be linked, by their parts, their sizes, what each shares with any other set, and their sketches; and in how many bits the sketches of these differ."""
    n, m = of["n"][x], of["n"][y]
    small, large = np.minimum(n, m), np.maximum(n, m)
    apart = (of["part"][x] != of["part"][y]) & ((of["cross"][x] == 0) | (of["piece"][x] != of["piece"][y]))
    able = np.nonzero(apart & (small * DEN >= large * NUM) & (large > light) & (np.minimum(of["shared"][x], of["shared"][y]) * (NUM + DEN) >= (n + m) * NUM))[0]
    bits = np.bitwise_count(of["sketch"][x[able]] ^ of["sketch"][y[able]]).sum(axis=1, dtype=np.int64)
    both = (n + m)[able]
    near = (both - bits) * (NUM + DEN) >= both * 2 * NUM
    return able[near], bits[near]


def _pairs_of(starts: np.ndarray, ends: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within the lists [start, end), whose members ascend by n, that are near enough in size; at most about PAIRS_AT_ONCE of them at a time."""
    lengths = ends - starts
    x = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    stop = np.repeat(ends, lengths)
    if len(lengths) and lengths.max() > 64:
        long = np.nonzero(lengths > 64)[0]
        for i, at in zip(long, (np.cumsum(lengths) - lengths)[long]):
            own = n[starts[i] : ends[i]]
            stop[at : at + len(own)] = starts[i] + np.searchsorted(own, own * DEN // NUM, side="right")
    each = stop - x - 1
    upto, low = np.cumsum(each), 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS_AT_ONCE, side="right")))
        k = each[low:high]
        left = np.repeat(x[low:high], k)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        low = high


MET = T.StructType(
    [
        # a list that stays open; else a pair, how many lists of one bucket hold it and how many of all must; else a member, a centre, the distance of their sketches, and their parts
        T.StructField("key", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("k", T.LongType()), T.StructField("enough", T.LongType()),
        T.StructField("far", T.DoubleType()), T.StructField("part", T.LongType()), T.StructField("other", T.LongType()),
    ]
)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair (a, b) first stands, and how often it is there."""
    order = np.lexsort((b, a))
    first = np.nonzero((np.diff(a[order], prepend=0) != 0) | (np.diff(b[order], prepend=0) != 0) | (np.arange(len(a)) == 0))[0]
    return order[first], np.diff(np.append(first, len(a)))


def _blocks(lists: DataFrame, piece: int) -> DataFrame:
    """The lists with block, piece and cross: a list of more than `piece` members is split, and each two of its pieces meet in a block (cross), each piece in one of its own."""
    sizes = written(lists.groupBy("key").count().where(F.col("count") > piece).select("key", F.ceil(F.col("count") / F.lit(piece)).cast("int").alias("pieces")))
    if sizes.isEmpty():
        return lists.select("*", F.lit(0).alias("block"), F.lit(0).alias("piece"), F.lit(False).alias("cross"))
    split = lists.join(sized(sizes), "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    block = F.least("piece", "other") * F.col("pieces") + F.greatest("piece", "other")
    return split.select(*lists.columns, block.alias("block"), "piece", (F.col("piece") != F.col("other")).alias("cross"))


def _met(lists: DataFrame, light: int, buckets: int, number: int, last: bool, long_list: int, piece: int) -> DataFrame:
    """What the members of the lists (key, id, n, part, shared, sketch) may be linked with, as rows of MET; lists of one part are dropped.

    A list gives all its pairs across parts that may be linked. One with many such pairs for its members stays open instead, unless this is the last
    round, and offers a few centres, one of its largest part and others drawn anew, to its members of other parts. Lists of more than
    `long_list` members meet their centres first, and all their pairs are only looked at if few members may be linked with one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        of = {c: table.column(c).to_numpy().astype(np.int64) for c in ("key", "block", "id", "n", "part", "shared", "piece", "cross")}
        order = np.lexsort((of["id"], of["n"], of["block"], of["key"]))
        of = {c: v[order] for c, v in of.items()}
        of["sketch"] = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)[order]
        starts = np.nonzero((np.diff(of["key"], prepend=0) != 0) | (np.diff(of["block"], prepend=0) != 0) | (np.arange(len(order)) == 0))[0]
        several = np.minimum.reduceat(of["part"], starts) != np.maximum.reduceat(of["part"], starts)
        starts, ends = starts[several], np.append(starts[1:], len(order))[several]
        opened = np.zeros(len(starts), bool)

        def batch(**columns: np.ndarray) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            types = [pa.float64() if c == "far" else pa.int64() for c in MET.names]
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(MET.names, types)], names=MET.names)

        def offer(start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The list's members and centres that may be linked, and in how many bits their sketches differ."""
            at = np.arange(start, end)
            parts, sizes = np.unique(of["part"][at], return_counts=True)
            drawn = [_mix((of["id"][at].astype(np.uint64) + np.uint64(number * CENTRES + i + 1)) * _FACTORS[0]) for i in range(CENTRES)]
            main = np.nonzero(of["part"][at] == parts[sizes.argmax()])[0]
            centres = np.unique([main[drawn[0][main].argmin()], *(h.argmin() for h in drawn[1:])]) + start
            x, y = np.repeat(at, len(centres)), np.tile(centres, len(at))
            got, bits = _may_link(x, y, of, light)
            return x[got], y[got], bits

        def closed(held: list[tuple]) -> pa.RecordBatch:
            x, y, at = (np.concatenate(h) for h in zip(*held))
            x, y = x[~opened[at]], y[~opened[at]]
            a, b = np.maximum(of["id"][x], of["id"][y]), np.minimum(of["id"][x], of["id"][y])
            first, uses = _distinct(a, b)
            n, m = of["n"][x[first]], of["n"][y[first]]
            enough = np.minimum(np.maximum(SHARED, np.minimum(n, m) // PART), -(-(n + m) * NUM // (NUM + DEN)))
            return batch(a=a[first], b=b[first], k=uses, enough=enough)

        if not last:
            for i in np.nonzero(ends - starts > long_list)[0]:
                opened[i] = len(np.unique(offer(starts[i], ends[i])[0])) * FEW > ends[i] - starts[i]
        here = np.nonzero(~opened)[0]
        found, held, total = np.zeros(len(starts), np.int64), [], 0
        for x, y in _pairs_of(starts[here], ends[here], of["n"]):
            got, _ = _may_link(x, y, of, light)
            x, y = x[got], y[got]
            at = np.searchsorted(starts, x, side="right") - 1
            found += np.bincount(at, minlength=len(starts))
            if not last:
                opened |= found > FEW_PAIRS * (ends - starts)
            held.append((x, y, at))
            total += len(x)
            if total > HELD_PAIRS:
                yield closed(held)
                held, total = [], 0
        if held:
            yield closed(held)
        if opened.any():
            x, y, bits = (np.concatenate(o) for o in zip(*(offer(starts[i], ends[i]) for i in np.nonzero(opened)[0])))
            first, _ = _distinct(of["id"][x], of["id"][y])
            x, y, bits = x[first], y[first], bits[first]
            yield batch(a=of["id"][x], b=of["id"][y], far=bits / (of["n"][x] + of["n"][y]), part=of["part"][x], other=of["part"][y])
            yield batch(key=np.unique(of["key"][starts[opened]]))

    return _blocks(lists, piece).groupBy(F.pmod(F.xxhash64("key", "block"), F.lit(buckets)).alias("bucket")).applyInArrow(run, MET)


def _pairs_across(lists: DataFrame, contents: DataFrame, light: int, buckets: int, long_list: int = LONG_LIST, piece: int = LIST_PIECE) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join parts of the lists, and the pairs (a, b) across parts that are still to be compared.

    Most lists give their pairs in the first pass. While some stay open there are rounds: a member of one is compared with the centre whose
    sketch is nearest to its own, as many comparisons as there are members, however long the lists, and parts that are linked become one.
    Rounds end when no list stays open, or when one finds few links; they spare comparisons and decide nothing.
    """
    found, rest, tried, most, last = [], [], None, 0, not MOST_ROUNDS
    for number in range(MOST_ROUNDS + 1):
        met = written(_met(lists, light, buckets, number, last, long_list, piece))
        opened = written(met.where("key is not null").select("key").distinct())
        closed = met.where("k is not null").groupBy("a", "b").agg(F.sum("k").alias("k"), F.max("enough").alias("enough"))
        if opened.isEmpty():
            # all lists of these pairs are counted here, or have given them before
            rest.append(closed.where("k >= enough").select("a", "b"))
            break
        rest.append(closed.select("a", "b"))
        pairs = met.where("far is not null")
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs.groupBy("a").agg(F.min_by(F.struct("b", "part", "other"), F.struct("far", "b")).alias("of")).select("a", "of.*"))
        new = written(_linked(pairs.select("a", "b"), contents))
        found.append(new)
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        size = new.count()
        most = max(most, size)
        last = size * FEW <= most or number == MOST_ROUNDS - 1
        # a part takes the name of the least part it is linked to: equal names stay in one component, and the next rounds join what this leaves apart
        ends = pairs.join(new, ["a", "b"]).select(F.explode(F.array(F.struct("part", "other"), F.struct(F.col("other").alias("part"), F.col("part").alias("other")))).alias("e")).select("e.*")
        names = sized(written(ends.where("other < part").groupBy("part").agg(F.min("other").alias("name"))))
        for _ in range(2):
            names = names.join(names.select(F.col("part").alias("name"), F.col("name").alias("least")), "name", "left").select("part", F.coalesce("least", "name").alias("name"))
        names = written(names)
        before, lists = lists, lists.join(sized(opened), "key", "left_semi").join(sized(names), "part", "left").select("key", *MEMBER, F.coalesce("name", "part").alias("part"))
        lists = written(lists)
        forget(before, names)
    empty = lists.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return functools.reduce(DataFrame.unionByName, found, empty), functools.reduce(DataFrame.unionByName, rest).distinct()


def similar_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id for every row.

    1. Every whole text becomes a set; equal sets are one class, for which its smallest doc_id stands.
    2. Classes meet by shared subsets or list entries. First each meets one other, the one it shares most of some keys with, which joins groups
       of near copies by as many comparisons as they have members. Then every list that holds several components gives all pairs across
       them that may be linked, which are compared, so that no link between components is missed; lists with many such pairs are joined in
       rounds of few comparisons before.
    3. Components of the links found are those of all links, since what isn't compared is in one component already.

    Texts without words have 0 shingles and are linked with nothing, a null text too; rows with a null doc_id come back with
    a null component and link nothing; rows of one doc_id are one document to the links, of which any text counts; an empty table
    gives no rows. Other columns of docs aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = profiles(docs)
    known = profile.where("set is not null")
    classes = written(known.where("n > 0 and doc_id is not null").groupBy("set", "n").agg(F.min("doc_id").alias("root"), F.count("*").alias("copies")))
    frequent = frequent_shingles(profile)
    total = classes.agg(F.sum("n").alias("n")).first().n or 1
    squares = profile.where(f"uses >= {FREQUENT}").agg(F.sum(F.col("uses").cast("double") * F.col("uses")).alias("s")).first().s or 0.0
    sizes = {r.n: r["count"] for r in classes.where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").count().collect()}
    light = boundary(sizes, squares / total)
    size = total_bytes(docs)
    buckets = max(1, min(MOST_BUCKETS, size // BUCKET_BYTES), size // LARGE_BUCKET)

    copies = known.join(classes.where("copies > 1").select("set", "root"), "set").where("doc_id <> root").select("doc_id").distinct()
    copies = sized(written(copies.join(classes.select(F.col("root").alias("doc_id")), "doc_id", "left_anti")))
    listed = written(shared_keys(docs.join(copies, "doc_id", "left_anti"), frequent, light, buckets))

    most = F.ceil(F.col("n") * NUM / F.lit(DEN)).cast("int")
    entries = lambda n: F.greatest(F.lit(SHARED), F.floor(n / F.lit(PART)).cast("int"))
    # a document with fewer shared entries than any link takes is in no pair
    strong = listed.where("common = 0").groupBy("id", "n").agg(F.count("*").alias("k")).where(F.col("k") >= F.least(entries(most), most)).select("id")
    lists, subsets = written(listed.where("common = 0").join(sized(written(strong.distinct())), "id", "left_semi")), listed.where("common > 0")
    smallest = subsets.groupBy("key", "common").agg(F.min(F.struct("n", "id")).alias("s"))
    need = F.ceil((F.col("n") + F.col("s.n")) * NUM / F.lit(NUM + DEN))
    by_subset = subsets.join(smallest, ["key", "common"]).where(need <= F.col("common")).select(F.col("id").alias("a"), F.col("s.id").alias("b"))
    fits = lambda n, m: F.least(n, m) * DEN >= F.greatest(n, m) * NUM
    few = lists.where(F.pmod(F.xxhash64("key"), F.lit(FIRST_KEYS)) == 0)
    centre = few.groupBy("key").agg(F.min(F.struct("id", "n")).alias("s"))
    by_centre = few.join(centre, "key").where(fits(F.col("n"), F.col("s.n")) & (F.col("id") != F.col("s.id"))).groupBy("id", F.col("s.id").alias("centre")).agg(F.count("*").alias("k"))
    by_centre = by_centre.groupBy("id").agg(F.max_by("centre", F.struct("k", "centre")).alias("b")).select(F.col("id").alias("a"), "b")
    first_pairs = written(by_subset.unionByName(by_centre).select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    links = written(_linked(first_pairs, _contents(docs, first_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())))

    joined = sized(written(components(links)))
    placed = lists.join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("part"))
    open_lists = written(_mixed(placed))

    # and takes shingles that another open set has for nearly all of the set
    strong = written(open_lists.groupBy("id", "n").agg(F.count("*").alias("k")).where(F.col("k") >= F.least(entries(most), most)).select("id", "n").distinct())
    contents = _contents(docs, strong.select("id").distinct())
    for _ in range(2):
        able = written(_shared_sizes(contents).join(strong, "id").where(F.col("shared") >= most).select("id", "shared"))
        contents = contents.join(sized(able.select("id").distinct()), "id", "left_semi")
    able = written(able.join(contents.select("id", "sketch"), "id"))
    found, rest = _pairs_across(open_lists.join(sized(able, BROADCAST_SKETCHES), "id"), contents, light, buckets)
    rest = written(rest.join(first_pairs, ["a", "b"], "left_anti"))
    joined = components(links.unionByName(found).unionByName(_linked(rest, contents))).withColumnRenamed("node", "root")

    named = classes.select("set", "root").join(sized(written(joined)), "root").select("set", F.col("component").alias("component_id"))
    alone = classes.where("copies > 1").join(joined, "root", "left_anti").select("set", F.col("root").alias("component_id"))
    labels = sized(written(named.unionByName(alone)))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return known.join(labels, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), own)
