"""Subword lattice likelihood: a vocabulary's pieces weight all segmentations of each word; the forward recursion sums them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, written

#: EM passes over the distinct training words; the weight of the given scores in each, as a part of those words; discount of seen words where their counts give none.
PASSES, PRIOR, DISCOUNT = 2, 0.02, 0.75
#: Bytes of text in a block at least (but for a task's last); words held at once; cells of one lattice batch.
BLOCK_BYTES, HELD_WORDS, CELLS = 24_000_000, 200_000, 200_000
START, BASE, CELL = "▁", np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as hashes: pieces that begin a word, then those that go on, 256 bytes and the stop, with their log probabilities."""

    keys: np.ndarray  # hash of each piece
    log_p: np.ndarray
    begins: np.ndarray  # is it a beginning piece
    longest: int  # characters of the longest piece

    @property
    def byte0(self) -> int:
        return len(self.log_p) - 257

    @property
    def stop(self) -> int:
        return len(self.log_p) - 1

    def weighted(self, log_p: np.ndarray) -> Pieces:
        return Pieces(self.keys, log_p, self.begins, self.longest)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * CELL
    return h ^ (h >> np.uint64(29))


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of columns of code points: h[j] covers the first j rows."""
    h = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
    for j in range(codes.shape[0]):
        h[j + 1] = h[j] * BASE + _mix(codes[j].astype(np.uint64) + np.uint64(1))
    return h


def pieces(scored: list[tuple[str, float]]) -> Pieces:
    """From (piece, score): scores are log weights. Pieces with the word mark elsewhere than in front are dropped. A lone mark
    begins any word; bytes spell any character."""
    first = {p[1:]: s for p, s in scored if p.startswith(START) and START not in p[1:]}
    later = {p: s for p, s in scored if p and START not in p}
    low = min([0.0, *first.values(), *later.values()]) - 1
    first.setdefault("", low)
    names = [(p, True) for p in sorted(first)] + [(p, False) for p in sorted(later)]
    begins = np.array([b for _, b in names] + [False] * 257)
    weights = np.array([(first if b else later)[p] for p, b in names] + [low] * 256 + [0.0])
    weights[-1] = np.logaddexp.reduce(weights[~begins]) - np.log(2.0)
    return Pieces(np.array([hash_of(p, b) for p, b in names], np.uint64), _normal(weights, begins), begins, max(1, *(len(p) for p, _ in names)))


def _normal(weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each of the two kinds sums to 1."""
    out = weights.copy()
    for kind in (begins, ~begins):
        out[kind] -= np.logaddexp.reduce(weights[kind])
    return out


def hash_of(piece: str, begins: bool) -> np.uint64:
    with np.errstate(over="ignore"):
        h = _prefix(np.array([ord(c) for c in piece], np.uint32).reshape(-1, 1))[-1]
        return _key(h, np.array([len(piece)]), begins)[0]


def _key(h: np.ndarray, length: np.ndarray, begins: bool) -> np.ndarray:
    return _mix(h + (length * 2 + begins + 1).astype(np.uint64) * CELL)


def rank_scores(model_file: str) -> list[tuple[str, float]]:
    """(piece, log weight) of a sentencepiece vocabulary. Scores that are ranks of merges become those of a Zipf-Mandelbrot law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scored = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids]
    ranks = len(scored) > 1 and min(s for _, s in scored if s > -1e8) < -100
    return [(p, -float(np.log(2.7 - s)) if ranks else s) for p, s in scored if s > -1e8]


class Lattice:
    """Batched recursions, in log space, over words of one length: arrays have a column a word."""

    BITS = 20

    def __init__(self, vocabulary: Pieces):
        self.v, self.none = vocabulary, len(vocabulary.log_p)
        self.lp = np.append(vocabulary.log_p, -np.inf)
        # a key's place comes from its first bits; keys that find it taken are placed by the next bits
        self.known = np.append(vocabulary.keys, np.uint64(0))
        self.empty = len(vocabulary.keys)
        left, self.tables = np.arange(self.empty), []
        while len(left):
            table = np.full(1 << self.BITS, self.empty, np.int32)
            at = self._place(self.known[left], len(self.tables))
            table[at] = left
            left = left[table[at] != left]
            self.tables.append(table)

    def _place(self, key: np.ndarray, level: int) -> np.ndarray:
        return ((key * (BASE + np.uint64(2 * level))) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def slots(self, key: np.ndarray) -> np.ndarray:
        """The piece of each key, or `none`."""
        out = self.tables[0][self._place(key, 0)]
        wrong = self.known[out] != key
        if len(self.tables) > 1:
            odd = np.nonzero(wrong & (out != self.empty))
            rest = key[odd]
            for level in range(1, len(self.tables)):
                other = self.tables[level][self._place(rest, level)]
                fits = self.known[other] == rest
                out[tuple(x[fits] for x in odd)] = other[fits]
            wrong = self.known[out] != key
        out[wrong] = self.none
        return out

    def _edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i0, j, slots of the pieces that end before j): one row for each start i0 to j - 1, and a last for the beginning piece."""
        size, longest = codes.shape[0], self.v.longest
        h, power = _prefix(codes), np.ones(longest + 1, np.uint64)
        for k in range(longest):
            power[k + 1] = power[k] * BASE
        nothing = np.full((1, codes.shape[1]), self.none, np.int32)
        for j in range(1, size + 1):
            i0 = max(0, j - longest)
            long = j - np.arange(i0, j)
            part = h[j] - h[i0:j] * power[long][:, None]
            inner = self.slots(_key(part, long[:, None], False))
            first = self.slots(_key(h[j : j + 1], np.array([[j]]), True)) if j <= longest else nothing
            yield i0, j, np.concatenate([inner, first])

    def _spelled(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character as bytes."""
        lp, c = self.v.log_p[self.v.byte0 : self.v.byte0 + 256], codes.astype(np.int64)
        out = lp[np.minimum(c, 127)]
        for n, lead, low, high in ((1, 0xC0, 128, 2048), (2, 0xE0, 2048, 65536), (3, 0xF0, 65536, 1 << 21)):
            if (k := np.nonzero((c >= low) & (c < high)))[0].size:
                some = c[k]
                out[k] = lp[lead | (some >> (6 * n))] + sum(lp[0x80 | (some >> (6 * m) & 63)] for m in range(n))
        return out

    def forward(self, codes: np.ndarray, keep: bool = False):
        """Log probability of each word (a column of code points), the stop included; with keep also what `expect` needs.

        a[j]: log of the summed weight of all segmentations of the first j characters.
        """
        size, spelled = codes.shape[0], self._spelled(codes)
        a, kept = np.empty((size + 1, codes.shape[1])), []
        a[0] = self.lp[self.slots(np.array([hash_of("", True)]))[0]]
        for i0, j, slots in self._edges(codes):
            terms = np.concatenate([self.lp[slots], spelled[j - 1 : j] + a[j - 1]])
            terms[: j - i0] += a[i0:j]
            most = terms.max(axis=0)
            a[j] = most + np.log(np.exp(terms - most).sum(axis=0))
            if keep:
                kept.append((i0, slots, terms))
        total = a[size] + self.lp[self.v.stop]
        return (total, a, kept, spelled) if keep else total

    def expect(self, codes: np.ndarray, into: np.ndarray) -> None:
        """Add the expected uses of every piece in the words, by forward and backward sums."""
        size, words = codes.shape
        total, a, kept, spelled = self.forward(codes, keep=True)
        b = np.full((size + 1, words), -np.inf)
        b[size] = self.lp[self.v.stop]
        for j in range(size, 0, -1):
            i0, slots, terms = kept[j - 1]
            # b[j] is whole: all that begins at j ends later
            use = np.exp(terms + (b[j] - total))
            into += np.bincount(slots.ravel(), use[:-1].ravel(), minlength=len(into))[: len(into)]
            for k, byte in _bytes_of(codes[j - 1].astype(np.int64)):
                into += np.bincount(self.v.byte0 + byte, use[-1][k], minlength=len(into))
            reach = self.lp[slots[:-1]]
            reach[-1] = np.logaddexp(reach[-1], spelled[j - 1])
            b[i0:j] = np.logaddexp(b[i0:j], reach + b[j])
        lone = self.slots(np.array([hash_of("", True)]))[0]
        into[lone] += np.exp(a[0] + b[0] - total).sum()
        into[self.v.stop] += words

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indexes into words, code points with a column a word), words of one size together, in batches of bounded cells."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        ordered, at = sizes[order], 0
        while at < len(order):
            size = int(ordered[at])
            same = int(np.searchsorted(ordered, size, side="right"))
            some = order[at : min(same, at + max(1, CELLS // (size + 1)))]
            text = "".join([words[i] for i in some])
            yield some, np.ascontiguousarray(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size).T)
            at += len(some)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        with np.errstate(over="ignore"):
            for some, codes in self.batches(words):
                out[some] = self.forward(codes)
        return out


def _bytes_of(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, byte) of the UTF-8 forms of code points."""
    kinds = np.digitize(c, [128, 2048, 65536])
    for n, lead in enumerate((0, 0xC0, 0xE0, 0xF0)):
        k = np.nonzero(kinds == n)[0]
        if len(k):
            yield k, lead | (c[k] >> (6 * n))
            for m in range(n):
                yield k, 0x80 | (c[k] >> (6 * m) & 63)


class _Numbers(dict):
    """Words by order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


BLOCKS = T.StructType(
    [
        # a row for each distinct word of a block: its number there and its uses in training texts
        T.StructField("block", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("uses", T.LongType()),
        # and one for the block: its documents, and the numbers of their words, 32 bits each, document after document
        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("held_out", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("numbers", T.BinaryType()),
    ]
)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Write the words of every whole text (doc_id, text, held_out) as numbers into a dictionary of the block: texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 33)
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        number, ids, held, parts, total = _Numbers(), [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            at, n = next(serial), len(number)
            train = [p for p, out in zip(parts, held) if not out]
            uses = np.bincount(np.concatenate(train), minlength=n) if train else np.zeros(n, np.int64)
            words = list(number)
            for low in range(0, n, 50_000):
                some = pa.array(words[low : low + 50_000], pa.binary()).cast(pa.string())
                columns = [pa.array(np.full(len(some), at)), pa.array(np.arange(low, low + len(some), dtype=np.int32)), some, pa.array(uses[low : low + 50_000].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(some), t) for t in types[4:])], names=BLOCKS.names)
            whole = (at, None, None, None, ids, held, [len(p) for p in parts], np.concatenate(parts).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(whole, types)], names=BLOCKS.names)

        for batch in batches:
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), raw_texts(batch)):
                words = text.lower().split()
                ids.append(doc)
                held.append(out)
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                total += len(text) + 8
                if total >= BLOCK_BYTES:
                    yield from block()
                    number, ids, held, parts, total = _Numbers(), [], [], [], 0
        if ids:
            yield from block()

    return written(docs.mapInArrow(run, BLOCKS), {"compression": "zstd", "parquet.block.size": str(32 << 20)})


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, some HELD_WORDS rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD_WORDS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def trained(words: DataFrame, vocabulary: Pieces, passes: int, n_words: int) -> Pieces:
    """EM: expected piece counts over the distinct training words (word), and the given scores as PRIOR * n_words uses more, become the next
    weights: the pieces stand in for words not seen, so each type counts once. One sum per piece reaches the driver."""
    out = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])
    given = np.exp(vocabulary.log_p) * max(1.0, PRIOR * n_words)
    for _ in range(passes):

        def run(batches: Iterator[pa.RecordBatch], v: Pieces = vocabulary) -> Iterator[pa.RecordBatch]:
            lattice, into = Lattice(v), np.zeros(len(v.log_p))
            with np.errstate(over="ignore"):
                for chunk in _in_chunks(batches):
                    for _, codes in lattice.batches(chunk.column("word").to_pylist()):
                        lattice.expect(codes, into)
            used = np.nonzero(into)[0]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(into[used])], names=["k", "v"])

        expected = given.copy()
        for r in words.mapInArrow(run, out).groupBy("k").agg(F.sum("v").alias("v")).collect():
            expected[r.k] += r.v
        vocabulary = vocabulary.weighted(_normal(np.log(expected), vocabulary.begins))
    return vocabulary


SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ]
)
#: Of some words of a block: numbers, training uses and log10 probabilities.
LOOKED_UP = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("uses", T.BinaryType()), T.StructField("score", T.BinaryType())])


@dataclass(frozen=True)
class Totals:
    """Of the training rows: word tokens, word types, those used once and twice, and texts."""

    words: int
    types: int
    once: int
    twice: int
    ends: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else DISCOUNT

    def word_scores(self, uses: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log10 P of words from their training uses and log10 of their piece sums."""
        if not self.words:
            return q + np.log10(0.5)
        n, d = self.words + self.ends, self.discount
        with np.errstate(divide="ignore"):
            seen = np.log10(np.maximum(uses - d, 0) / n)
        return np.logaddexp(seen * np.log(10), (q + np.log10(d * self.types / n)) * np.log(10)) / np.log(10)

    @property
    def end_score(self) -> float:
        return float(np.log10(self.ends / (self.words + self.ends))) if self.words else float(np.log10(0.5))

    def base(self, uses: np.ndarray) -> np.ndarray:
        n, v = self.words + self.ends, self.types + (self.ends > 0)
        return np.log10((uses + 0.1) / (n + 0.1 * (v + 1)))


def score_texts(docs: DataFrame, held_out, vocabulary: list[tuple[str, float]], passes: int = PASSES) -> DataFrame:
    """Score every whole text by a model of those rows where held_out (a Column) is false.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end. A word's probability is summed over all paths
    of a lattice: the path of the word itself, if training had it (its discounted share), and all segmentations into the vocabulary's
    pieces, that share what discounting left: P(w) = (max(c - D, 0) + D * V * Q(w)) / N. Q is the forward sum over
    pieces, whose given scores start EM passes over the training words and keep a part in them. D comes from the words used once and
    twice. The document's probability is the product along its words and end, in log space. It sums to 1 over all texts of such tokens
    (but for byte sequences that are no text).

    Texts are read once: a task writes them as numbers into the dictionaries of its blocks. Words meet their totals in one shuffle by
    word and go back to their blocks packed, where they meet the numbers. So nothing as large as the vocabulary of the corpus is broadcast or held
    by a task, and blocks are as large as a task's input makes them, whatever the ids.

    Null and empty texts are the end alone. Rows with repeated or null ids are scored one by one. Without words in
    training rows P(w) = Q(w) / 2 and P(end) = 1 / 2. An empty docs gives no rows. Other columns of docs aren't read.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    blocks = blocks_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out")))
    by_word = Window.partitionBy("word")
    pairs = blocks.where("word IS NOT NULL").select("block", "number", "word", "uses")
    pairs = pairs.withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1).withColumn("uses", F.sum("uses").over(by_word))
    pairs = written(pairs, {"compression": "zstd"})
    used = F.when(F.col("first"), F.col("uses"))
    sums = pairs.agg(F.sum(used).alias("words"), *(F.count(F.when(used == n, 1)).alias(name) for n, name in ((1, "once"), (2, "twice"))), F.count(F.when(used > 0, 1)).alias("types")).first()
    ends = blocks.where("numbers IS NOT NULL").agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0]
    totals = Totals(sums.words or 0, sums.types, sums.once, sums.twice, ends or 0)
    model = trained(pairs.where("first AND uses > 0").select("word"), pieces(vocabulary), passes, totals.types)
    return _scored(blocks.where("numbers IS NOT NULL").select("block", "doc_ids", "held_out", "sizes", "numbers"), _looked_up(pairs, model, totals), totals)


def _looked_up(pairs: DataFrame, model: Pieces, totals: Totals) -> DataFrame:
    """The words of each block with their scores, packed by block. Pairs lie by word, so a piece sum serves all blocks of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model)
        for chunk in _in_chunks(batches):
            words = chunk.column("word").combine_chunks().dictionary_encode()
            q = lattice.log_probabilities(words.dictionary.to_pylist())[words.indices.to_numpy()] / np.log(10)
            uses, block, at = (chunk.column(c).to_numpy() for c in ("uses", "block", "number"))
            score, order = totals.word_scores(uses, q), np.argsort(block, kind="stable")
            cuts = np.nonzero(np.diff(block[order], prepend=block[order[0]] - 1))[0]
            parts = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
            for low in range(0, len(parts), 500):
                some = parts[low : low + 500]
                packed = [[x[p].tobytes() for p in some] for x in (at, uses, score)]
                yield pa.RecordBatch.from_arrays([pa.array([int(block[p[0]]) for p in some], pa.int64()), *(pa.array(c, pa.binary()) for c in packed)], names=LOOKED_UP.names)

    return pairs.select("block", "number", "word", "uses").mapInArrow(run, LOOKED_UP)


def _scored(texts: DataFrame, words: DataFrame, totals: Totals) -> DataFrame:
    n, end_known = totals.words + totals.ends, totals.ends > 0

    def run(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        at, uses, score = (np.frombuffer(b"".join(words.column(c).to_pylist()), t) for c, t in zip(LOOKED_UP.names[1:], (np.int32, np.int64, np.float64)))
        by_number = np.argsort(at)
        uses, score = uses[by_number], score[by_number]
        row = {c: texts.column(c)[0].as_py() for c in texts.column_names}
        numbers, sizes = np.frombuffer(row["numbers"], np.int32), np.array(row["sizes"], np.int64)
        starts = np.cumsum(sizes) - sizes

        def sums(of: np.ndarray) -> np.ndarray:
            """Sums of the words' values by document; those of documents without words are 0."""
            out, full = np.zeros(len(sizes)), sizes > 0
            if full.any():
                out[full] = np.add.reduceat(of[numbers], starts[full])
            return out

        known = sums((uses > 0).astype(np.float64)).astype(np.int64) + end_known
        columns = row["doc_ids"], row["held_out"], sizes + 1, known, np.full(len(sizes), n), sums(totals.base(uses)) + float(totals.base(np.array(totals.ends))), sums(score) + totals.end_score
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=SCORED.names)

    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, SCORED)
