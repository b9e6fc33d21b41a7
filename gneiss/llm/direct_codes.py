"""Token ids as directly addressable codes: chunk levels with continuation bitmaps and rank directories."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, shared_folder

#: Bits of a chunk; ids in one segment at least (but for the last); bits between entries of the rank directory.
CHUNK, SEGMENT, RANK_EVERY = 8, 500_000, 512
MAGIC = b"GDAC"


def pack(ids: np.ndarray) -> bytes:
    """Ids of up to 32 bits to levels. Level k holds byte k of the ids that have one.

    A level is: count, then a byte for each id that reaches it, then a bit for each that tells whether the id
    goes on, then for every 512 bits the number of set bits before them. All is little-endian.
    """
    out, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest >> CHUNK > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype=np.int64))])[:-1]
        out.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ones.astype("<u4").tobytes())
        rest = rest[more] >> CHUNK
    return MAGIC + struct.pack("<B", len(out)) + b"".join(out)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.levels, at = [], 5
        for _ in range(data[4]):
            n = struct.unpack_from("<Q", data, at)[0]
            low = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at + 8 + n)
            ranks = np.frombuffer(data, "<u4", -(-n // RANK_EVERY), at + 8 + n + len(bits))
            self.levels.append((low, bits, ranks))
            at += 8 + n + len(bits) + ranks.nbytes

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def __getitem__(self, i: int) -> int:
        """Id i, by a rank lookup a level: no other id is decoded."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            before = np.unpackbits(bits[block * RANK_EVERY // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_EVERY]
            i = int(ranks[block]) + int(before.sum())
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(len(self), np.uint32)
        at = np.arange(len(self))
        for k, (low, bits, _) in enumerate(self.levels):
            out[at] |= low.astype(np.uint32) << np.uint32(CHUNK * k)
            at = at[np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)]
        return out


FILE = T.StructType(
    [
        # part: range of doc_ids; start: ids of the part before the segment; total: ids in the segment
        T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("total", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()),
    ]
)


def write_codes(docs: DataFrame, encoder: Callable[[], Callable[[list[bytes]], list[np.ndarray]]], end_id: int, path: str | None = None) -> DataFrame:
    """Encode every text, append end_id, write segments of ids in ascending doc_id order, and read them back.

    encoder() is called once a task and returns a function from UTF-8 texts to id arrays. The
    files are Parquet rows, a segment each, in the shared folder (or at path); a lost executor's
    segments are written again by Spark. Null texts are empty, null ids come first, equal ids stay
    apart in any order; an empty table gives no segment.
    """
    path = path or shared_folder(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, schema = encoder(), pa.schema([("part", pa.int32()), ("start", pa.int64()), ("total", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])
        part, start, held, keys, end = 0, 0, [], [], np.array([end_id], np.uint32)

        def segment() -> pa.RecordBatch:
            ids = np.concatenate([x for pair in held for x in (pair, end)])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, start, len(ids), keys, [len(x) + 1 for x in held], pack(ids)), schema)], schema=schema)

        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                part = some.column("part")[0].as_py()
                for key, ids in zip(some.column("doc_id").to_pylist(), encode(list(raw_texts(some)))):
                    keys.append(key)
                    held.append(ids)
                if (n := sum(map(len, held)) + len(held)) >= SEGMENT:
                    yield segment()
                    start, held, keys = start + n, [], []
        if held:
            yield segment()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, FILE).write.option("parquet.block.size", str(16 << 20)).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(FILE).parquet(path)


def read_codes(segments: DataFrame, digest: Callable[[np.ndarray], int]) -> DataFrame:
    """Per document: doc_id, start (ids before it in the whole file), n_tokens, digest(ids) as a long."""
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("inner", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("digest", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, _, keys, lengths, codes = (batch.column(c)[row].as_py() for c in FILE.names)
                ids, ends = Codes(codes).all(), np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([digest(ids[a:b]) for a, b in zip(begins, ends)], pa.int64())],
                    names=out.names,
                )

    # one row per range of doc_ids: their number is that of the shuffle's partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("total").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return segments.mapInArrow(run, out).join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "digest")


@cache
def word_encoder(tokenizer_file: str, most_cached: int = 800_000) -> Callable[[list[bytes]], list[np.ndarray]]:
    """An encoder for a tokenizer that drops white space and never joins across it.

    Texts are cut at ASCII white space, each distinct piece is encoded by the tokenizers library once (while
    the cache holds it, which a Python worker keeps from task to task), and the pieces' ids are joined: the same ids as of the whole text. If the tokenizer
    lower-cases, A-Z are lower-cased first, which leaves fewer distinct pieces; not so in texts with characters from
    U+0100 on, whose composition may depend on case, or where an added token would appear.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    lowers = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
    added = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
    beyond = re.compile(rb"[\xC4-\xFF]")
    number: dict[str, int] = {}
    # ids of all words one after another, with room to grow, and where each word's begin
    pool, starts = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def plain(text: bytes) -> bytes:
        if not lowers or beyond.search(text):
            return text
        low = text.lower()
        return text if any(t in low for t in added) else low

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        nonlocal pool, starts
        if not texts:
            return []
        split = pc.ascii_split_whitespace(pa.array([plain(t) for t in texts], pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(number) > most_cached:
            number.clear()
            starts = starts[:1]
        if new := [w for w in names if w not in number]:
            ids = [x.ids for x in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            number.update(zip(new, range(len(number), len(number) + len(new))))
            used, flat = int(starts[-1]), np.fromiter(chain.from_iterable(ids), np.uint32)
            starts = np.concatenate([starts, used + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
            if used + len(flat) > len(pool):
                pool = np.concatenate([pool, np.zeros(max(len(pool), len(flat)), np.uint32)])
            pool[used : used + len(flat)] = flat
        at = np.fromiter(map(number.__getitem__, names), np.int64, len(names))[words.indices.to_numpy()]
        n = starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = pool[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        return np.split(flat, ends[np.cumsum(split.value_lengths().to_numpy())[:-1]])

    return encode
