"""Vectors of texts, addressed by the text's hash and the model's contract: each distinct text is encoded once, whatever asks for it."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gneiss.operators.nearest import DIMS, hashed
from gneiss.operators.store import Store, upsert
from gneiss.storage import forget, written

#: What the hashed vectors are; another contract is another table.
CONTRACT = f"hashed-three-letter-pieces-{DIMS}-v1"
#: Rows that are encoded or unpacked at once.
ROWS = 1000


def hashed_all(texts: list[str]) -> np.ndarray:
    return np.array([hashed(t) for t in texts], "<f4").reshape(len(texts), DIMS)


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each row of 32-bit floats with the first bytes of its floats side by side, then the second ones and so on, compressed: counts take an eighth of their bytes."""
    planes = np.ascontiguousarray(vectors.astype("<f4").view(np.uint8).reshape(len(vectors), -1, 4).transpose(0, 2, 1))
    return [zlib.compress(p.tobytes(), 1) for p in planes]


def unpacked(rows: list[bytes]) -> list[bytes]:
    return [np.ascontiguousarray(np.frombuffer(zlib.decompress(r), np.uint8).reshape(4, -1).T).tobytes() for r in rows]


def with_vectors(texts: DataFrame, store: Store, contract: str = CONTRACT, encode: Callable[[list[str]], np.ndarray] = hashed_all, keep: list[str] | None = None) -> DataFrame:
    """texts (text, ...), or only their columns `keep`, with `vector`, little-endian 32-bit floats.

    Distinct texts that the store lacks are encoded once, in one pass, and committed; a second run with the same texts encodes none. A text hot in many
    rows is one row of the store, and rows meet their vectors by hash. A null text counts as empty. The store keeps vectors packed and they are shuffled so.
    """
    name = "packed-" + hashlib.sha256(contract.encode()).hexdigest()[:16]
    keyed = texts.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    missing = keyed.select("text_hash", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_hash"])
    if name in store.manifest()["tables"]:
        missing = missing.join(store.read(name).select("text_hash"), "text_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array(packed(encode(batch.column("text").to_pylist())), pa.binary())], names=["text_hash", "packed"])

    made = written(missing.mapInArrow(run, "text_hash string, packed binary"))
    new = made.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("text_hash")).alias("x")).first()
    if new.n or name not in store.manifest()["tables"]:
        store.commit(f"{name}:{new.n}:{new.x}", {name: upsert(made, "text_hash")}, {"contract": contract, "texts": new.n})
    forget(made)
    kept = keep or texts.columns
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField("vector", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(unpacked(batch.column("packed").to_pylist()), pa.binary())], schema=arrow)

    return keyed.select(*kept, "text_hash").join(store.read(name), "text_hash").select(*kept, "packed").mapInArrow(vectors, schema)


def stored_vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of rows that have them."""
    return np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<f4").reshape(batch.num_rows, -1).astype(float)
