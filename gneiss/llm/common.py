"""What the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.session import table
from gneiss.storage import forget, shared_folder, written

__all__ = ["folded", "forget", "id_fold", "raw_texts", "shared_folder", "table", "total_bytes", "unfolded", "written"]


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return (x.as_py() or b"" for x in batch.column(name).cast(pa.binary()))


def total_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one number, whatever the size of docs."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def folded(docs: DataFrame, *own: str) -> DataFrame:
    """docs as its columns `own` and one struct `rest` of all others, so that no name of theirs can clash or need quotes."""
    others = [docs[_quoted(c)] for c in docs.columns if c not in own]
    return docs.select(*(docs[_quoted(c)].alias(c) for c in own), (F.struct(*others) if others else F.lit(None).cast("boolean")).alias("rest"))


def unfolded(df: DataFrame, columns: list[str], values: dict[str, Column], more: dict[str, Column] | None = None) -> DataFrame:
    """The columns of a folded table in their old order, `values` in place of some, and `more` behind them."""
    return df.select(*((values[c] if c in values else F.col("rest").getField(c)).alias(c) for c in columns), *(v.alias(k) for k, v in (more or {}).items()))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
