"""A corpus from raw documents to packed batches: each stage calls one operator and its decisions take effect.

Every stage returns a DataFrame that is written as Parquet and read again as the next stage's docs. All
but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import folded, table, unfolded, written
from gneiss.llm.components import numbered, sized
from gneiss.llm.line_chunks import remove_repeated_chunks
from gneiss.llm.packing import pack, word_count
from gneiss.llm.phrase_index import benchmark_hits
from gneiss.llm.quality import score_quality
from gneiss.llm.queries_python import THRESHOLD, trusted
from gneiss.llm.similarity import similar_components
from gneiss.storage import shared_folder


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs folded to doc_id, text, rest with an own number `row` for each row, and the same as doc_id (that number) and text."""
    rows = numbered(folded(docs, "doc_id", "text"))
    return rows, rows.select(F.col("row").alias("doc_id"), "text")


def _without(rows: DataFrame, rejected: DataFrame, columns: list[str]) -> DataFrame:
    """Numbered rows without those whose numbers are the doc_ids of `rejected`, with their old columns."""
    gone = sized(written(rejected.select(F.col("doc_id").alias("row"))))
    return unfolded(rows.join(gone, "row", "left_anti"), columns, {"doc_id": F.col("doc_id"), "text": F.col("text")})


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    rows, texts = _numbered(docs)
    positives = rows.select("doc_id", "row").join(trusted(spark, sf_dir), "doc_id", "left_semi").select(F.col("row").alias("doc_id"))
    return _without(rows, score_quality(texts, positives).where(F.col("score") < THRESHOLD), docs.columns)


def unique_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go from all but their first document; n_chars follows the text. A document that had only such chunks goes. A column chunks_removed of docs is not kept."""
    cleaned = remove_repeated_chunks(docs).where((F.col("chunks_removed") == 0) | F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("chunks_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.drop("chunks_removed")


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row with the smallest doc_id stays; a null doc_id is the largest."""
    rows, texts = _numbered(docs)
    of = written(similar_components(texts).select(F.col("doc_id").alias("row"), "component_id"))
    shared = of.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = written(of.join(sized(written(shared)), "component_id", "left_semi").join(rows.select("doc_id", "row"), "row"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")).select("row")
    return _without(rows, members.join(first, "row", "left_anti").select(F.col("row").alias("doc_id")), docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, texts = _numbered(docs)
    return _without(rows, benchmark_hits(texts, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and each document's length bucket, batch and place in it."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", unique_chunks),
    ("similar", one_of_similar),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

#: SQL can't express the classifier; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_folder(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
