"""Total orders, top-n per group and rank fusion. All functions keep a query column, so that many queries run at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(hits: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """hits with their place from 0 in each group; order must be total."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def top_per(hits: DataFrame, by: list[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The n first of each group, with their place from 0; all but n of a task's rows go before they are shuffled."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return hits.withColumn(name, first).where(F.col(name) <= n).withColumn(name, F.col(name) - 1)


def contribution(rank: Column, k: int = RRF_K) -> Column:
    return 1.0 / (F.lit(k) + rank + 1)


def fuse_hits(lanes: DataFrame, by: list[str], item: str, k: int = RRF_K) -> DataFrame:
    """Every hit counts, also several of one item in a lane."""
    return lanes.groupBy(*by, item).agg(F.sum(contribution(F.col("rank"), k)).alias("score"))


def fuse_first(lanes: DataFrame, by: list[str], item: str, lane: str = "lane", k: int = RRF_K) -> DataFrame:
    """Only the best hit of an item in each lane counts; lanes: how many lanes have it."""
    first = lanes.groupBy(*by, lane, item).agg(F.min("rank").alias("rank"))
    return first.groupBy(*by, item).agg(F.sum(contribution(F.col("rank"), k)).alias("score"), F.count("*").alias("lanes"), F.min("rank").alias("best_rank"))


def mmr(candidates: DataFrame, query: str, item: str, relevance: str, vector: str, n: int, weight: float) -> DataFrame:
    """Greedy maximal marginal relevance over each query's few candidates: query, item, place. weight 1 is relevance order."""
    import numpy as np
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([relevance, item], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(rows[vector].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        like, left, chosen = v @ v.T, list(range(len(rows))), []
        while left and len(chosen) < n:
            value = [weight * rows[relevance][i] - (1 - weight) * (like[i, chosen].max() if chosen else 0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(value))))
        return pd.DataFrame({query: rows[query][chosen].to_numpy(), item: rows[item][chosen].to_numpy(), "place": np.arange(len(chosen), dtype="int64")})

    return candidates.groupBy(query).applyInPandas(pick, f"{query} long, {item} long, place long")
