"""Ranks and top-k per query with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(hits: DataFrame, order: list[Column] | None = None, by: str = "query_id") -> DataFrame:
    """hits with a dense rank from 1; by default score descending, then chunk id."""
    order = order or [F.col("score").desc(), F.col("chunk_id")]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("int"))


def top_k(hits: DataFrame, k: int, order: list[Column] | None = None, by: str = "query_id") -> DataFrame:
    """The first k hits of each query; the limit is pushed below the shuffle."""
    return ranked(hits, order, by).where(F.col("rank") <= k)


def normalize_scores(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """score scaled to 0..1 per query; all ones where the scores are alike."""
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("normalized", F.when(high - low < 1e-9, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))
