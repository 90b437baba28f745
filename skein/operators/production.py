"""Latency, cost, reliability and load reporting over recorded requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_SAMPLE = 100


def linear(value: str, fraction: float) -> Column:
    """Percentile with linear interpolation, exact."""
    return F.expr(f"percentile(`{value}`, {fraction})")


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, p50, p95, p99, max per group; small_sample marks tails that rest on few values."""
    return df.where(f"`{value}` is not null").groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), *(F.round(linear(value, p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)), F.round(F.max(value), 6).alias("max"),
        (F.count("*") < SMALL_SAMPLE).alias("small_sample"),
    )


def rate(flag: Column, name: str) -> list[Column]:
    """count, denominator and share of a flag, nulls left out."""
    return [F.count_if(flag).alias(f"{name}_count"), F.count(flag).alias(f"{name}_of"), F.when(F.count(flag) > 0, F.round(F.count_if(flag) / F.count(flag), 4)).alias(f"{name}_rate")]


def canonical_stages(latency: Column, tolerance: float = 1.0) -> Column:
    """struct of a query's latency map: retrieval, fusion, reranking, retrieval_total, total_consistent."""
    known = F.array(*map(F.lit, ("fusion_ms", "rerank_ms", "total_ms", "model_load_ms")))
    own = F.map_values(F.map_filter(latency, lambda k, _: k.endswith("_ms") & ~F.array_contains(known, k)))
    retrieval = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    fusion = F.coalesce(F.try_element_at(latency, F.lit("fusion_ms")), F.lit(0.0))
    rerank = F.try_element_at(latency, F.lit("rerank_ms"))
    parts = retrieval + fusion + F.coalesce(rerank, F.lit(0.0))
    total = F.coalesce(F.try_element_at(latency, F.lit("total_ms")), parts)
    return F.struct(retrieval.alias("retrieval"), fusion.alias("fusion"), rerank.alias("reranking"), total.alias("retrieval_total"), (F.abs(total - parts) <= tolerance).alias("total_consistent"))


def end_to_end(*components: Column) -> Column:
    """Sum of stage times; null if one is missing."""
    total = components[0]
    for c in components[1:]:
        total = total + c
    return total


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with cost in dollars, by model name or alias; unknown models cost null.

    usage: model, prompt_tokens, completion_tokens; prices: model, aliases, input_per_million, output_per_million. The
    price list is a handful of rows.
    """
    names = prices.select(F.explode(F.array_distinct(F.concat(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("model"), "input_per_million", "output_per_million")
    cost = (F.col("prompt_tokens") * F.col("input_per_million") + F.col("completion_tokens") * F.col("output_per_million")) / 1e6
    return usage.join(F.broadcast(names), "model", "left").withColumn("cost", cost).drop("input_per_million", "output_per_million")


def reliability(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Error, retry and timeout rates over attempted calls. records: status, attempts, error_kind."""
    tried = records.where(F.col("status").isin("ok", "error"))
    return tried.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), *rate(F.col("status") == "error", "error"), *rate(F.col("attempts") > 1, "retry"), *rate((F.col("status") == "error") & (F.col("error_kind") == "timeout"), "timeout")
    )


def load_levels(requests: DataFrame) -> DataFrame:
    """Per concurrency level: requests, throughput of good ones, queue wait, latency. requests: level, submitted, started, finished (seconds), ok."""
    wall = F.max("finished") - F.min("submitted")
    timed = requests.withColumn("wait", F.col("started") - F.col("submitted")).withColumn("latency", F.col("finished") - F.col("started"))
    return timed.groupBy("level").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.round(wall, 6).alias("wall"), F.when(wall > 0, F.round(F.count_if("ok") / wall, 6)).alias("throughput"),
        F.round(F.avg("wait"), 6).alias("mean_wait"), F.round(linear("latency", 0.5), 6).alias("p50"), F.round(linear("latency", 0.95), 6).alias("p95"),
    )
