"""Reciprocal-rank fusion, its diagnostics, two-stage fusion by modality and the balanced pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ranking import ranked, top_k

K = 60


def rrf(hits: DataFrame, method: str = "sum", k: int = K, top: int | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """keys, chunk_id, score, rank, component_ranks from hits(keys, retriever, chunk_id, rank[, weight]).

    A list's best rank of a chunk counts; lists of weight 0 take no part. sum: contributions added in list order; max:
    the best one, lists in agreement breaking ties. Then best rank, then chunk id. Scores are compared at twelve digits,
    so that equal sums of different parts (0.7/63 + 1/72, 0.7/68 + 1/68) tie.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    if method not in ("sum", "max"):
        raise ValueError("method is sum or max")
    if "weight" not in hits.columns:
        hits = hits.withColumn("weight", F.lit(1.0))
    lists = hits.where("weight <> 0").groupBy(*keys, "retriever", "chunk_id").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    parts = lists.withColumn("part", F.col("weight") / (F.lit(float(k)) + F.col("rank")))
    ordered = F.array_sort(F.collect_list(F.struct("retriever", "part", "rank")))
    fused = parts.groupBy(*keys, "chunk_id").agg(ordered.alias("lists"), F.min("rank").alias("best_rank"), F.max("part").alias("top_part"))
    total = F.aggregate("lists", F.lit(0.0), lambda s, x: s + x["part"])
    fused = fused.withColumn("score", total if method == "sum" else F.col("top_part")).withColumn("n_lists", F.size("lists"))
    order = [F.round("score", 12).desc(), *([F.col("n_lists").desc()] if method == "max" else []), F.col("best_rank"), F.col("chunk_id")]
    w = Window.partitionBy(*keys).orderBy(*order)
    out = fused.withColumn("rank", F.row_number().over(w).cast("int"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    ranks = F.map_from_entries(F.transform("lists", lambda x: F.struct(x["retriever"], x["rank"])))
    return out.select(*keys, "chunk_id", "score", "rank", ranks.alias("component_ranks"))


def diagnostics(fused: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, retriever, candidates, contributed, found_only_by, found_by_all."""
    n_lists = hits.groupBy("query_id").agg(F.countDistinct("retriever").alias("n_lists"))
    listed = fused.select("query_id", F.explode("component_ranks").alias("retriever", "list_rank"), F.size("component_ranks").alias("n")).join(n_lists, "query_id")
    found = listed.groupBy("query_id", "retriever").agg(F.count("*").alias("contributed"), F.count_if(F.col("n") == 1).alias("found_only_by"), F.count_if(F.col("n") == F.col("n_lists")).alias("found_by_all"))
    candidates = hits.groupBy("query_id", "retriever").agg(F.count("*").alias("candidates"))
    return candidates.join(found, ["query_id", "retriever"], "left").fillna(0)


def modality_weights(retrievers: DataFrame, explicit: dict[str, float] | None = None) -> DataFrame:
    """modality, weight: an explicit one wins, else the largest of its retrievers' (missing: 1). retrievers: retriever, modality, weight."""
    best = retrievers.groupBy("modality").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    chosen = F.col("weight")
    for name, value in (explicit or {}).items():
        chosen = F.when(F.col("modality") == name, F.lit(float(value))).otherwise(chosen)
    return best.select("modality", chosen.alias("weight"))


def two_stage(hits: DataFrame, weights: DataFrame | None = None, k: int = K, top: int | None = None) -> DataFrame:
    """Fuse within each modality (sum, unweighted), then across modalities with their weights. hits also has modality."""
    within = rrf(hits.drop("weight"), keys=("query_id", "modality"), k=k)
    across = within.select("query_id", F.col("modality").alias("retriever"), "chunk_id", "rank")
    if weights is not None:
        across = across.join(F.broadcast(weights.select(F.col("modality").alias("retriever"), "weight")), "retriever", "left").fillna(1.0, ["weight"])
    return rrf(across, k=k, top=top)


def balanced_pool(fused: DataFrame, by_modality: DataFrame, modalities: list[str], floor: int, limit: int) -> DataFrame:
    """query_id, chunk_id, rank: every modality in turn takes up to `floor` chunks of its own list that no other has
    taken, the fused order fills up to `limit`, and the fused order is restored. floor 0: the fused prefix."""
    order = fused.select("query_id", "chunk_id", F.col("rank").alias("fused_rank"))
    picked = order.limit(0).select("query_id", "chunk_id").withColumn("taken", F.lit(0))
    for n, name in enumerate(modalities if floor > 0 else []):
        own = by_modality.where(F.col("modality") == name).join(order, ["query_id", "chunk_id"], "left_semi").join(picked, ["query_id", "chunk_id"], "left_anti")
        room = picked.groupBy("query_id").agg(F.count("*").alias("used"))
        take = top_k(own.select("query_id", "chunk_id", F.col("rank").alias("own_rank")), floor, [F.col("own_rank"), F.col("chunk_id")])
        take = take.join(room, "query_id", "left").where(F.col("rank") + F.coalesce("used", F.lit(0)) <= limit)
        picked = picked.unionByName(take.select("query_id", "chunk_id", F.lit(n).alias("taken")))
    marked = order.join(picked, ["query_id", "chunk_id"], "left")
    chosen = top_k(marked, limit, [F.col("taken").isNull(), F.col("fused_rank"), F.col("chunk_id")])
    return ranked(chosen.drop("rank"), [F.col("fused_rank"), F.col("chunk_id")]).select("query_id", "chunk_id", "rank")


def rerank(pool: DataFrame, scores: DataFrame, rerank_top_n: int = 25, top: int = 10) -> DataFrame:
    """The first rerank_top_n of each pool by a scorer's score, fused rank breaking ties; component_ranks keeps 'fused'.

    scores: query_id, chunk_id, rerank_score, from any model.
    """
    return reranked(pool.join(scores, ["query_id", "chunk_id"]), rerank_top_n, top)


def reranked(scored: DataFrame, rerank_top_n: int = 25, top: int = 10) -> DataFrame:
    """rerank() of a pool that has its rerank_score already."""
    head = scored.where(F.col("rank") <= rerank_top_n).withColumnRenamed("rank", "fused_rank")
    out = top_k(head, top, [F.col("rerank_score").desc(), F.col("fused_rank")])
    before = F.col("component_ranks") if "component_ranks" in scored.columns else F.create_map().cast("map<string,int>")
    return out.select("query_id", "chunk_id", F.col("rerank_score").alias("score"), "rank", "fused_rank", F.map_concat(before, F.create_map(F.lit("fused"), F.col("fused_rank"))).alias("component_ranks"))
