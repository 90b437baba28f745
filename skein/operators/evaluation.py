"""Retrieval metrics, judged-answer scores, error taxonomy and failure buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_gold(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """hits with the first evidence entry that each matches (null: none).

    hits: query_id, rank, doc_id, page, modality; gold: query_id, idx, doc_id, page, modality (null fits any).
    """
    g = gold.select("query_id", "idx", "doc_id", "page", F.col("modality").alias("wanted"))
    joined = hits.join(g, ["query_id", "doc_id", "page"], "left").where("wanted is null or wanted = modality or idx is null")
    found = joined.groupBy("query_id", "rank").agg(F.min("idx").alias("matched"))
    return hits.join(found, ["query_id", "rank"], "left")


def metrics(matched: DataFrame, n_gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query recall, precision, hit rate and nDCG at each k, and the reciprocal rank.

    matched: query_id, rank, matched; n_gold: query_id, n_gold. Queries without hits score 0. A second hit on the same
    entry gains nothing; precision divides by the hits returned up to k.
    """
    first = F.row_number().over(Window.partitionBy("query_id", "matched").orderBy("rank")) == 1
    hits = matched.withColumn("gain", F.when(F.col("matched").isNotNull() & first, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    aggs = [F.coalesce(F.max(F.when(F.col("matched").isNotNull(), 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        top = F.col("rank") <= k
        good = top & F.col("matched").isNotNull()
        aggs += [
            F.countDistinct(F.when(top, F.col("matched"))).alias(f"covered_{k}"), F.count_if(good).alias(f"good_{k}"), F.count_if(top).alias(f"window_{k}"),
            F.sum(F.when(top, F.col("gain")).otherwise(0.0)).alias(f"dcg_{k}"),
        ]
    per = n_gold.join(hits.groupBy("query_id").agg(*aggs), "query_id", "left").fillna(0)
    out = [F.col("query_id"), F.col("n_gold"), F.round(F.coalesce("mrr", F.lit(0.0)), 6).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        out += [
            F.round(F.col(f"covered_{k}") / F.col("n_gold"), 6).alias(f"recall_{k}"),
            F.when(F.col(f"window_{k}") > 0, F.round(F.col(f"good_{k}") / F.col(f"window_{k}"), 6)).otherwise(0.0).alias(f"precision_{k}"),
            F.when(F.col(f"good_{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"), F.round(F.col(f"dcg_{k}") / ideal, 6).alias(f"ndcg_{k}"),
        ]
    return per.select(*out)


def macro_average(per_query: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over queries; a missing metric counts as 0. by: one total row and one per value of each column."""
    aggs = [F.count("*").alias("n"), *(F.round(F.avg(F.coalesce(F.col(n), F.lit(0.0))), 6).alias(n) for n in names)]
    if not by:
        return per_query.agg(*aggs)
    return per_query.groupingSets([[], *([F.col(b)] for b in by)], *(F.col(b) for b in by)).agg(*aggs)


def correctness(refused: Column, n_facts: Column, contradicts: Column, covered: Column) -> Column:
    return F.when(refused, "refused").when(n_facts == 0, "not_assessable").when(contradicts, "incorrect").when(covered == n_facts, "correct").when(covered > 0, "partial").otherwise("incorrect")


def judged_scores(records: DataFrame) -> DataFrame:
    """Scores of judged answers, added to the records.

    records: claims array<struct<supported, cited, citation_supports>>, n_facts, n_covered, refused, declines,
    contradicts, unresolved_citations, n_citations, answerable.
    """
    n = F.size("claims")
    supported = F.size(F.filter("claims", lambda c: c["supported"]))
    cited = F.size(F.filter("claims", lambda c: c["cited"]))
    backed = F.size(F.filter("claims", lambda c: c["cited"] & F.coalesce(c["citation_supports"], F.lit(False))))
    refused = F.coalesce("refused", F.lit(False)) | F.coalesce("declines", F.lit(False))
    out = records.withColumns({"n_claims": n, "n_supported": supported, "n_cited": cited, "n_backed": backed, "refused_any": refused})
    label = correctness(F.col("refused_any"), F.col("n_facts"), F.col("contradicts"), F.col("n_covered"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6))

    return out.withColumns({
        "faithfulness": share(F.col("n_supported"), F.col("n_claims")), "has_unsupported": F.col("n_supported") < F.col("n_claims"), "uncited_rate": share(F.col("n_claims") - F.col("n_cited"), F.col("n_claims")),
        "citation_support": share(F.col("n_backed"), F.col("n_cited")), "completeness": share(F.col("n_covered"), F.col("n_facts")), "correctness": label,
        "correctness_score": F.when(label == "correct", 1.0).when(label == "partial", 0.5).when(label == "incorrect", 0.0), "refusal_without_marker": F.coalesce("declines", F.lit(False)) & ~F.coalesce("refused", F.lit(False)),
        "grounded_correct": F.when(F.col("answerable"), (label == "correct") & (F.col("n_supported") >= F.col("n_claims"))),
        "citation_problem": (F.col("unresolved_citations") > 0) | ((F.col("n_claims") > 0) & (F.col("n_citations") == 0)) | (F.col("n_backed") < F.col("n_cited")),
    })


def error_category(r: dict[str, Column]) -> Column:
    """One category per judged record. r: failed, answerable, refused, mixed_refusal, has_unsupported, correctness,
    citation_problem, in_context, retrieved, gold_page_cited."""
    truncated = r["retrieved"] & ~r["in_context"]
    answerable = (
        F.when(r["refused"] & r["in_context"], "over_refusal")
        .when(r["refused"] & truncated, "context_truncated")
        .when(r["refused"], "retrieval_miss_refused")
        .when((r["correctness"] == "correct") & r["has_unsupported"], "ungrounded_correct")
        .when((r["correctness"] == "correct") & r["citation_problem"], "citation_error")
        .when((r["correctness"] == "correct") & (~r["in_context"] | ~F.coalesce(r["gold_page_cited"], F.lit(True))), "correct_non_gold_page")
        .when(r["correctness"] == "correct", "fully_correct")
        .when(truncated, "context_truncated")
        .when(~r["in_context"] & r["has_unsupported"], "hallucinated_answer")
        .when(~r["in_context"], "retrieval_miss_answered")
        .otherwise("wrong_or_incomplete")
    )
    unanswerable = F.when(r["refused"] & ~r["mixed_refusal"], "correct_refusal").when(r["has_unsupported"], "hallucinated_answer").otherwise("answered_unanswerable")
    return F.when(r["failed"], "error").when(~r["answerable"], unanswerable).otherwise(answerable)


def failure_bucket(failed: Column, answerable: Column, category: Column, retrieved: Column, in_context: Column, grounded: Column, citation_problem: Column) -> Column:
    return (
        F.when(failed, "error")
        .when(~answerable, F.when(category == "correct_refusal", "correct_refusal").otherwise("answered"))
        .when(~retrieved, "retrieval_failure")
        .when(~in_context, "context_failure")
        .when(~F.coalesce(grounded, F.lit(False)), "generation_failure")
        .when(citation_problem, "citation_failure")
        .otherwise("success")
    )


def fact_coverage(facts: DataFrame, haystack: Column, tokens: Column) -> DataFrame:
    """facts with checkable (it has key tokens) and found (all of them occur in the text)."""
    return facts.withColumn("checkable", F.size(tokens) > 0).withColumn("found", (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(haystack, t)))


def gold_problems(gold: DataFrame, documents: DataFrame, pages: DataFrame, modalities: DataFrame) -> DataFrame:
    """Evidence that no chunk can match: unknown_document, no_such_page, no_such_modality."""
    marked = (
        gold.join(documents.select("doc_id").distinct().withColumn("has_doc", F.lit(True)), "doc_id", "left")
        .join(pages.select("doc_id", "page").distinct().withColumn("has_page", F.lit(True)), ["doc_id", "page"], "left")
        .join(modalities.select("doc_id", "page", "modality").distinct().withColumn("has_modality", F.lit(True)), ["doc_id", "page", "modality"], "left")
    )
    problem = F.when(F.col("has_doc").isNull(), "unknown_document").when(F.col("has_page").isNull(), "no_such_page").when(F.col("modality").isNotNull() & F.col("has_modality").isNull(), "no_such_modality")
    return marked.withColumn("problem", problem).where("problem is not null").drop("has_doc", "has_page", "has_modality")


def disagreements(runs: DataFrame, metric: str, limit: int) -> DataFrame:
    """Queries on which runs differ most; a missing value counts as 0. runs: run, query_id, metric."""
    names = runs.select("run").distinct().groupBy().agg(F.count("*").alias("n_runs"))
    spread = runs.groupBy("query_id").agg(F.max(metric).alias("best"), F.min(metric).alias("least"), F.count("*").alias("n")).crossJoin(F.broadcast(names))
    worst = F.when(F.col("n") < F.col("n_runs"), F.least("least", F.lit(0.0))).otherwise(F.col("least"))
    return spread.select("query_id", F.round(F.col("best") - worst, 6).alias("spread")).orderBy(F.col("spread").desc(), "query_id").limit(limit)
