"""Recorded runs: their tables, the work they select, how they are joined, aggregated, compared and reported.

A run is rows of one kind (retrieval, generation, judged, production, load) under a run id. Everything here is a plan over
such tables; nothing calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.classify import error_kind
from skein.operators.production import canonical_stages, distribution, rate, token_cost

VERSION = 1
KINDS = ("retrieval", "generation", "judged", "production", "load")
#: Differences below this are none.
EQUAL = 5e-4


# ---- artefacts


def save_run(df: DataFrame, path: str, kind: str, run_id: str) -> None:
    """Replaces one run of a run table; other runs of the kind stay."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of run: {kind}")
    out = df.withColumns({"kind": F.lit(kind), "run_id": F.lit(run_id), "schema_version": F.lit(VERSION)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "run_id").parquet(path)


def load_run(spark: SparkSession, path: str, kind: str, run_id: str | None = None) -> DataFrame:
    """A run (or all of a kind), of this schema version only."""
    own = spark.read.parquet(path).where(F.col("kind") == kind)
    own = own if run_id is None else own.where(F.col("run_id") == run_id)
    if own.where(F.col("schema_version") != VERSION).head(1):
        raise ValueError(f"{path} holds another version than {VERSION}")
    if not own.head(1):
        raise ValueError(f"no {kind} run {run_id or ''} in {path}")
    return own.drop("kind", "schema_version")


def run_kind(kind: Column) -> Column:
    """A run's kind; artefacts from before there were kinds are retrieval runs."""
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("retrieval"))


def to_markdown(df: DataFrame) -> str:
    """A report table as Markdown, floats at four digits. For tables of a report's size: rows come to the driver."""
    lines = [df.columns, ["---"] * len(df.columns)]
    lines += [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r] for r in df.toLocalIterator()]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


# ---- selecting and joining work


def gold_counts(queries: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Queries, their evidence entries and documents, in all and by each of some columns."""
    per = evidence.groupBy("query_id").agg(F.count("*").alias("entries"))
    sets = queries.join(per, "query_id", "left").groupingSets([[], *([F.col(b)] for b in by)], *(F.col(b) for b in by))
    return sets.agg(F.count("*").alias("queries"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.count_if(F.col("entries").isNull()).alias("without_evidence"))


def generation_gold_problems(facts: DataFrame, gold: DataFrame, unanswerable: DataFrame) -> DataFrame:
    """query_id, problem: missing_facts (gold without facts), unknown_query (facts without gold), id_collision (answerable and unanswerable)."""
    f, g, u = (t.select("query_id").distinct() for t in (facts, gold, unanswerable))
    parts = [(g.join(f, "query_id", "left_anti"), "missing_facts"), (f.join(g, "query_id", "left_anti"), "unknown_query"), (u.join(g, "query_id", "left_semi"), "id_collision")]
    out = [t.withColumn("problem", F.lit(name)) for t, name in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def select_work(gold: DataFrame, unanswerable: DataFrame, include_unanswerable: bool = True, query_ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """query_id, answerable, position: answerable queries in gold order, then unanswerable ones; a list of ids narrows both, then the limit cuts.

    gold, unanswerable: query_id, position. Ids that nobody has are refused.
    """
    both = gold.select("query_id", F.lit(True).alias("answerable"), "position")
    if include_unanswerable or query_ids:
        both = both.unionByName(unanswerable.select("query_id", F.lit(False).alias("answerable"), "position"))
    if query_ids:
        known = {r.query_id for r in both.where(F.col("query_id").isin(query_ids)).select("query_id").distinct().collect()}
        if lost := [q for q in dict.fromkeys(query_ids) if q not in known]:
            raise ValueError(f"unknown query ids: {lost}")
        both = both.where(F.col("query_id").isin(query_ids))
    ordered = both.orderBy(F.col("answerable").desc(), "position")
    return ordered if limit is None else ordered.limit(limit)


def workload(gold: DataFrame, n: int) -> DataFrame:
    """The first n answerable queries in gold order."""
    return gold.orderBy("position").limit(n)


def rebuild_retrieved(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved hits with their chunks; a hit without one means another corpus, and the run is refused."""
    lost = retrieved.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    if row := lost.head(1):
        raise ValueError(f"the chunks lack {row[0].chunk_id}, which the run retrieved")
    return retrieved.join(chunks, "chunk_id")


def contains_gold_evidence(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, found: whether any hit is on a gold page of the modality wanted. Every gold query has a row."""
    from skein.operators.evaluation import match_gold

    got = match_gold(hits, gold).groupBy("query_id").agg(F.max(F.col("matched").isNotNull()).alias("found"))
    return gold.select("query_id").distinct().join(got, "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("found"))


def replay(requests: DataFrame, records: DataFrame) -> DataFrame:
    """requests with the recorded answer of the same prompt, else of the same query; match: prompt_sha, query_id_fallback or null.

    requests: query_id, prompt_sha256; records: query_id, prompt_sha256, status, answer. Of records that repeat the last by query_id counts.
    """
    usable = records.where("status = 'ok' and answer is not null")
    by_sha = usable.where("prompt_sha256 is not null").groupBy("prompt_sha256").agg(F.max_by("answer", "query_id").alias("sha_answer"))
    by_query = usable.groupBy("query_id").agg(F.max("answer").alias("query_answer"))
    both = requests.join(by_sha, "prompt_sha256", "left").join(by_query, "query_id", "left")
    match = F.when(F.col("sha_answer").isNotNull(), "prompt_sha").when(F.col("query_answer").isNotNull(), "query_id_fallback")
    return both.select(*requests.columns, F.coalesce("sha_answer", "query_answer").alias("answer"), match.alias("match"))


def gates(runs: dict[str, DataFrame]) -> DataFrame:
    """artefact, n_fingerprints: inputs that the artefacts of one report don't agree on. Each run: artefact, sha256."""
    out = None
    for name, df in runs.items():
        own = df.select("artefact", "sha256", F.lit(name).alias("run"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("artefact").agg(F.count_distinct("sha256").alias("n_fingerprints")).where("n_fingerprints > 1")


# ---- aggregates


def among(where: Column, flag: Column) -> Column:
    """A flag of some rows; null, and so not counted, for the others."""
    return F.when(where, flag)


def mean_of(value: Column, name: str) -> list[Column]:
    """Mean at four digits and how many values it rests on, nulls left out."""
    return [F.round(F.avg(value), 4).alias(f"{name}_mean"), F.count(value).alias(f"{name}_n")]


def nearest_ranks(df: DataFrame, value: str, by: list[str], fractions: dict[str, float]) -> DataFrame:
    """by, and for each name sorted[min(floor(n * fraction), n - 1)] of the non-null values.

    Values are counted before they are ranked, so a group is never one row; without `by` there is one row.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("held"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = own.withColumn("upto", F.sum("held").over(w.orderBy(value))).withColumn("whole", F.sum("held").over(w))
    picked = []
    for name, fraction in fractions.items():
        place = F.least(F.floor(F.col("whole") * F.lit(fraction)), F.col("whole") - 1)
        picked.append(F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("held")), F.col(value))).alias(name))
    return ranked.groupBy(*by).agg(*picked)


def generation_aggregate(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Deterministic metrics of generation records, a count and a denominator beside every rate; a row in all, or for each value of `by`.

    records: status, answerable, evidence_retrieved, evidence_in_context, refused, mixed_refusal, n_citations,
    n_unresolved, gold_page_cited, facts_found, facts_checkable, n_sources, answer_chars, latency_ms, cache_hit.
    """
    by = by or []
    ok = F.col("status") == "ok"
    can = ok & F.col("answerable")
    cannot, said = ok & ~F.col("answerable"), can & ~F.col("refused")
    found, checkable = (F.coalesce(F.sum(among(can, F.col(c))), F.lit(0)) for c in ("facts_found", "facts_checkable"))
    out = records.groupBy(*by).agg(
        F.count("*").alias("n_records"), F.count_if(ok).alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_errors"), F.count_if(can).alias("n_answerable"), F.count_if(cannot).alias("n_unanswerable"),
        *rate(among(can, F.col("evidence_retrieved")), "evidence_retrieved"), *rate(among(can, F.col("evidence_in_context")), "evidence_in_context"),
        *rate(among(can, F.col("evidence_retrieved") & ~F.col("evidence_in_context")), "lost_to_budget"), *rate(among(can, F.col("refused")), "refused"), *rate(among(can, F.col("mixed_refusal")), "mixed_refusal"),
        *rate(among(said, F.col("n_citations") > 0), "citation_presence"), *rate(among(said, F.col("n_unresolved") > 0), "unresolved_citation"), *rate(among(said, F.col("gold_page_cited")), "gold_page_cited"),
        *rate(among(cannot, F.col("refused")), "unanswerable_refused"), found.alias("facts_found"), checkable.alias("facts_checkable"), F.when(checkable > 0, F.round(found / checkable, 4)).alias("facts_rate"),
        *mean_of(F.col("n_sources"), "sources_per_prompt"), *mean_of(among(said, F.col("answer_chars")), "answer_chars"), F.count(among(ok & ~F.col("cache_hit"), F.col("latency_ms"))).alias("n_uncached"),
    )
    timed = nearest_ranks(records.where(ok & ~F.col("cache_hit")), "latency_ms", by, {"latency_median": 0.5, "latency_p90": 0.9})
    return out.join(timed, by, "left") if by else out.crossJoin(F.broadcast(timed))


def estimate(records: DataFrame, price_in: float | None = None, price_out: float | None = None, answer_tokens: int = 250, judge_overhead: int = 900, judge_tokens: int = 700) -> DataFrame:
    """stage (generation, judge, total), calls, input_tokens, output_tokens, cost_usd of generating and judging the records; answers in the cache cost no generation."""
    new = ~F.col("cache_hit")
    row = records.agg(
        F.count_if(new).alias("calls"), F.coalesce(F.sum(F.when(new, F.col("prompt_tokens"))), F.lit(0)).alias("gen_in"), F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("prompt_tokens") + answer_tokens + judge_overhead), F.lit(0)).alias("judge_in"),
    )
    gen = F.struct(F.lit("generation").alias("stage"), F.col("calls").alias("calls"), F.col("gen_in").alias("input_tokens"), (F.col("calls") * answer_tokens).alias("output_tokens"))
    judge = F.struct(F.lit("judge").alias("stage"), F.col("n").alias("calls"), F.col("judge_in").alias("input_tokens"), (F.col("n") * judge_tokens).alias("output_tokens"))
    both = F.struct(F.lit("total").alias("stage"), (F.col("calls") + F.col("n")).alias("calls"), (F.col("gen_in") + F.col("judge_in")).alias("input_tokens"), (F.col("calls") * answer_tokens + F.col("n") * judge_tokens).alias("output_tokens"))
    out = row.select(F.explode(F.array(gen, judge, both)).alias("s")).select("s.*")
    cost = F.lit(None).cast("double") if price_in is None or price_out is None else F.round(F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out, 4)
    return out.withColumn("cost_usd", cost)


def live_call_gate(estimated: DataFrame, confirmed: bool, budget_usd: float) -> float:
    """The projected cost of a live run, or an error: it must be confirmed, priced and within the budget."""
    cost = estimated.where("stage = 'total'").first().cost_usd
    if not confirmed:
        raise PermissionError("live calls need confirmation")
    if cost is None or cost > budget_usd:
        raise PermissionError(f"live calls would cost {cost} of {budget_usd}")
    return cost


def judged_aggregate(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How far retrieval and generation each carry the result; a row in all, or for each value of `by`.

    R: evidence in context; G: grounded and correct given it; E2E: grounded and correct; leak: the same without evidence.
    records: judged_scores() with judged, judge_status, status, repaired, evidence_in_context, context_sufficient.
    """
    can = F.col("answerable")
    scored = can & F.col("judged")
    said = scored & ~F.col("refused_any")
    inside, other = scored & F.col("evidence_in_context"), ~can & F.col("judged")
    enough = F.col("context_sufficient")
    aggs = [
        F.count_if(can).alias("n_answerable"), F.count_if(scored).alias("n_judged"), F.count_if(~can).alias("n_unanswerable"), F.count_if(F.col("judge_status") == "error").alias("judge_errors"),
        F.count_if(F.col("status") != "ok").alias("generation_errors"), F.count_if(F.col("repaired")).alias("repaired"),
        *rate(among(scored, F.col("evidence_in_context")), "r"), *rate(among(inside, F.col("grounded_correct")), "g"), *rate(among(scored, F.col("grounded_correct")), "e2e"),
        *rate(among(scored & ~F.col("evidence_in_context"), F.col("grounded_correct")), "leak"), *mean_of(among(scored, F.col("correctness_score")), "correctness"), *mean_of(among(scored, F.col("completeness")), "completeness"),
        *mean_of(among(said, F.col("faithfulness")), "faithfulness"), *rate(among(said, F.col("has_unsupported")), "hallucination"), *mean_of(among(said, F.col("citation_support")), "citation_support"),
        *rate(among(scored, enough), "context_sufficient"), *rate(among(scored, F.col("evidence_in_context") == enough), "proxy_agrees"), *rate(among(other, F.col("refused_any")), "unanswerable_refused"),
        *rate(among(other & ~F.col("refused_any"), F.col("has_unsupported")), "unanswerable_hallucination"),
    ]
    for name in ("correct", "partial", "incorrect", "refused"):
        aggs.append(F.count_if(scored & (F.col("correctness") == name)).alias(f"n_{name}"))
    for a, rich in (("sufficient", enough), ("insufficient", ~enough)):
        for b, gone in (("answered", ~F.col("refused_any")), ("refused", F.col("refused_any"))):
            aggs.append(F.count_if(scored & rich & gone).alias(f"{a}_{b}"))
    return records.groupBy(*(by or [])).agg(*aggs)


def production_records(generation: DataFrame, retrieval: DataFrame, prices: DataFrame, timings: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """One row per generated answer: its stage times, end-to-end time (null if a part is missing), tokens, cost, error kind and failure bucket.

    generation: query_id, status, cache_hit, attempts, error, latency_ms, model, prompt_tokens, completion_tokens;
    retrieval: query_id, latency_ms (map); timings: query_id, prompt_ms, postprocess_ms, sha_match (those that don't match
    don't count); judged: query_id, bucket. Answers from the cache have no generation time, but tokens and cost.
    """
    stages = retrieval.select("query_id", canonical_stages(F.col("latency_ms")).alias("stage"), F.lit(True).alias("in_retrieval_run"))
    own = generation.withColumnRenamed("latency_ms", "generation_ms").join(stages, "query_id", "left")
    if timings is not None:
        own = own.join(timings.where("sha_match").select("query_id", "prompt_ms", "postprocess_ms"), "query_id", "left")
    else:
        own = own.withColumns({"prompt_ms": F.lit(None).cast("double"), "postprocess_ms": F.lit(None).cast("double")})
    own = own.join(judged.select("query_id", "bucket"), "query_id", "left") if judged is not None else own.withColumn("bucket", F.lit(None).cast("string"))
    own = own.withColumn("generation_ms", F.when((F.col("status") == "ok") & ~F.col("cache_hit"), F.col("generation_ms")))
    priced = token_cost(own, prices)
    return priced.select(
        "query_id", F.coalesce("in_retrieval_run", F.lit(False)).alias("in_retrieval_run"), "status", "cache_hit", "attempts", error_kind(F.col("error")).alias("error_kind"), F.col("stage.retrieval_total").alias("retrieval_ms"),
        "prompt_ms", "generation_ms", "postprocess_ms", (F.col("stage.retrieval_total") + F.col("prompt_ms") + F.col("generation_ms") + F.col("postprocess_ms")).alias("e2e_ms"),
        F.col("stage.total_consistent").alias("total_consistent"), *(F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost")), "bucket",
    )


def production_summary(records: DataFrame) -> DataFrame:
    """component, n, mean, p50, p95, p99, max, small_sample for each stage time, token count and the cost."""
    parts = ["retrieval_ms", "prompt_ms", "generation_ms", "postprocess_ms", "e2e_ms", "prompt_tokens", "completion_tokens", "cost"]
    pairs = F.array(*(F.struct(F.lit(p).alias("component"), F.col(p).cast("double").alias("value")) for p in parts))
    return distribution(records.select(F.explode(pairs).alias("p")).select("p.*"), "value", ["component"])


def cost_per_thousand(records: DataFrame) -> DataFrame:
    """n, total_usd, per_1k_usd of the answers that have a price."""
    return records.where("cost is not null").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("total_usd"), F.round(F.avg("cost") * 1000, 4).alias("per_1k_usd"))


def repeated_timings(samples: DataFrame) -> DataFrame:
    """query_id, prompt_ms, postprocess_ms, sha_match: medians of the repeats, and whether every one rebuilt the recorded prompt.

    samples: query_id, prompt_ms, postprocess_ms, sha256, recorded_sha256.
    """
    return samples.groupBy("query_id").agg(
        F.percentile("prompt_ms", 0.5).alias("prompt_ms"), F.percentile("postprocess_ms", 0.5).alias("postprocess_ms"), F.bool_and(F.coalesce(F.col("sha256") == F.col("recorded_sha256"), F.lit(False))).alias("sha_match")
    )


def resources(samples: DataFrame, by: list[str]) -> DataFrame:
    """by, n, and mean, p95 and peak of CPU and memory samples (cpu_percent, rss_mb)."""
    aggs = [F.count("*").alias("n")]
    for c in ("cpu_percent", "rss_mb"):
        aggs += [F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.percentile(c, 0.95), 4).alias(f"{c}_p95"), F.max(c).alias(f"{c}_peak")]
    return samples.groupBy(*by).agg(*aggs)


# ---- comparisons


def headline(metrics: DataFrame, baseline: str) -> DataFrame:
    """run, metric, value, delta against the baseline run; null for that run itself, 0 within EQUAL. metrics: run, metric, value; a missing baseline value counts as 0."""
    base = metrics.where(F.col("run") == baseline).select("metric", F.col("value").alias("base"))
    diff = F.col("value") - F.coalesce("base", F.lit(0.0))
    delta = F.when(F.col("run") != baseline, F.when(F.abs(diff) < EQUAL, 0.0).otherwise(F.round(diff, 6)))
    return metrics.join(F.broadcast(base), "metric", "left").select("run", "metric", "value", delta.alias("delta"))


def latency_table(latency: DataFrame) -> DataFrame:
    """run, total_median, total_p90, rerank_median, retrieval_only (total without rerank, not below 0). latency: run, total_ms, rerank_ms."""
    total = nearest_ranks(latency, "total_ms", ["run"], {"total_median": 0.5, "total_p90": 0.9})
    rerank = nearest_ranks(latency, "rerank_ms", ["run"], {"rerank_median": 0.5})
    both = total.join(rerank, "run", "left")
    return both.withColumn("retrieval_only", F.greatest(F.col("total_median") - F.coalesce("rerank_median", F.lit(0.0)), F.lit(0.0)))


def run_spreads(runs: DataFrame, limit: int) -> DataFrame:
    """query_id, spread and the value of each run (a map) where runs differ most; a run without the query counts as 0. runs: run, query_id, value."""
    names = runs.select("run").distinct()
    every = runs.select("query_id").distinct().crossJoin(F.broadcast(names)).join(runs, ["run", "query_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    spread = every.groupBy("query_id").agg(F.round(F.max("value") - F.min("value"), 6).alias("spread"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "value")))).alias("by_run"))
    return spread.where(F.col("spread") >= EQUAL).orderBy(F.col("spread").desc(), "query_id").limit(limit)


def routing_summary(routed: DataFrame, by: str) -> DataFrame:
    """by, n, fell_back, fanned_out: how often the router fell back, and chose text, tables and images all. routed: modalities, fell_back."""
    wanted = F.array(*map(F.lit, ("text", "table", "image")))
    fanned = F.size(F.array_intersect("modalities", wanted)) == 3
    return routed.groupBy(by).agg(F.count("*").alias("n"), F.count_if("fell_back").alias("fell_back"), F.count_if(fanned).alias("fanned_out"))


def pivoted(rows: DataFrame, index: str, column: str, value: str, names: list) -> DataFrame:
    """A comparison table: one row per index, one column per name."""
    return rows.groupBy(index).pivot(column, names).agg(F.first(value))
