"""Named queries over recorded runs: selection, joins, aggregates, comparisons. Records are made of labels, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import evaluation, fusion, production, ranking, runs, understanding
from skein.plans import catalog
from skein.plans.catalog import query
from skein.sources import store

#: Columns of a generation record, in SQL that both engines read; values that are null or missing occur in most.
RECORD = {
    "query_id": "doc_id", "stratum": "lang", "requires": "CASE WHEN n_chars % 3 = 0 THEN 'table' WHEN n_chars % 3 = 1 THEN 'figure' ELSE 'text' END",
    "status": "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END", "answerable": "quality = 1", "evidence_retrieved": "value > 1.0", "evidence_in_context": "value > 1.0 AND n_chars < 3000",
    "refused": "n_chars % 7 = 0", "mixed_refusal": "n_chars % 14 = 0", "declines": "user_id % 11 = 0", "contradicts": "toxic = 1", "n_citations": "n_chars % 4", "n_unresolved": "CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END",
    "gold_page_cited": "CASE WHEN toxic = 0 THEN n_chars % 2 = 0 END", "facts_checkable": "n_chars % 4", "facts_found": "least(n_chars % 4, n_chars % 3)", "n_facts": "n_chars % 4", "n_covered": "least(n_chars % 4, n_chars % 5)",
    "n_sources": "1 + n_chars % 9", "answer_chars": "n_chars", "latency_ms": "value * 100", "cache_hit": "user_id % 5 = 0", "prompt_tokens": "n_chars", "completion_tokens": "n_chars % 97", "attempts": "1 + user_id % 2", "model": "lang",
    "error": "CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'APITimeoutError: late' WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'RateLimitError: 429' WHEN event_type = 'error' THEN 'boom' END",
    "judged": "user_id % 13 <> 0", "judge_status": "CASE WHEN user_id % 13 = 0 THEN 'error' ELSE 'ok' END", "repaired": "user_id % 17 = 0", "context_sufficient": "value > 0.5",
}
RECORD_CTE = f"r AS MATERIALIZED (SELECT n_chars, user_id, {', '.join(f'{e} AS {c}' for c, e in RECORD.items())} FROM labels JOIN documents USING (doc_id) JOIN events ON event_id = doc_id)"


def records(t) -> DataFrame:
    own = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id").join(t("events").select(F.col("event_id").alias("doc_id"), "user_id", "event_type", "value"), "doc_id")
    return own.selectExpr("n_chars", "user_id", *(f"{e} AS {c}" for c, e in RECORD.items()))


def judged(t) -> DataFrame:
    """Records with claims, scored."""
    n = F.col("n_chars")
    claims = F.transform(F.sequence(F.lit(1).cast("long"), 1 + n % 4), lambda i: F.struct(((n + i) % 3 != 0).alias("supported"), ((n + i) % 2 == 0).alias("cited"), ((n + i) % 5 != 0).alias("citation_supports")))
    return evaluation.judged_scores(records(t).withColumn("claims", claims).withColumnRenamed("n_unresolved", "unresolved_citations"))


JUDGED_CTE = f"""WITH {RECORD_CTE},
c AS (SELECT *, list_transform(generate_series(1, 1 + n_chars % 4), lambda i: {{'s': (n_chars + i) % 3 <> 0, 'c': (n_chars + i) % 2 = 0, 'b': (n_chars + i) % 5 <> 0}}) claims FROM r),
d AS (SELECT *, len(claims) n_claims, len(list_filter(claims, lambda x: x.s)) n_supported, len(list_filter(claims, lambda x: x.c)) n_cited, len(list_filter(claims, lambda x: x.c AND x.b)) n_backed, refused OR declines refused_any FROM c),
g AS (SELECT *, n_supported < n_claims has_unsupported, round(n_supported / n_claims, 6) faithfulness, CASE WHEN n_cited > 0 THEN round(n_backed / n_cited, 6) END citation_support, CASE WHEN n_facts > 0 THEN round(n_covered / n_facts, 6) END completeness,
  CASE WHEN refused_any THEN 'refused' WHEN n_facts = 0 THEN 'not_assessable' WHEN contradicts THEN 'incorrect' WHEN n_covered = n_facts THEN 'correct' WHEN n_covered > 0 THEN 'partial' ELSE 'incorrect' END correctness,
  n_unresolved > 0 OR n_citations = 0 OR n_backed < n_cited citation_problem FROM d),
j AS (SELECT *, CASE correctness WHEN 'correct' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 WHEN 'incorrect' THEN 0.0 END correctness_score, CASE WHEN answerable THEN correctness = 'correct' AND NOT has_unsupported END grounded_correct FROM g),
x AS (SELECT *, coalesce(evidence_in_context, false) inctx, coalesce(evidence_retrieved, false) ret FROM j),
k AS (SELECT *, CASE WHEN status <> 'ok' THEN 'error'
  WHEN NOT answerable THEN CASE WHEN refused_any AND NOT mixed_refusal THEN 'correct_refusal' WHEN has_unsupported THEN 'hallucinated_answer' ELSE 'answered_unanswerable' END
  WHEN refused_any AND inctx THEN 'over_refusal' WHEN refused_any AND ret THEN 'context_truncated' WHEN refused_any THEN 'retrieval_miss_refused'
  WHEN correctness = 'correct' AND has_unsupported THEN 'ungrounded_correct' WHEN correctness = 'correct' AND citation_problem THEN 'citation_error'
  WHEN correctness = 'correct' AND (NOT inctx OR NOT coalesce(gold_page_cited, true)) THEN 'correct_non_gold_page' WHEN correctness = 'correct' THEN 'fully_correct'
  WHEN ret AND NOT inctx THEN 'context_truncated' WHEN NOT inctx AND has_unsupported THEN 'hallucinated_answer' WHEN NOT inctx THEN 'retrieval_miss_answered' ELSE 'wrong_or_incomplete' END category FROM x),
b AS (SELECT *, CASE WHEN status <> 'ok' THEN 'error' WHEN NOT answerable THEN CASE WHEN category = 'correct_refusal' THEN 'correct_refusal' ELSE 'answered' END
  WHEN NOT ret THEN 'retrieval_failure' WHEN NOT inctx THEN 'context_failure' WHEN NOT coalesce(grounded_correct, false) THEN 'generation_failure' WHEN citation_problem THEN 'citation_failure' ELSE 'success' END bucket FROM k)"""


def categorised(t) -> DataFrame:
    inside, found = F.coalesce("evidence_in_context", F.lit(False)), F.coalesce("evidence_retrieved", F.lit(False))
    names = dict(failed=F.col("status") != "ok", refused=F.col("refused_any"), in_context=inside, retrieved=found, **{c: F.col(c) for c in ("answerable", "mixed_refusal", "has_unsupported", "correctness", "citation_problem", "gold_page_cited")})
    own = judged(t).withColumn("category", evaluation.error_category(names))
    return own.withColumn("bucket", evaluation.failure_bucket(names["failed"], F.col("answerable"), F.col("category"), found, inside, F.col("grounded_correct"), F.col("citation_problem")))


def _rate(name: str, flag: str, among: str = "true") -> str:
    f = f"CASE WHEN {among} THEN {flag} END"
    return f"count(*) FILTER ({f}) {name}_count, count({f}) {name}_of, CASE WHEN count({f}) > 0 THEN round(count(*) FILTER ({f}) / count({f}), 4) END {name}_rate"


def _mean(name: str, value: str, among: str = "true") -> str:
    v = f"CASE WHEN {among} THEN {value} END"
    return f"round(avg({v}), 4) {name}_mean, count({v}) {name}_n"


def _nearest(value: str, fraction: float) -> str:
    return f"list_sort(list({value}) FILTER ({value} IS NOT NULL))[least(CAST(floor(count({value}) * {fraction}) AS INTEGER), count({value}) - 1) + 1]"


# ---- judged answers


@query(JUDGED_CTE + " SELECT query_id, correctness, correctness_score, faithfulness, completeness, citation_support, grounded_correct, citation_problem, declines AND NOT refused refusal_without_marker FROM j")
def judged_scores(t, spark):
    return judged(t).select("query_id", "correctness", "correctness_score", "faithfulness", "completeness", "citation_support", "grounded_correct", "citation_problem", "refusal_without_marker")


@query(JUDGED_CTE + " SELECT category, count(*) n FROM k GROUP BY 1")
def taxonomy(t, spark):
    return categorised(t).groupBy("category").agg(F.count("*").alias("n"))


@query(JUDGED_CTE + " SELECT bucket, count(*) n, array_to_string(list_sort(list(query_id)), ',') query_ids FROM b GROUP BY 1")
def failure_buckets(t, spark):
    return categorised(t).groupBy("bucket").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("query_id")).cast("array<string>"), ",").alias("query_ids"))


_S, _A, _U = "answerable AND judged", "answerable AND judged AND NOT refused_any", "NOT answerable AND judged"
_JUDGED_AGG = ", ".join([
    "count(*) FILTER (answerable) n_answerable", f"count(*) FILTER ({_S}) n_judged", "count(*) FILTER (NOT answerable) n_unanswerable", "count(*) FILTER (judge_status = 'error') judge_errors", "count(*) FILTER (status <> 'ok') generation_errors",
    "count(*) FILTER (repaired) repaired", _rate("r", "evidence_in_context", _S), _rate("g", "grounded_correct", _S + " AND evidence_in_context"), _rate("e2e", "grounded_correct", _S), _rate("leak", "grounded_correct", _S + " AND NOT evidence_in_context"),
    _mean("correctness", "correctness_score", _S), _mean("completeness", "completeness", _S), _mean("faithfulness", "faithfulness", _A), _rate("hallucination", "has_unsupported", _A), _mean("citation_support", "citation_support", _A),
    _rate("context_sufficient", "context_sufficient", _S), _rate("proxy_agrees", "evidence_in_context = context_sufficient", _S), _rate("unanswerable_refused", "refused_any", _U), _rate("unanswerable_hallucination", "has_unsupported", _U + " AND NOT refused_any"),
    *(f"count(*) FILTER ({_S} AND correctness = '{x}') n_{x}" for x in ("correct", "partial", "incorrect", "refused")),
    *(f"count(*) FILTER ({_S} AND {c} AND {q}) {a}_{b}" for a, c in (("sufficient", "context_sufficient"), ("insufficient", "NOT context_sufficient")) for b, q in (("answered", "NOT refused_any"), ("refused", "refused_any"))),
])


@query(JUDGED_CTE + f" SELECT {_JUDGED_AGG} FROM j")
def judged_aggregate(t, spark):
    return runs.judged_aggregate(judged(t))


@query(JUDGED_CTE + f" SELECT requires, {_JUDGED_AGG} FROM j GROUP BY requires")
def judged_aggregate_by_requires(t, spark):
    return runs.judged_aggregate(judged(t), ["requires"])


# ---- generation runs

_OK, _SAID = "status = 'ok' AND answerable", "status = 'ok' AND answerable AND NOT refused"
_NEW = "CASE WHEN status = 'ok' AND NOT cache_hit THEN latency_ms END"
_GENERATION_AGG = ", ".join([
    "count(*) n_records", "count(*) FILTER (status = 'ok') n_ok", "count(*) FILTER (status = 'error') n_errors", f"count(*) FILTER ({_OK}) n_answerable", "count(*) FILTER (status = 'ok' AND NOT answerable) n_unanswerable",
    _rate("evidence_retrieved", "evidence_retrieved", _OK), _rate("evidence_in_context", "evidence_in_context", _OK), _rate("lost_to_budget", "(evidence_retrieved AND NOT evidence_in_context)", _OK), _rate("refused", "refused", _OK),
    _rate("mixed_refusal", "mixed_refusal", _OK), _rate("citation_presence", "n_citations > 0", _SAID), _rate("unresolved_citation", "n_unresolved > 0", _SAID), _rate("gold_page_cited", "gold_page_cited", _SAID),
    _rate("unanswerable_refused", "refused", "status = 'ok' AND NOT answerable"), f"coalesce(sum(facts_found) FILTER ({_OK}), 0)::BIGINT facts_found", f"coalesce(sum(facts_checkable) FILTER ({_OK}), 0)::BIGINT facts_checkable",
    f"CASE WHEN sum(facts_checkable) FILTER ({_OK}) > 0 THEN round(sum(facts_found) FILTER ({_OK}) / sum(facts_checkable) FILTER ({_OK}), 4) END facts_rate", _mean("sources_per_prompt", "n_sources"), _mean("answer_chars", "answer_chars", _SAID),
    f"count({_NEW}) n_uncached", f"{_nearest(_NEW, 0.5)} latency_median", f"{_nearest(_NEW, 0.9)} latency_p90",
])


@query(f"WITH {RECORD_CTE} SELECT {_GENERATION_AGG} FROM r")
def generation_aggregate(t, spark):
    return runs.generation_aggregate(records(t))


@query(f"WITH {RECORD_CTE} SELECT stratum, {_GENERATION_AGG} FROM r GROUP BY stratum")
def generation_aggregate_by_stratum(t, spark):
    return runs.generation_aggregate(records(t), ["stratum"])


@query(f"""WITH {RECORD_CTE}, s AS (SELECT count(*) n, count(*) FILTER (NOT cache_hit) calls, coalesce(sum(prompt_tokens) FILTER (NOT cache_hit), 0) gi, sum(prompt_tokens + 1150) ji FROM r),
u AS (SELECT 'generation' stage, calls, gi input_tokens, calls * 250 output_tokens FROM s UNION ALL SELECT 'judge', n, ji, n * 700 FROM s UNION ALL SELECT 'total', calls + n, gi + ji, calls * 250 + n * 700 FROM s)
SELECT stage, calls, input_tokens::BIGINT input_tokens, output_tokens, round(input_tokens / 1e6 * 0.15 + output_tokens / 1e6 * 0.6, 4) cost_usd FROM u""")
def cost_estimate(t, spark):
    return runs.estimate(records(t), 0.15, 0.6)


@query("SELECT doc_id query_id, 'missing_facts' problem FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown_query' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en') UNION ALL SELECT DISTINCT conv_id, 'id_collision' FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def generation_gold_problems(t, spark):
    ids = F.col("doc_id").alias("query_id")
    return runs.generation_gold_problems(t("labels").select(ids), t("documents").where("lang <> 'en'").select(ids), t("conversations").select(F.col("conv_id").alias("query_id")))


@query("SELECT query_id, answerable, position FROM (SELECT doc_id query_id, quality = 1 answerable, -doc_id AS position FROM labels) ORDER BY answerable DESC, position LIMIT 60")
def select_work(t, spark):
    own = t("labels").select(F.col("doc_id").alias("query_id"), (-F.col("doc_id")).alias("position"), "quality")
    return runs.select_work(own.where("quality = 1"), own.where("quality = 0"), limit=60)


@query("SELECT doc_id query_id, doc_id % 10 AS position FROM labels WHERE quality = 1 AND doc_id % 10 = 0 ORDER BY doc_id LIMIT 5")
def load_workload(t, spark):
    """The first five of the answerable queries in gold order."""
    own = t("labels").where("quality = 1 and doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("position"))
    return runs.workload(own, 5).select("query_id", (F.col("position") % 10).alias("position"))


@query(catalog.BM25_CTE + " SELECT query_id, chunk_id, rank, d.source FROM bm JOIN documents d ON d.doc_id = bm.chunk_id WHERE rank <= 10")
def rebuild_retrieved(t, spark):
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return runs.rebuild_retrieved(catalog.bm25_hits(t).select("query_id", "chunk_id", "rank"), chunks)


@query(catalog.GOLD_CTE + " SELECT query_id, bool_or(matched IS NOT NULL) \"found\" FROM gi LEFT JOIN mt USING (query_id) GROUP BY query_id")
def gold_evidence_found(t, spark):
    hits = catalog.bm25_hits(t).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.lit(1).alias("page"), F.lit("text").alias("modality"))
    return runs.contains_gold_evidence(hits, catalog.gold(t))


@query("""WITH q AS (SELECT doc_id query_id, sha256(text) prompt_sha256 FROM documents), a AS (SELECT doc_id, sha256(CASE WHEN quality = 1 THEN text ELSE text || '!' END) sha, concat('answer ', doc_id) answer FROM labels JOIN documents USING (doc_id) WHERE toxic = 0),
s AS (SELECT sha, arg_max(answer, doc_id) sa FROM a GROUP BY sha)
SELECT query_id, coalesce(sa, answer) answer, CASE WHEN sa IS NOT NULL THEN 'prompt_sha' WHEN answer IS NOT NULL THEN 'query_id_fallback' END AS match FROM q LEFT JOIN s ON sha = prompt_sha256 LEFT JOIN a ON a.doc_id = query_id""")
def replay_match(t, spark):
    docs = t("documents").select("doc_id", "text")
    requests = docs.select(F.col("doc_id").alias("query_id"), F.sha2("text", 256).alias("prompt_sha256"))
    done = t("labels").join(docs, "doc_id")
    sent = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    kept = done.select(F.col("doc_id").alias("query_id"), F.sha2(sent, 256).alias("prompt_sha256"), F.when(F.col("toxic") == 0, "ok").otherwise("error").alias("status"), F.concat(F.lit("answer "), F.col("doc_id")).alias("answer"))
    return runs.replay(requests, kept).select("query_id", "answer", "match")


@query("SELECT source artefact, 2::BIGINT n_fingerprints FROM documents GROUP BY source HAVING min(CASE WHEN lang = 'en' THEN doc_id END) IS NOT NULL AND min(CASE WHEN lang <> 'en' THEN doc_id END) IS NOT NULL")
def artefact_gates(t, spark):
    own = t("documents").groupBy("source", (F.col("lang") == "en").alias("en")).agg(F.min("doc_id").alias("first")).select(F.col("source").alias("artefact"), F.sha2(F.col("first").cast("string"), 256).alias("sha256"), "en")
    return runs.gates({"generation": own.where("en"), "judged": own.where("not en")})


@query("SELECT * FROM (SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, count(*) AS queries, coalesce(sum(e), 0)::BIGINT entries, count(*) FILTER (e IS NULL) without_evidence FROM (SELECT item_id query_id, (SELECT count(*) FROM documents d WHERE contains(lower(d.text), lower(b.text)) AND b.text <> '' HAVING count(*) > 0) e FROM benchmark b) GROUP BY GROUPING SETS ((), (1)))".replace("GROUP BY GROUPING SETS ((), (1))", "GROUP BY 1 UNION ALL SELECT NULL, count(*), coalesce(sum(e), 0)::BIGINT, count(*) FILTER (e IS NULL) FROM (SELECT (SELECT count(*) FROM documents d WHERE contains(lower(d.text), lower(b.text)) AND b.text <> '' HAVING count(*) > 0) e FROM benchmark b)"))
def gold_counts(t, spark):
    kinds = t("benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    return runs.gold_counts(kinds, catalog.gold(t), ["kind"])


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'retrieval' ELSE event_type END AS kind FROM events")
def run_kinds(t, spark):
    return t("events").select("event_id", runs.run_kind(F.when(F.col("event_type") != "click", F.col("event_type"))).alias("kind"))


@query(f"WITH {RECORD_CTE} SELECT query_id, status, latency_ms, lang run_id FROM r JOIN documents ON doc_id = query_id WHERE lang <> 'en'")
def run_tables(t, spark):
    """Runs written one by one to a run table, one of them twice, and read back."""
    path, own = store.workspace(spark, "runs"), records(t).select("query_id", "status", "latency_ms", "stratum")
    runs.save_run(own.where("stratum = 'de'").select("query_id", F.lit("stale").alias("status"), "latency_ms"), path, "generation", "de")
    for name in ("de", "fr", "es"):
        runs.save_run(own.where(F.col("stratum") == name).drop("stratum"), path, "generation", name)
    return runs.load_run(spark, path, "generation").select("query_id", "status", "latency_ms", "run_id")


# ---- production reports

_STAGES = f"""WITH {RECORD_CTE}, e2 AS (SELECT event_id query_id, coalesce(value, 0) + 2 rt FROM events WHERE user_id % 7 <> 0), tm AS (SELECT event_id query_id, 1.5 pm, 0.5 pp FROM events WHERE user_id % 4 <> 0),
p AS (SELECT r.query_id, rt IS NOT NULL in_retrieval_run, status, cache_hit, attempts, CASE WHEN error LIKE '%Timeout%' THEN 'timeout' WHEN error LIKE '%429%' THEN 'rate_limit' WHEN error IS NOT NULL THEN 'other' END error_kind, rt retrieval_ms, pm prompt_ms,
  CASE WHEN status = 'ok' AND NOT cache_hit THEN latency_ms END generation_ms, pp postprocess_ms, CASE WHEN status = 'ok' THEN prompt_tokens END prompt_tokens, CASE WHEN status = 'ok' THEN completion_tokens END completion_tokens,
  CASE WHEN status = 'ok' THEN (prompt_tokens * i + completion_tokens * o) / 1e6 END AS cost FROM (SELECT *, CASE WHEN model IN ('en', 'de') THEN 0.15::DOUBLE WHEN model = 'fr' THEN 2.5 END i, CASE WHEN model IN ('en', 'de') THEN 0.6::DOUBLE WHEN model = 'fr' THEN 10.0 END o FROM r) r LEFT JOIN e2 USING (query_id) LEFT JOIN tm USING (query_id)),
pr AS (SELECT *, retrieval_ms + prompt_ms + generation_ms + postprocess_ms e2e_ms FROM p)"""


def _production(t, spark) -> DataFrame:
    events = t("events")
    retrieval = events.where("user_id % 7 <> 0").select(F.col("event_id").alias("query_id"), F.map_filter(F.create_map(F.lit("bm25_ms"), F.col("value"), F.lit("fusion_ms"), F.lit(2.0)), lambda _, v: v.isNotNull()).alias("latency_ms"))
    samples = events.select(F.col("event_id").alias("query_id"), F.explode(F.array(*map(F.lit, (1.0, 1.5, 9.0)))).alias("prompt_ms"), F.lit(0.5).alias("postprocess_ms"), F.lit("a").alias("sha256"), F.when(F.col("user_id") % 4 == 0, "b").otherwise("a").alias("recorded_sha256"))
    prices = spark.createDataFrame(catalog.PRICES, "model string, aliases array<string>, input_per_million double, output_per_million double")
    return runs.production_records(records(t), retrieval, prices, runs.repeated_timings(samples), categorised(t).select("query_id", "bucket"))


@query(_STAGES + " SELECT query_id, in_retrieval_run, status, attempts, error_kind, retrieval_ms, prompt_ms, generation_ms, postprocess_ms, e2e_ms, prompt_tokens, completion_tokens, round(cost, 9) AS cost FROM pr")
def production_records(t, spark):
    return _production(t, spark).select("query_id", "in_retrieval_run", "status", "attempts", "error_kind", "retrieval_ms", "prompt_ms", "generation_ms", "postprocess_ms", "e2e_ms", "prompt_tokens", "completion_tokens", F.round("cost", 9).alias("cost"))


_PARTS = ("retrieval_ms", "prompt_ms", "generation_ms", "postprocess_ms", "e2e_ms", "prompt_tokens", "completion_tokens", "cost")


@query(_STAGES + f", nm AS MATERIALIZED (SELECT {', '.join(_PARTS)} FROM pr), u AS (" + " UNION ALL ".join(f"SELECT '{p}' component, CAST({p} AS DOUBLE) v FROM nm" for p in _PARTS) + """)
SELECT component, count(*) n, round(avg(v), 6) mean, round(quantile_cont(v, 0.5), 6) p50, round(quantile_cont(v, 0.95), 6) p95, round(quantile_cont(v, 0.99), 6) p99, round(max(v), 6) max, count(*) < 100 small_sample FROM u WHERE v IS NOT NULL GROUP BY 1""")
def production_summary(t, spark):
    return runs.production_summary(_production(t, spark))


@query(_STAGES + " SELECT count(*) n, round(sum(cost), 6) total_usd, round(avg(cost) * 1000, 4) per_1k_usd FROM pr WHERE cost IS NOT NULL")
def production_cost(t, spark):
    return runs.cost_per_thousand(_production(t, spark))


@query(f"WITH {RECORD_CTE} SELECT count(*) n, {_rate('error', chr(39) + 'error' + chr(39) + ' = status')}, {_rate('retry', 'attempts > 1')}, {_rate('timeout', 'coalesce(error LIKE ' + chr(39) + '%Timeout%' + chr(39) + ', false)')} FROM r")
def production_reliability(t, spark):
    from skein.functions.classify import error_kind

    return production.reliability(records(t).withColumn("error_kind", F.coalesce(error_kind(F.col("error")), F.lit("none"))))


@query("SELECT event_type, count(*) n, round(avg(value), 4) cpu_percent_mean, round(quantile_cont(value, 0.95), 4) cpu_percent_p95, max(value) cpu_percent_peak, round(avg(user_id), 4) rss_mb_mean, round(quantile_cont(user_id, 0.95), 4) rss_mb_p95, max(user_id) rss_mb_peak FROM events GROUP BY 1")
def resource_summary(t, spark):
    return runs.resources(t("events").select("event_type", F.col("value").alias("cpu_percent"), F.col("user_id").alias("rss_mb")), ["event_type"])


# ---- comparisons


@query("""WITH m AS (SELECT event_type run, user_id % 5 metric, round(avg(value), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2), b AS (SELECT metric, value base FROM m WHERE run = 'click')
SELECT run, metric, value, CASE WHEN run <> 'click' THEN CASE WHEN abs(value - coalesce(base, 0)) < 5e-4 THEN 0.0 ELSE round(value - coalesce(base, 0), 6) END END delta FROM m LEFT JOIN b USING (metric)""")
def headline_deltas(t, spark):
    own = t("events").where("value is not null").groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 5).alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return runs.headline(own, "click")


@query(f"""WITH e AS (SELECT event_type run, value total_ms, CASE WHEN user_id % 3 = 0 THEN value / 2 END rerank_ms FROM events), a AS (SELECT run, {_nearest('total_ms', 0.5)} total_median, {_nearest('total_ms', 0.9)} total_p90, {_nearest('rerank_ms', 0.5)} rerank_median FROM e GROUP BY run)
SELECT *, greatest(total_median - coalesce(rerank_median, 0), 0) retrieval_only FROM a""")
def latency_comparison(t, spark):
    return runs.latency_table(t("events").select(F.col("event_type").alias("run"), F.col("value").alias("total_ms"), F.when(F.col("user_id") % 3 == 0, F.col("value") / 2).alias("rerank_ms")))


_RRF_TOP = catalog.LISTS_CTE + """, gold AS (SELECT b.item_id query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''), ng AS (SELECT query_id, count(*) n FROM gold GROUP BY 1),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) s, min(rank) best FROM l GROUP BY ALL), h AS (SELECT query_id, chunk_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, best, chunk_id) <= 10),
ra AS (SELECT ng.query_id, count(DISTINCT g.doc_id) / any_value(n) v FROM ng LEFT JOIN (SELECT gold.* FROM gold JOIN bm ON bm.query_id = gold.query_id AND bm.chunk_id = gold.doc_id AND bm.rank <= 10) g ON g.query_id = ng.query_id GROUP BY 1),
rb AS (SELECT ng.query_id, count(DISTINCT g.doc_id) / any_value(n) v FROM ng LEFT JOIN (SELECT gold.* FROM gold JOIN h ON h.query_id = gold.query_id AND h.chunk_id = gold.doc_id) g ON g.query_id = ng.query_id GROUP BY 1)"""


def _recall(t, hits: DataFrame, run: str) -> DataFrame:
    own = evaluation.match_gold(hits.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.lit(1).alias("page"), F.lit("text").alias("modality")), catalog.gold(t))
    counts = catalog.gold(t).groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return evaluation.metrics(own.select("query_id", "rank", "matched"), counts, (10,)).select(F.lit(run).alias("run"), "query_id", F.col("recall_10").alias("value"))


@query(_RRF_TOP + " SELECT ra.query_id, round(abs(ra.v - rb.v), 6) spread FROM ra JOIN rb USING (query_id) WHERE abs(ra.v - rb.v) >= 5e-4 ORDER BY spread DESC, query_id LIMIT 10")
def run_disagreements(t, spark):
    """Where words alone and hybrid retrieval differ most in recall."""
    both = _recall(t, catalog.bm25_hits(t), "words").unionByName(_recall(t, fusion.rrf(catalog.lists(t), top=10), "hybrid"))
    return runs.run_spreads(both, 10).select("query_id", "spread")


@query("WITH src AS (SELECT conv_id * 1000 + turn query_id, coalesce(text, '') q FROM conversations) " + catalog._routed_sql().replace("WITH x AS", ", x AS", 1).replace("SELECT query_id, table_score, image_score, concat(", "SELECT query_id % 1000 AS turn, count(*) n, count(*) FILTER (table_score < 0.5 AND image_score < 0.5 AND NOT prose) fell_back, count(*) FILTER ((table_score >= 0.5 AND image_score >= 0.5) OR (table_score < 0.5 AND image_score < 0.5 AND NOT prose)) fanned_out FROM y GROUP BY 1 --"))
def routing_report(t, spark):
    routed = understanding.route(t("conversations").select("turn", F.coalesce("text", F.lit("")).alias("q")), "q")
    fell = (F.col("table_score") < 0.5) & (F.col("image_score") < 0.5) & (F.size("modalities") == 3)
    return runs.routing_summary(routed.withColumn("fell_back", fell), "turn")


@query("PIVOT (SELECT user_id % 4 AS level, event_type, count(*) n FROM events GROUP BY 1, 2) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING first(n) GROUP BY level")
def load_comparison(t, spark):
    own = t("events").groupBy((F.col("user_id") % 4).alias("level"), "event_type").agg(F.count("*").alias("n"))
    return runs.pivoted(own, "level", "event_type", "n", ["click", "error", "purchase", "signup", "view"])


@query("SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name})::VARCHAR line FROM nation")
def json_report(t, spark):
    return runs.to_json_lines(t("nation").select("n_nationkey", "n_name"))
