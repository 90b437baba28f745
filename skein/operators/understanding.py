"""Query understanding: routing, page filters, filter merging, metadata resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Routing signals and their weights, patterns, words that name no document.
TABLE_SIGNALS = (
    (r"\btables?\b", 1.0), (r"\brows?\b", 0.6), (r"\bcolumns?\b", 0.6), (r"\bcells?\b", 0.5), (r"\bhow (?:many|much)\b", 0.4), (r"\btotals?\b", 0.4), (r"\bcompared? (?:to|with)\b", 0.3),
    (r"\bbreakdown\b", 0.5), (r"\bper (?:year|quarter|segment|region|category)\b", 0.4), (r"\blist (?:of|all)\b", 0.3), (r"[$€£]\s?\d", 0.3), (r"\b\d+(?:\.\d+)?\s?%", 0.3),
)
IMAGE_SIGNALS = (
    (r"\bfigures?\b", 1.0), (r"\bcharts?\b", 1.0), (r"\bdiagrams?\b", 1.0), (r"\bplots?\b", 0.8), (r"\bgraphs?\b", 0.8), (r"\bimages?\b", 0.8), (r"\bphotos?\b", 0.8), (r"\bschematic\b", 0.9),
    (r"\billustrat\w*", 0.7), (r"\bdepicts?\b", 0.7), (r"\bshows?\b", 0.35), (r"\bvisuali[sz]\w*", 0.7), (r"\blooks? like\b", 0.6), (r"\baxis|axes\b", 0.6), (r"\blegend\b", 0.5),
    (r"\bcurve\b", 0.5), (r"\btrend\b", 0.35), (r"\barchitecture\b", 0.4),
)
PROSE = (
    r"\b(?:summari[sz]e|explain|describe|what does .* mean|why|definition of)\b",
    r"\bwho (?:is|are|was|were)\b",
    r"\baccording to the (?:text|report|paper|document)\b",
)
PAGE = r"(?i)\b(?:on\s+)?(?:page|pp?\.)\s*(\d{1,4})\b"
NUMBERED = r"(?i)\b(figure|fig\.?|table)\s*(\d{1,3})\b"
STOPWORDS = "the a an of in on for and or to with report annual paper document study review summary what which how does did is are was were say says about according data results analysis".split()
TERM = r"[A-Za-z][A-Za-z0-9\-]+"
THRESHOLD = 0.5


def signal_score(query: Column, signals: tuple[tuple[str, float], ...], pointed: Column) -> Column:
    """Weights of the signals that occur, at most 1; 1 where the query points at a number of that kind."""
    total = F.lit(0.0)
    for pattern, weight in signals:
        total = total + F.when(query.rlike("(?i)" + pattern), weight).otherwise(0.0)
    return F.when(pointed, 1.0).otherwise(F.round(F.least(F.lit(1.0), total), 6))


def route(queries: DataFrame, text_col: str = "text", fallback: bool = True, always: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """queries with table_score, image_score and modalities (text first)."""
    q = F.coalesce(F.col(text_col), F.lit(""))
    kind = F.lower(F.regexp_extract(q, NUMBERED, 1))
    out = queries.withColumn("table_score", signal_score(q, TABLE_SIGNALS, kind == "table")).withColumn("image_score", signal_score(q, IMAGE_SIGNALS, (kind != "") & (kind != "table")))
    table, image = F.col("table_score") >= threshold, F.col("image_score") >= threshold
    prose = F.lit(False)
    for p in PROSE:
        prose = prose | q.rlike("(?i)" + p)
    every = ~table & ~image & ~prose if fallback else F.lit(False)
    fired = F.array_compact(F.array(F.lit("text"), F.when(table | every, F.lit("table")), F.when(image | every, F.lit("image"))))
    return out.withColumn("modalities", F.array_union(fired, F.array(*map(F.lit, always))) if always else fired)


def page_filter(query: Column) -> Column:
    """Pages that a query names; null if none."""
    pages = F.transform(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(PAGE), F.lit(1)), lambda p: p.cast("int"))
    return F.when(F.size(pages) > 0, pages)


def merge_filters(a: Column, b: Column) -> Column:
    """Both constraints at once, in the left one's order; null constrains nothing, an empty list lets nothing pass."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_intersect(a, b))


def passes(value: Column, allowed: Column, empty_means_all: bool = False) -> Column:
    """Whether a value meets an allow-list."""
    free = allowed.isNull() | (F.size(allowed) == 0) if empty_means_all else allowed.isNull()
    return free | F.coalesce(F.array_contains(allowed, value), F.lit(False))


def facet_terms(*texts: Column) -> Column:
    """Words of three letters or more that can name a document."""
    joined = F.concat_ws(" ", *(F.replace(t, F.lit("_"), F.lit(" ")) for t in texts))
    words = F.transform(F.regexp_extract_all(joined, F.lit(TERM), F.lit(0)), F.lower)
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def generic_terms(facets: DataFrame, bodies: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Facet terms that at least `fraction` of the documents have in their bodies: topics, not names.

    facets: doc_id, term; bodies: doc_id, term (distinct).
    """
    n = bodies.agg(F.countDistinct("doc_id").alias("n_docs"))
    df = bodies.join(facets.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).where(F.col("df") >= fraction * F.col("n_docs")).select("term", "df")


def resolve(queries: DataFrame, facets: DataFrame, min_terms: int = 1) -> DataFrame:
    """query_id, doc_ids: documents that share min_terms facet terms with the query; queries that fit more than half of
    all documents (and more than one) resolve to nothing. queries: query_id, term; facets: doc_id, term."""
    n = facets.agg(F.countDistinct("doc_id").alias("n_docs"))
    shared = queries.distinct().join(facets.distinct(), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_terms)
    found = shared.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    return found.crossJoin(F.broadcast(n)).where(F.size("doc_ids") <= F.greatest(F.lit(1), F.floor(F.col("n_docs") / 2))).select("query_id", "doc_ids")


def apply_filter(hits: DataFrame, chunks: DataFrame, allowed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Hits whose chunk meets the query's allow-lists, ranked anew without gaps; unknown chunks fall out.

    allowed: query_id and one array column for each field, named after it with _in.
    """
    from skein.operators.ranking import ranked

    joined = hits.join(chunks, "chunk_id").join(F.broadcast(allowed), "query_id", "left")
    for field in fields:
        joined = joined.where(passes(F.col(field), F.col(f"{field}_in")))
    return ranked(joined.select(*hits.columns).withColumnRenamed("rank", "old_rank"), [F.col("old_rank"), F.col("chunk_id")]).drop("old_rank")
