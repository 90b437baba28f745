"""Retrievers, the views they search, and their composition: hybrid, by modality, and of an engine with filters.

A retriever turns (query_id, ...) into ranked hits (query_id, chunk_id, score, rank); it is named, belongs to a modality
and has a weight. Its search is any function of the queries and k, so models stay outside: they are columns of vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import fusion
from skein.operators.ranking import ranked, top_k

#: Candidates of a retriever under a filter that is applied to its hits.
OVERFETCH = 4


@dataclass(frozen=True)
class Retriever:
    name: str
    modality: str
    search: Callable[[DataFrame, int], DataFrame]
    weight: float = 1.0


def chunk_type_for(element_type: Column) -> Column:
    """What kind of chunk an element becomes."""
    return F.when(element_type == "table", "table").when(element_type.isin("figure", "chart", "diagram"), "figure").otherwise("text")


def modality_of(chunk_type: Column) -> Column:
    """Which modality a chunk belongs to."""
    return F.when(chunk_type == "table", "table").when(chunk_type == "figure", "image").otherwise("text")


def table_schema_view(caption: Column, text: Column, columns: Column, table_type: Column, n_rows: Column, n_cols: Column, section: Column) -> Column:
    """What a table is about: caption (or the first line that is no grid), its first 40 named columns, type, shape and section."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("|")))
    lead = F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.trim(F.try_element_at(lines, F.lit(1))))
    named = F.slice(F.filter(columns, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), 1, 40)
    parts = F.array(
        lead,
        F.when(F.size(named) > 0, F.concat(F.lit("Columns: "), F.array_join(named, ", "))),
        F.when(table_type != "unknown", F.concat(F.lit("Table type: "), table_type)),
        F.when(n_rows.isNotNull() & n_cols.isNotNull(), F.format_string("%d rows by %d columns", n_rows, n_cols)),
        F.when(F.trim(section) != "", F.concat(F.lit("Section: "), section)),
    )
    return F.array_join(F.array_compact(parts), "\n")


def figure_text_view(text: Column, header: Column) -> Column:
    """A figure's text without its breadcrumb."""
    own = F.coalesce(text, F.lit(""))
    head = F.coalesce(header, F.lit(""))
    return F.trim(F.when((head != "") & F.startswith(own, head), F.substr(own, F.length(head) + 1)).otherwise(own))


def has_figure_text(text: Column, header: Column) -> Column:
    return figure_text_view(text, header) != ""


def page_candidates(pages: DataFrame, doc_ids: list[str] | None = None, page_numbers: list[int] | None = None) -> DataFrame:
    """Pages under optional allow-lists, which reach the scan; an empty list lets nothing pass."""
    if doc_ids is not None:
        pages = pages.where(F.col("doc_id").isin(doc_ids))
    if page_numbers is not None:
        pages = pages.where(F.col("page_number").isin(page_numbers))
    return pages


def two_views(by_words: DataFrame, by_vectors: DataFrame, k: int) -> DataFrame:
    """One list from two views of the same chunks (a table's content and its schema, a figure's text and its picture): the better rank counts.

    query_id, chunk_id, score, rank, component_ranks with the ranks in `words` and `vectors`.
    """
    both = by_words.select("query_id", F.lit("words").alias("retriever"), "chunk_id", "rank").unionByName(by_vectors.select("query_id", F.lit("vectors").alias("retriever"), "chunk_id", "rank"))
    return fusion.rrf(both, "max", top=k)


def view_diagnostics(hits: DataFrame) -> DataFrame:
    """query_id, n, words_only, vectors_only, both of the hits of two_views()."""
    words, vectors = (F.map_contains_key("component_ranks", F.lit(v)) for v in ("words", "vectors"))
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(words & ~vectors).alias("words_only"), F.count_if(vectors & ~words).alias("vectors_only"), F.count_if(words & vectors).alias("both"))


def fired(retrievers: list[Retriever], modalities: list[str] | None) -> list[Retriever]:
    """The retrievers of some modalities in the order of their registration; all for None."""
    return [r for r in retrievers if modalities is None or r.modality in modalities]


def retrieve(retrievers: list[Retriever], queries: DataFrame, k: int | dict[str, int] = 50, routed: DataFrame | None = None) -> DataFrame:
    """query_id, retriever, modality, ordinal, chunk_id, score, rank of all retrievers. routed: query_id, modalities; a query gets the lists of its modalities only."""
    out = None
    for ordinal, r in enumerate(retrievers):
        hits = r.search(queries, k if isinstance(k, int) else k[r.name]).select("query_id", "chunk_id", "score", "rank")
        hits = hits.select("query_id", F.lit(r.name).alias("retriever"), F.lit(r.modality).alias("modality"), F.lit(ordinal).alias("ordinal"), "chunk_id", "score", "rank")
        if routed is not None:
            own = routed.where(F.array_contains("modalities", r.modality)).select("query_id")
            hits = hits.join(own, "query_id", "left_semi")
        out = hits if out is None else out.unionByName(hits)
    return out


def summary(lists: DataFrame) -> DataFrame:
    """retriever, modality, n_queries, n_hits, mean_hits, top_score over a batch of queries."""
    return lists.groupBy("retriever", "modality").agg(
        F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_hits"), F.round(F.count("*") / F.count_distinct("query_id"), 6).alias("mean_hits"), F.round(F.max("score"), 6).alias("top_score")
    )


def with_chunks(fused: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits that have a chunk record, with it; and query_id, missing: how many have none."""
    known = chunks.select("chunk_id").withColumn("known", F.lit(True))
    marked = fused.join(known, "chunk_id", "left")
    missing = marked.groupBy("query_id").agg(F.count_if(F.col("known").isNull()).alias("missing"))
    return fused.join(chunks, "chunk_id"), missing


def modality_counts(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, modality, returned, missing: hits by the modality of their chunk (missing: without one, of modality null)."""
    joined = fused.join(chunks.select("chunk_id", modality_of(F.col("chunk_type")).alias("modality")), "chunk_id", "left")
    return joined.groupBy("query_id", "modality").agg(F.count("modality").alias("returned"), F.count_if(F.col("modality").isNull()).alias("missing"))


def hybrid(words: DataFrame, vectors: DataFrame, allowed: DataFrame | None = None, weights: tuple[float, float] = (1.0, 1.0), top: int = 10, scores: DataFrame | None = None, pool: int = 25) -> DataFrame:
    """Text-only retrieval: the word list, narrowed after the search, and the vector list by a weighted sum of reciprocal ranks; then a reranker's order, if there is one.

    allowed: query_id, doc_id pairs; queries without any are not narrowed. words: query_id, chunk_id, doc_id, rank.
    """
    if allowed is not None:
        narrowed = allowed.select("query_id").distinct().withColumn("narrowed", F.lit(True))
        fits = allowed.select("query_id", "doc_id", F.lit(True).alias("fits")).distinct()
        words = words.join(narrowed, "query_id", "left").join(fits, ["query_id", "doc_id"], "left").where("narrowed is null or fits")
        words = ranked(words.withColumnRenamed("rank", "old"), [F.col("old"), F.col("chunk_id")])
    both = words.select("query_id", F.lit("bm25").alias("retriever"), "chunk_id", "rank", F.lit(float(weights[0])).alias("weight"))
    both = both.unionByName(vectors.select("query_id", F.lit("dense").alias("retriever"), "chunk_id", "rank", F.lit(float(weights[1])).alias("weight")))
    if scores is None:
        return fusion.rrf(both, top=top)
    return fusion.rerank(fusion.rrf(both, top=pool), scores, pool, top)


def by_modality(retrievers: list[Retriever], lists: DataFrame, top: int = 10, floor: int = 8, pool: int = 25, explicit: dict[str, float] | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Retrieval by modality: lists are fused within, then across modalities; with a reranker a pool in which every modality has its share is reranked, without one the fused prefix stays."""
    spark = lists.sparkSession
    weights = fusion.modality_weights(spark.createDataFrame([(r.name, r.modality, r.weight) for r in retrievers], "retriever string, modality string, weight double"), explicit)
    fused = fusion.two_stage(lists, weights, top=None if scores is not None else top)
    if scores is None:
        return fused
    modalities = list(dict.fromkeys(r.modality for r in retrievers))
    chosen = fusion.balanced_pool(fused, fusion.rrf(lists.drop("weight"), keys=("query_id", "modality")), modalities, floor, max(pool, top))
    return fusion.rerank(chosen.join(fused.select("query_id", "chunk_id", "component_ranks"), ["query_id", "chunk_id"]), scores, max(pool, top), top)


def engine_filters(queries: DataFrame, resolved: DataFrame, use_metadata: bool = True) -> DataFrame:
    """query_id, doc_ids: the caller's, or where there are none those that the query's words resolve to; null: no narrowing.

    queries: query_id, doc_ids; resolved: query_id, doc_ids.
    """
    if not use_metadata:
        return queries.select("query_id", "doc_ids")
    found = resolved.select("query_id", F.col("doc_ids").alias("resolved"))
    return queries.join(found, "query_id", "left").select("query_id", F.coalesce("doc_ids", "resolved").alias("doc_ids"))


def source_element(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """chunk_id, element_id: the first of a chunk's elements that exists; null if none does."""
    listed = chunks.select("chunk_id", F.posexplode_outer("element_ids").alias("place", "element_id"))
    there = listed.join(elements.select("element_id", F.lit(True).alias("there")), "element_id", "left")
    return there.groupBy("chunk_id").agg(F.min_by(F.when(F.col("there"), F.col("element_id")), F.when(F.col("there"), F.col("place"))).alias("element_id"))


def first_by_page(hits: DataFrame, k: int) -> DataFrame:
    """The k best pages of each query by their best chunk. hits: query_id, doc_id, page, score, chunk_id."""
    w = Window.partitionBy("query_id", "doc_id", "page").orderBy(F.col("score").desc(), "chunk_id")
    best = hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return top_k(best, k)
