"""Keyed table operations of the corpus store: provenance, statistics, upserts, cascading deletes, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def element_provenance(elements: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """element -> page -> document; an element without a section has its page's."""
    p = pages.select("page_id", F.col("section").alias("page_section"), "image_path")
    d = documents.select("doc_id", "title", "doc_type", "domain")
    return elements.join(p, "page_id").join(d, "doc_id").withColumn("section", F.coalesce("section", "page_section")).drop("page_section")


def corpus_stats(documents: DataFrame, pages: DataFrame, elements: DataFrame, low: float = 0.5) -> DataFrame:
    """One row per document. Pages and elements are counted before the join, so they don't multiply each other."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    e = elements.groupBy("doc_id").agg(
        F.count("*").alias("n_elements"), F.count_if(F.col("element_type") == "table").alias("n_tables"), F.count_if(F.col("element_type").isin("figure", "chart", "diagram")).alias("n_figures"),
        F.round(F.avg("extraction_confidence"), 3).alias("mean_confidence"), F.count_if(F.col("extraction_confidence") < low).alias("n_low_confidence"),
    )
    return documents.select("doc_id").join(p, "doc_id", "left").join(e, "doc_id", "left").fillna(0, ["n_pages", "n_elements", "n_tables", "n_figures", "n_low_confidence"])


def chunk_provenance(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """chunk_id, bbox, methods, confidence, n_missing from the chunk's elements; missing ones are tolerated."""
    ids = chunks.select("chunk_id", F.posexplode("element_ids").alias("place", "element_id"))
    found = ids.join(elements.select("element_id", "bbox", "extraction_method", "extraction_confidence", F.lit(1).alias("hit")), "element_id", "left")
    return found.groupBy("chunk_id").agg(
        F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox"),
        F.array_sort(F.collect_set("extraction_method")).alias("methods"), F.min("extraction_confidence").alias("confidence"), F.count_if(F.col("hit").isNull()).alias("n_missing"),
    )


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those of the same keys; the last columns win, repeated new keys must not differ."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.dropDuplicates(keys))


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose keys it lacks."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys).distinct(), keys, "left_anti"))


def delete_cascade(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents; elements whose parent went have none."""
    out = {name: t.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti") for name, t in tables.items()}
    if "elements" in out and "parent_id" in out["elements"].columns:
        kept = out["elements"].select(F.col("element_id").alias("parent_id"), F.lit(True).alias("_there")).distinct()
        out["elements"] = out["elements"].join(kept, "parent_id", "left").withColumn("parent_id", F.when(F.col("_there"), F.col("parent_id"))).drop("_there").select(*tables["elements"].columns)
    return out


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "request_key") -> DataFrame:
    """Requests without a usable answer in the cache; failed answers were never cached."""
    return requests.dropDuplicates([key]).join(cache.where("completion is not null").select(key).distinct(), key, "left_anti")


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def children(elements: DataFrame) -> DataFrame:
    """parent_id, element_id, ordinal of every child in reading order."""
    w = Window.partitionBy("parent_id").orderBy("reading_order", "element_id")
    parents = elements.select(F.col("element_id").alias("parent_id")).distinct()
    return elements.where("parent_id is not null").join(parents, "parent_id", "left_semi").withColumn("ordinal", F.row_number().over(w)).select("parent_id", "element_id", "ordinal")


def element_scan(elements: DataFrame, doc_id: str | None = None, page: int | None = None, kinds: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """Elements under optional predicates, all of which reach the scan, in reading order."""
    tests: list[Column] = []
    if doc_id is not None:
        tests.append(F.col("doc_id") == doc_id)
    if page is not None:
        tests.append(F.col("page_number") == page)
    if kinds:
        tests.append(F.col("element_type").isin(*kinds))
    if min_confidence is not None:
        tests.append(F.col("extraction_confidence") >= min_confidence)
    for t in tests:
        elements = elements.where(t)
    return elements.orderBy("page_number", "reading_order", "element_id")
