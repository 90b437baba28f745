"""Indexes as tables: vector collections, multi-vector page indexes, their manifests, checks and resumable builds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1


class IndexIntegrityError(ValueError):
    """An index that must not be used."""


# ---- encoders: any function of a column of texts or bytes


def encoded(encode: Callable[[pd.Series], pd.Series], values: Column, prefix: str = "", limit: int | None = None) -> Column:
    """Unit vectors of an encoder for values with a prefix (passages and queries have their own), cut at limit characters."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        def unit(v):
            x = np.asarray(v, np.float64)
            n = np.linalg.norm(x)
            return (x / n if n else x).astype(np.float32)

        return encode(texts).map(lambda v: None if v is None else unit(v))

    text = F.concat(F.lit(prefix), values)
    return run(text if limit is None else F.substring(text, 1, limit))


def compatible_identity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether vectors of two encoders may be compared: the same model and dimension, and the same revision and commit where both name one."""
    same = a["model"].eqNullSafe(b["model"]) & a["dim"].eqNullSafe(b["dim"])
    for key in ("revision", "commit"):
        both = (F.coalesce(a[key], F.lit("")) != "") & (F.coalesce(b[key], F.lit("")) != "")
        same = same & (~both | (a[key] == b[key]))
    return F.coalesce(same, F.lit(False))


def vector_problems(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key, problem: empty, wrong_dimension, not_finite or duplicate. Multi-vectors (arrays of arrays) are checked token by token."""
    nested = isinstance(vectors.schema[vector].dataType.elementType, T.ArrayType)
    flat = F.flatten(F.col(vector)) if nested else F.col(vector)
    wrong = F.exists(F.col(vector), lambda t: F.size(t) != dim) if nested else F.size(F.col(vector)) != dim
    bad = F.exists(flat, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(F.col(vector).isNull() | (F.size(F.col(vector)) == 0), "empty").when(wrong, "wrong_dimension").when(bad, "not_finite")
    own = vectors.select(key, problem.alias("problem")).where("problem is not null")
    return own.unionByName(vectors.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate").alias("problem")))


# ---- vector collections


def recreate(vectors: DataFrame, path: str, dim: int) -> None:
    """A collection in place of any other at path; vectors with problems refuse the whole. vectors: chunk_id, embedding, payload columns."""
    if row := vector_problems(vectors, "chunk_id", "embedding", dim).head(1):
        raise IndexIntegrityError(f"{row[0].chunk_id}: {row[0].problem}")
    vectors.withColumn("index_version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def collection(spark: SparkSession, path: str) -> DataFrame | None:
    """The collection at path, or None if there is none: searches are empty then."""
    try:
        own = spark.read.parquet(path)
    except Exception as e:  # Spark names a missing path, other faults are raised
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if own.where(F.col("index_version") != VERSION).head(1):
        raise IndexIntegrityError(f"{path} holds another version than {VERSION}")
    return own.drop("index_version")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The collection with new vectors in place of those of the same chunks."""
    return old.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(new.dropDuplicates(["chunk_id"]))


# ---- multi-vector page indexes


def page_index(tokens: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, doc_id, page, first, n_tokens, sha256) in the order of their ids, and one row of figures: pages, tokens, and tokens a page at least, in the middle and at most.

    tokens: page_id, doc_id, page, vectors (array of arrays). Pages with problems refuse the build. first: where a page's
    tokens start when all pages stand one after the other.
    """
    if row := vector_problems(tokens, "page_id", "vectors", dim).head(1):
        raise IndexIntegrityError(f"{row[0].page_id}: {row[0].problem}")
    own = tokens.select("page_id", "doc_id", "page", F.size("vectors").cast("long").alias("n_tokens"), F.sha2(F.to_json("vectors"), 256).alias("sha256"))
    # Running totals in two steps: a total for each document, then within it; no window spans all pages.
    docs = own.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    before = docs.alias("a").join(F.broadcast(docs.alias("b")) if docs.count() <= 10_000 else docs.alias("b"), F.col("b.doc_id") < F.col("a.doc_id"), "left").groupBy("a.doc_id").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    pages = own.withColumn("within", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(before, "doc_id").select("page_id", "doc_id", "page", (F.col("before") + F.col("within")).alias("first"), "n_tokens", "sha256")
    return pages, own.agg(F.count("*").alias("pages"), F.sum("n_tokens").alias("tokens"), F.min("n_tokens").alias("least"), F.percentile("n_tokens", 0.5).alias("middle"), F.max("n_tokens").alias("most"))


def index_problems(pages: DataFrame, manifest: dict, expected: dict, pins: DataFrame, chunk_pages: DataFrame) -> DataFrame:
    """problem, detail of a written page index: another kind, model, dimension or revision, documents that changed since, and, if it claims to be complete, pages with chunks that it lacks.

    pages: page_id, doc_id, page, doc_sha256; pins: doc_id, sha256; chunk_pages: doc_id, page.
    """
    spark = pages.sparkSession
    rows = [(k, f"{manifest.get(k)} instead of {v}") for k, v in expected.items() if manifest.get(k) != v and not (k == "revision" and (v is None or manifest.get(k) is None))]
    out = spark.createDataFrame(rows, "problem string, detail string")
    changed = pages.select("doc_id", "doc_sha256").distinct().join(pins, "doc_id", "left").where(~F.col("doc_sha256").eqNullSafe(F.col("sha256")))
    out = out.unionByName(changed.select(F.lit("document_changed").alias("problem"), F.col("doc_id").cast("string").alias("detail")))
    if manifest.get("complete"):
        lost = chunk_pages.select("doc_id", "page").distinct().join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
        out = out.unionByName(lost.select(F.lit("page_missing").alias("problem"), F.concat_ws("#p", "doc_id", "page").alias("detail")))
    return out


def to_encode(wanted: DataFrame, done: DataFrame, identity: str) -> DataFrame:
    """Pages (page_id, image_sha256) that no checkpoint of this model and this image holds; each once. done: page_id, image_sha256, identity."""
    return wanted.dropDuplicates(["page_id"]).join(done.where(F.col("identity") == identity).select("page_id", "image_sha256"), ["page_id", "image_sha256"], "left_anti")


def query_vectors(queries: DataFrame, cache: DataFrame, identity: str, encode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, query_vec: from the cache by the query's hash, else from the encoder; without one a query that isn't cached is an error.

    queries: query_id, query; cache: query_sha256, identity, vector; encode: (query_sha256, query) -> (query_sha256, vector).
    """
    keyed = queries.withColumn("query_sha256", F.sha2("query", 256))
    own = cache.where(F.col("identity") == identity).select("query_sha256", "vector").dropDuplicates(["query_sha256"])
    new = keyed.select("query_sha256", "query").dropDuplicates(["query_sha256"]).join(own, "query_sha256", "left_anti")
    if encode is not None:
        own = own.unionByName(encode(new).select("query_sha256", "vector"))
    elif row := new.head(1):
        raise KeyError(f"no vector for {row[0]['query']!r} and no encoder")
    return keyed.join(own, "query_sha256").select("query_id", F.col("vector").alias("query_vec"))


def partitions(chunks: DataFrame) -> dict[str, DataFrame]:
    """The views that are indexed: text, table and figure by words, figure_image by pictures. chunks: chunk_type, has_text, image_path, ..."""
    kind = F.col("chunk_type")
    return {"text": chunks.where(kind == "text"), "table": chunks.where(kind == "table"), "figure": chunks.where((kind == "figure") & F.col("has_text")), "figure_image": chunks.where((kind == "figure") & F.col("image_path").isNotNull())}


def coverage(chunks: DataFrame, indexed: dict[str, DataFrame]) -> DataFrame:
    """name, n_chunks, n_indexed, complete: how much of each view an index holds."""
    views, out = partitions(chunks), None
    for name, view in views.items():
        have = indexed[name].select("chunk_id").distinct() if name in indexed else view.select("chunk_id").limit(0)
        row = view.select("chunk_id").join(have.withColumn("there", F.lit(True)), "chunk_id", "left").agg(F.lit(name).alias("name"), F.count("*").alias("n_chunks"), F.count("there").alias("n_indexed"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("complete", F.col("n_chunks") == F.col("n_indexed"))
