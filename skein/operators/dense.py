"""Dense and multi-vector scoring: exact, as products of blocks of vectors with blocks of queries.

Queries go out in blocks of about QUERY_BLOCK vectors, one pass over the corpus for each; a task scores a few rows at a
time and returns what may be among its best k of each query, so neither pairs nor scores are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.blocks import Best, best_rows, row_slices
from skein.operators.ranking import top_k

QUERY_BLOCK = 4_096


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    if not len(lists):
        return np.zeros((0, 0))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _query_blocks(queries: DataFrame, columns: list[str], whole: bool = False):
    """Rows of the queries in blocks, one at a time on the driver. whole: rows that follow each other with the same first value stay in one block."""
    held = []
    for row in queries.select(*columns).toLocalIterator():
        if len(held) >= QUERY_BLOCK and not (whole and held[-1][0] == row[0]):
            yield held
            held = []
        held.append(tuple(row))
    if held:
        yield held


def _types(df: DataFrame, name: str) -> tuple[str, pa.DataType, str]:
    """Spark type of a column, and the type it travels as."""
    kind = df.schema[name].dataType.simpleString()
    wide = kind in ("bigint", "int", "smallint", "tinyint")
    return kind, pa.int64() if wide else pa.string(), "long" if wide else "string"


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, match: tuple[str, str] | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by cosine. vectors: chunk_id, embedding; queries: query_id, query_vec.

    match: columns of vectors and queries that must be equal. Vectors are of one dimension; null ones and zeros score 0
    or are left out (null). Ties go to the smaller chunk id; scores are compared at six digits. Without queries or
    vectors the result is empty.
    """
    spark = vectors.sparkSession
    query_kind, query_type, query_wire = _types(queries, "query_id")
    chunk_kind, chunk_type, chunk_wire = _types(vectors, "chunk_id")
    own = vectors.where("embedding is not null").select("chunk_id", "embedding", *([F.col(match[0]).cast("string").alias("own")] if match else []))
    found = None
    for rows in _query_blocks(queries.where("query_vec is not null").withColumn("own", F.col(match[1]).cast("string") if match else F.lit("")), ["query_id", "query_vec", "own"]):
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], _unit(np.array([r[1] for r in rows], np.float64)), np.array([r[2] for r in rows])))

        def score(batches, sent=sent):
            ids, matrix, wanted = sent.value
            best = Best(k, len(ids))
            codes = {label: n for n, label in enumerate(dict.fromkeys(wanted.tolist()))}
            asked = np.array([codes[label] for label in wanted.tolist()])
            columns: dict = {}
            for n, own_id in enumerate(ids):
                columns.setdefault(own_id, []).append(n)
            for whole in batches:
                for a, b in row_slices(len(whole), len(ids)):
                    batch = whole.slice(a, b - a)
                    scores = _unit(_matrix(batch.column(1))) @ matrix.T
                    if exclude_self:
                        for n, own_id in enumerate(batch.column(0).to_pylist()):
                            if own_id in columns:
                                scores[n, columns[own_id]] = -2.0
                    if match:
                        scores[np.array([codes.get(x, -1) for x in batch.column(2).to_pylist()])[:, None] != asked[None, :]] = -2.0
                    yield best_rows(scores, batch.column(0), ids, k, lambda s: s > -1.5, query_type, chunk_type, best)

        part = own.mapInArrow(score, f"query_id {query_wire}, chunk_id {chunk_wire}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id {query_wire}, chunk_id {chunk_wire}, score double")
    return top_k(found.select(F.col("query_id").cast(query_kind).alias("query_id"), F.col("chunk_id").cast(chunk_kind).alias("chunk_id"), F.round("score", 6).alias("score")), k)


def maxsim(page_tokens: DataFrame, query_tokens: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, page_id, score: over the query's tokens, the sum of the best match among the page's tokens.

    page_tokens: page_id, vec; query_tokens: query_id, token_id, query_vec; whole numbers or strings as ids. A page's
    tokens come together by a shuffle on page_id and are reduced to one row; k: at most so many pages of each query
    leave a task (and those that tie).
    """
    spark = page_tokens.sparkSession
    query_kind, query_type, query_wire = _types(query_tokens, "query_id")
    page_kind, page_type, page_wire = _types(page_tokens, "page_id")
    own = page_tokens.where("vec is not null").select("page_id", "vec").repartition("page_id").sortWithinPartitions("page_id")
    found = None
    for rows in _query_blocks(query_tokens.orderBy("query_id", "token_id"), ["query_id", "query_vec"], whole=True):
        ids = sorted({r[0] for r in rows})
        sent = spark.sparkContext.broadcast((ids, np.searchsorted(ids, [r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))

        def score(batches, sent=sent):
            ids, owner, matrix = sent.value
            starts = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
            open_page, best = None, None
            leading = Best(k, len(ids)) if k else None
            for batch in (w.slice(a, b - a) for w in batches for a, b in row_slices(len(w), len(owner))):
                pages = np.array(batch.column(0).to_pylist(), object)
                first = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1]])
                most = np.maximum.reduceat(_matrix(batch.column(1)) @ matrix.T, first, axis=0)
                names = pages[first].tolist()
                if open_page is not None and names[0] == open_page:
                    most[0] = np.maximum(most[0], best)
                elif open_page is not None:
                    names, most = [open_page, *names], np.r_[best[None], most]
                open_page, best = names[-1], most[-1]
                if len(names) > 1:
                    yield rows_of(names[:-1], most[:-1], ids, starts, leading)
            if open_page is not None:
                yield rows_of([open_page], best[None], ids, starts, leading)

        def rows_of(names, most, ids, starts, leading):
            sums = np.add.reduceat(most, starts, axis=1)
            return best_rows(sums, pa.array(names, page_type), ids, len(names), lambda s: s > -np.inf, query_type, page_type, leading).rename_columns(["query_id", "page_id", "score"])

        part = own.mapInArrow(score, f"query_id {query_wire}, page_id {page_wire}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id {query_wire}, page_id {page_wire}, score double")
    return found.select(F.col("query_id").cast(query_kind).alias("query_id"), F.col("page_id").cast(page_kind).alias("page_id"), F.round("score", 6).alias("score"))


def expand_pages(page_hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Chunks of ranked pages in page order, then chunk order, cut at k; each carries its page's score.

    page_hits: query_id, page_id, score, rank; chunks: chunk_id, page_id, ordinal. Pages without chunks fall out.
    """
    joined = page_hits.withColumnRenamed("rank", "page_rank").join(chunks, "page_id")
    return top_k(joined, k, [F.col("page_rank"), F.col("ordinal"), F.col("chunk_id")]).select("query_id", "chunk_id", "page_id", "score", "rank")
