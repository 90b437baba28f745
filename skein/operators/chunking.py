"""Elements to retrieval units: flattening, prose packing with overlap, table splitting, chunk ids."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import SUBWORD_FACTOR, split_sentences

PIECES = re.compile(r"\w+|[^\w\s]")
#: Runs whose chunks leave a task at once.
RUNS = 256


def count_tokens(text: str) -> int:
    return math.floor(len(PIECES.findall(text)) * SUBWORD_FACTOR)


def chunk_id(variant: Column, doc_id: Column, page: Column, element_ids: Column, body: Column, salt: Column | None = None) -> Column:
    parts = F.concat_ws("|", doc_id, page.cast("string"), F.array_join(element_ids, ","), body, F.coalesce(salt, F.lit("")) if salt is not None else F.lit(""))
    return F.concat(variant, F.lit("#"), F.substring(F.sha1(parts.cast("binary")), 1, 16))


def best_text(kind: Column, text: Column, caption: Column, table: Column, description: Column, ocr: Column) -> Column:
    """What an element says: tables their caption and grid, figures caption, description and OCR, others their text."""

    def lines(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), lambda x: x != ""), "\n")

    return F.when(kind == "table", lines(caption, table)).when(kind.isin("figure", "chart", "diagram"), lines(caption, description, ocr)).otherwise(lines(text))


def flatten(elements: DataFrame, keep_textless_visuals: bool = False) -> DataFrame:
    """elements with `loss`: boilerplate, redundant_caption, empty, or null for those that stay.

    A caption whose parent already carries one is redundant. elements: element_id, parent_id, kind, caption, body.
    """
    parents = elements.where("caption is not null and trim(caption) <> ''").select(F.col("element_id").alias("parent_id"), F.lit(True).alias("captioned"))
    visual = F.col("kind").isin("figure", "chart", "diagram")
    blank = F.trim(F.coalesce("body", F.lit(""))) == ""
    kept_blank = visual if keep_textless_visuals else F.lit(False)
    loss = F.when(F.col("kind").isin("header", "footer"), "boilerplate").when((F.col("kind") == "caption") & F.coalesce("captioned", F.lit(False)), "redundant_caption").when(blank & ~kept_blank, "empty")
    return elements.join(parents, "parent_id", "left").withColumn("loss", loss).drop("captioned")


def prose_runs(elements: DataFrame) -> DataFrame:
    """elements with run: tables and figures end a run of prose. elements: doc_id, page, reading_order, kind."""
    w = Window.partitionBy("doc_id", "page").orderBy("reading_order", "element_id").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("run", F.sum(F.when(F.col("kind").isin("table", "figure", "chart", "diagram"), 1).otherwise(0)).over(w))


def cuts(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of pieces that make up chunks, from the running total of their sizes.

    A chunk reaches as far as the target allows, or one new piece. The next one starts with the last whole pieces of at
    most `overlap`, one at least and never all of them; without overlap, and after a piece that fills the target alone,
    it starts afresh.
    """
    total = [0, *accumulate(sizes)]
    out: list[tuple[int, int]] = []
    start = new = 0  # where the chunk starts, and its first piece that no chunk has yet
    while new < len(sizes):
        alone = start == new and sizes[new] >= target
        end = new + 1 if alone else max(new + 1, bisect_right(total, total[start] + target) - 1)
        out.append((start, end))
        tail = end if alone or overlap <= 0 else min(end - 1, bisect_left(total, total[end] - overlap))
        start, new = (end - 1 if tail <= start else tail) if tail < end else end, end
    return out


def pack_sentences(pieces: list[tuple[str, str]], target: int = 384, overlap: int = 64) -> list[tuple[str, list[str], int]]:
    """(body, element ids, tokens) of chunks from (sentence, element id) pieces; see cuts()."""
    counts = [len(PIECES.findall(s)) for s, _ in pieces]  # no piece crosses the space between sentences
    chunks = []
    for a, b in cuts([math.floor(n * SUBWORD_FACTOR) for n in counts], target, overlap):
        body = " ".join(s for s, _ in pieces[a:b])
        chunks.append((body, list(dict.fromkeys(e for _, e in pieces[a:b])), math.floor(sum(counts[a:b]) * SUBWORD_FACTOR)))
    return chunks


def pack_prose(elements: DataFrame, target: int = 384, overlap: int = 64) -> DataFrame:
    """doc_id, page, run, ordinal, body, element_ids, token_count. elements: doc_id, page, run, reading_order, element_id, body; a run is one page's at most.

    Runs are sorted into streams, as a call for each costs more than packing it. Tasks are as many as shuffle partitions,
    so that what one sorts does not grow by merging small ones.
    """
    if overlap >= target:
        raise ValueError("overlap must be below the target")
    kind = elements.schema["doc_id"].dataType.simpleString()
    keys = ["doc_id", "page", "run"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32()]

    def pack(batches):
        key, pieces, rows, runs, id_type = None, [], [], 0, None

        def sent():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *types], strict=True)], [*keys, "ordinal", "body", "element_ids", "token_count"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for *own, element, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    rows += [(*key, k, *c) for k, c in enumerate(pack_sentences(pieces, target, overlap))] if key else []
                    key, pieces, runs = own, [], runs + 1
                    if runs >= RUNS and rows:
                        yield sent()
                        rows, runs = [], 0
                pieces += [(s, element) for s in split_sentences(body)]
        rows += [(*key, k, *c) for k, c in enumerate(pack_sentences(pieces, target, overlap))] if key else []
        if rows:
            yield sent()

    source = elements.select("doc_id", F.col("page").cast("int"), F.col("run").cast("long"), F.col("reading_order").cast("int"), F.col("element_id").cast("string"), "body")
    parts = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("reading_order").asc_nulls_last(), F.col("element_id").asc_nulls_last()).select(*keys, "element_id", "body")
    return ordered.mapInArrow(pack, f"doc_id {kind}, page int, run long, ordinal int, body string, element_ids array<string>, token_count int")


def split_table(caption: str, columns: list[str], rows: list[list[str | None]], limit: int = 1024) -> list[tuple[int | None, str]]:
    """(part, text) of a table: whole if it fits, else rows in batches under a repeated header; a batch has one row at least.

    Tokens don't cross lines, so a batch's pieces are the sum of its lines' pieces.
    """

    def line(cells: list[str | None]) -> str:
        return "| " + " | ".join((c or "").replace("|", "\\|").replace("\n", " ") for c in cells) + " |"

    head = [*([caption] if caption else []), line(columns), line(["---"] * len(columns))]
    lines = [line(r) for r in rows]
    fixed = sum(len(PIECES.findall(x)) for x in head)
    total = [0, *accumulate(len(PIECES.findall(x)) for x in lines)]
    room = next(k for k in range(int((limit + 1) / SUBWORD_FACTOR) + 1, -1, -1) if math.floor(k * SUBWORD_FACTOR) <= limit) - fixed
    bounds = [0]
    while bounds[-1] < len(lines):
        bounds.append(max(bounds[-1] + 1, bisect_right(total, total[bounds[-1]] + room) - 1))
    if len(bounds) <= 2:
        return [(None, "\n".join([*head, *lines]))]
    return [(k, "\n".join([*head, *lines[a:b]])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]), 1)]
