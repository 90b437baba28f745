"""Page layout: columns, reading order, furniture, headings, sections, element types, tables, figures, captions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import geometry as geo
from skein.functions.text import furniture_key

CAPTION = r"(?i)^\s*(figure|fig\.?|table|chart|exhibit)\s*[0-9]+"


def detect_columns(blocks: DataFrame) -> DataFrame:
    """blocks with n_columns of their page and the column each starts in.

    A page has 3 (else 2) columns if at most 15 % of its blocks straddle each gutter between them; under four blocks, 1.
    blocks: page_id, bbox.
    """
    x0, x1 = F.col("bbox.x0"), F.col("bbox.x1")

    def straddles(gutter: float) -> Column:
        return F.count_if((x0 < gutter - 0.02) & (x1 > gutter + 0.02)) <= 0.15 * F.count("*")

    pages = blocks.groupBy("page_id").agg(
        F.when(F.count("*") < 4, 1).when(straddles(1 / 3) & straddles(2 / 3), 3).when(straddles(1 / 2), 2).otherwise(1).alias("n_columns")
    )
    return blocks.join(pages, "page_id").withColumn("column", F.least(F.floor((x0 + x1) / 2 * F.col("n_columns")), F.col("n_columns") - 1).cast("int"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with reading_order from 0 in their page: column by column, top to bottom, left to right."""
    keys = geo.reading_order_keys(F.col("column"), F.col("bbox"))
    return blocks.withColumn("reading_order", (F.row_number().over(Window.partitionBy("page_id").orderBy(*keys, "block_id")) - 1).cast("int"))


def furniture(blocks: DataFrame, n_pages: Column | None = None) -> DataFrame:
    """doc_id, band, key of running heads and feet: texts in the top or bottom 8 % that recur on 30 % of the pages, three at least."""
    band = F.when(F.col("bbox.y1") <= 0.08, "header").when(F.col("bbox.y0") >= 0.92, "footer")
    keyed = blocks.withColumn("band", band).withColumn("key", furniture_key(F.col("text")))
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_id").alias("n_pages"))
    counts = keyed.where("band is not null and key is not null").groupBy("doc_id", "band", "key").agg(F.count("*").alias("n"))
    return counts.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.3))).select("doc_id", "band", "key", "n")


def body_size(blocks: DataFrame) -> DataFrame:
    """doc_id, body_size: the font size of most characters, the first seen winning ties."""
    sizes = blocks.groupBy("doc_id", "font_size").agg(F.sum(F.length("text")).alias("chars"), F.min("position").alias("first"))
    return sizes.groupBy("doc_id").agg(F.max_by("font_size", F.struct("chars", -F.col("first"))).alias("body_size"))


def heading_level(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """1, 2 or null. Long texts and those of several lines are no headings."""
    ratio = size / body
    long = (F.length(text) > 200) | (F.length(F.regexp_replace(text, "[^\n]", "")) > 1)
    return F.when(long, None).when(ratio >= 1.35, 1).when((ratio >= 1.12) | (bold & (ratio >= 1.0)), 2)


def sections(blocks: DataFrame) -> DataFrame:
    """blocks with section and subsection carried forward; a level-1 heading ends the subsection. blocks: doc_id, position, level, text."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("section", F.last(F.when(F.col("level") == 1, F.col("text")), ignorenulls=True).over(w)).withColumn("_part", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w))
    inner = Window.partitionBy("doc_id", "_part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("subsection", F.last(F.when(F.col("level") == 2, F.col("text")), ignorenulls=True).over(inner)).drop("_part")


def element_type(band: Column, level: Column, text: Column) -> Column:
    return F.when(band.isNotNull(), band).when(level == 1, "title").when(level == 2, "heading").when(text.rlike(CAPTION), "caption").otherwise("text")


def drop_inside(blocks: DataFrame, regions: DataFrame, share: float = 0.7) -> DataFrame:
    """blocks that lie in no region of their page by `share` or more: text of tables and figures is theirs."""
    r = regions.select("page_id", F.col("bbox").alias("region"))
    return blocks.join(r, (blocks["page_id"] == r["page_id"]) & (geo.contained_share(blocks["bbox"], F.col("region")) >= share), "left_anti")


def cluster_boxes(rects: DataFrame, gap: float = 0.02, least: int = 4, min_area: float = 0.01) -> DataFrame:
    """page_id, bbox, n: drawings whose boxes are within gap of each other, transitively as the boxes grow. rects: page_id, x0, y0, x1, y1."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [[*row, 1] for row in pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)]
        merged = True
        while merged:
            merged, out = False, []
            for g in groups:
                for h in out:
                    if g[0] - h[2] <= gap and h[0] - g[2] <= gap and g[1] - h[3] <= gap and h[1] - g[3] <= gap:
                        h[:] = [min(g[0], h[0]), min(g[1], h[1]), max(g[2], h[2]), max(g[3], h[3]), g[4] + h[4]]
                        merged = True
                        break
                else:
                    out.append(g)
            groups = out
        keep = [g for g in groups if g[4] >= least and (g[2] - g[0]) * (g[3] - g[1]) >= min_area]
        return pd.DataFrame([[pdf["page_id"].iloc[0], *g] for g in keep], columns=["page_id", "x0", "y0", "x1", "y1", "n"])

    kind = rects.schema["page_id"].dataType.simpleString()
    out = rects.select("page_id", "x0", "y0", "x1", "y1").groupBy("page_id").applyInPandas(page, f"page_id {kind}, x0 double, y0 double, x1 double, y1 double, n long")
    return out.select("page_id", geo.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"), "n")


def assign_captions(figures: DataFrame, texts: DataFrame, max_gap: float = 0.08) -> DataFrame:
    """page_id, figure_id, block_id, score: each figure its best caption, no block for two figures.

    Marked captions (Figure 1) score 10, below the figure 2, nearness up to 2, shared width up to 1; unmarked ones need 4.
    figures: page_id, figure_id, bbox; texts: page_id, block_id, text, bbox.
    """
    f, t = figures.select("page_id", "figure_id", F.col("bbox").alias("fb")), texts.select("page_id", "block_id", "text", F.col("bbox").alias("tb"))
    gap = geo.vertical_gap(F.col("fb"), F.col("tb"))
    marked = F.col("text").rlike(CAPTION)
    score = F.when(marked, 10.0).otherwise(0.0) + F.when(F.col("tb.y0") >= F.col("fb.y1"), 2.0).otherwise(0.0) + 2.0 * (1.0 - gap / max_gap) + geo.horizontal_overlap(F.col("fb"), F.col("tb"))
    pairs = f.join(t, "page_id").where(gap <= max_gap).withColumn("score", score).where(F.col("text").rlike(CAPTION) | (F.col("score") >= 4.0))

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, named, out = set(), set(), []
        for row in pdf.sort_values(["score", "figure_id", "block_id"], ascending=[False, True, True]).itertuples(index=False):
            if row.figure_id not in named and row.block_id not in taken:
                named.add(row.figure_id)
                taken.add(row.block_id)
                out.append(row)
        return pd.DataFrame(out, columns=pdf.columns)

    narrow = pairs.select("page_id", "figure_id", "block_id", "score")
    return narrow.groupBy("page_id").applyInPandas(page, narrow.schema)


def compact_grid(rows: list[list[str | None]]) -> list[list[str | None]]:
    """A grid with blank cells null, rows padded, sign-only columns joined to the next one, empty columns and rows dropped."""
    grid = [[(c or "").strip() or None for c in row] for row in rows]
    width = max(map(len, grid), default=0)
    grid = [row + [None] * (width - len(row)) for row in grid]
    for k in range(width - 1):
        held = [row[k] for row in grid if row[k]]
        if held and all(len(c) <= 2 and not any(ch.isalnum() for ch in c) for c in held):
            for row in grid:
                if row[k]:
                    row[k], row[k + 1] = None, row[k] + (row[k + 1] or "")
    keep = [k for k in range(width) if any(row[k] for row in grid)]
    return [kept for row in grid if any(kept := [row[k] for k in keep])]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def compacted(grids: pd.Series) -> pd.Series:
    return grids.map(lambda g: None if g is None else compact_grid([list(r) for r in g]))
