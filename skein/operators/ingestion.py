"""From extracted blocks, grids and regions to the elements of a page, with the reports that count what happened.

Decoding files is left to a reader; the inputs are tables of text blocks, table grids, figure regions and OCR results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import geometry
from skein.functions.classify import figure_confidence
from skein.functions.metadata import is_meaningful
from skein.functions.text import collapse_whitespace, normalize

VISUAL = ("figure", "chart", "diagram")
#: Limits of what counts as a figure.
PANEL_AREA, SAME_REGION, PANEL_TEXT = 0.9, 0.5, 0.35


def page_id(doc_id: Column, page: Column) -> Column:
    return F.format_string("%s#p%d", doc_id.cast("string"), page)


def with_element_ids(elements: DataFrame) -> DataFrame:
    """elements with element_id: document, page, type and the element's number among its type on the page. elements: doc_id, page, kind, position."""
    w = Window.partitionBy("doc_id", "page", "kind").orderBy("position")
    return elements.withColumn("element_id", F.format_string("%s#p%d#%s%03d", F.col("doc_id").cast("string"), F.col("page"), F.col("kind"), F.row_number().over(w)))


def parsed_element_id(element_id: Column) -> Column:
    """struct doc_id, page of an element id; null where it has another form."""
    doc, page = F.regexp_extract(element_id, r"^([^#]+)#p(\d+)#[^#]+$", 1), F.regexp_extract(element_id, r"^([^#]+)#p(\d+)#[^#]+$", 2).try_cast("int")
    return F.when(page.isNotNull(), F.struct(doc.alias("doc_id"), page.alias("page")))


def captioned_order(elements: DataFrame) -> DataFrame:
    """elements with reading_order from 0 without gaps: an object stands just before its caption, one without a caption at the end in its order.

    elements: doc_id, page, element_id, block_order (text and captions), caption_order (objects), ordinal (objects without either).
    """
    n = F.count("block_order").over(Window.partitionBy("doc_id", "page"))
    key = F.coalesce(F.col("block_order").cast("double"), F.col("caption_order") - 0.5, n + F.col("ordinal"))
    w = Window.partitionBy("doc_id", "page").orderBy("sort_key", "element_id")
    return elements.withColumn("sort_key", key).withColumn("reading_order", (F.row_number().over(w) - 1).cast("int")).drop("sort_key")


def text_coverage(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_id, region_id, coverage: the share of a region that text lies on, 1 at most. blocks: page_id, bbox, text."""
    own = blocks.where(F.trim("text") != "").select("page_id", F.col("bbox").alias("block"))
    both = regions.select("page_id", "region_id", "bbox").join(own, "page_id", "left")
    covered = F.sum(F.when(F.col("block").isNotNull(), geometry.intersection_area(F.col("bbox"), F.col("block"))).otherwise(0.0))
    size = F.max(geometry.area(F.col("bbox")))
    return both.groupBy("page_id", "region_id").agg(F.when(size > 0, F.least(F.lit(1.0), covered / size)).otherwise(0.0).alias("coverage"))


def figures(rasters: DataFrame, clusters: DataFrame, tables: DataFrame, blocks: DataFrame, min_area: float = 0.01) -> DataFrame:
    """page_id, region_id, bbox, is_vector: rasters of some size, and clusters of drawings that are no page border, no frame of a raster, no ruling of a table and no panel behind text.

    Of clusters that frame each other the first by region_id stays.
    """
    area = geometry.area(F.col("bbox"))
    big = rasters.where(area >= min_area).select("page_id", "region_id", "bbox", F.lit(False).alias("is_vector"))
    own = clusters.where((area >= min_area) & (area <= PANEL_AREA)).select("page_id", "region_id", "bbox")
    taken = big.select("page_id", F.col("bbox").alias("other")).unionByName(tables.select("page_id", F.col("bbox").alias("other")))
    framed = own.join(taken, "page_id").where(geometry.iou(F.col("bbox"), F.col("other")) > SAME_REGION).select("page_id", "region_id").distinct()
    own = own.join(framed, ["page_id", "region_id"], "left_anti")
    covered = text_coverage(own, blocks).where(F.col("coverage") > PANEL_TEXT)
    own = own.join(covered, ["page_id", "region_id"], "left_anti")
    earlier = own.select("page_id", F.col("region_id").alias("before"), F.col("bbox").alias("other"))
    twice = own.join(earlier, "page_id").where((F.col("before") < F.col("region_id")) & (geometry.iou(F.col("bbox"), F.col("other")) > SAME_REGION)).select("page_id", "region_id").distinct()
    return big.unionByName(own.join(twice, ["page_id", "region_id"], "left_anti").withColumn("is_vector", F.lit(True)))


def element_type_for(figure_type: Column) -> Column:
    """The coarse element type of a figure type."""
    return F.when(figure_type == "chart", "chart").when(figure_type.isin("diagram", "screenshot", "map"), "diagram").otherwise("figure")


def figure_payload(figures: DataFrame) -> DataFrame:
    """figures with element_type and extraction_confidence. figures: figure_type, bbox, caption, ocr_text, description, is_vector."""
    said = F.coalesce(F.trim("caption"), F.lit("")) != ""
    derived = (F.coalesce(F.col("ocr_text"), F.lit("")) != "") | (F.coalesce(F.col("description"), F.lit("")) != "")
    return figures.withColumns({"element_type": element_type_for(F.col("figure_type")), "has_derived_text": derived, "extraction_confidence": F.round(figure_confidence(geometry.area(F.col("bbox")), said, derived, F.col("is_vector")), 6)})


def enrich_with_ocr(figures: DataFrame, results: DataFrame, min_chars: int = 3) -> tuple[DataFrame, DataFrame]:
    """Figures with recovered text and the confidence it gives them, and one row of counts: candidates, missing_image, failed, no_text, rejected, read.

    results: image_path, text, confidence, error; a path that results lack has no image.
    """
    r = results.select("image_path", F.col("text").alias("raw"), "confidence", "error", F.lit(True).alias("seen"))
    text = collapse_whitespace(normalize(F.col("raw")))
    own = figures.join(r, "image_path", "left").withColumn("clean", text)
    outcome = (
        F.when(F.col("seen").isNull(), "missing_image").when(F.col("error").isNotNull(), "failed").when(F.trim(F.coalesce("raw", F.lit(""))) == "", "no_text")
        .when(~is_meaningful(F.col("clean"), min_chars), "rejected").otherwise("read")
    )
    own = own.withColumn("ocr_outcome", outcome)
    counts = own.agg(F.count("*").alias("candidates"), *(F.count_if(F.col("ocr_outcome") == n).alias(n) for n in ("missing_image", "failed", "no_text", "rejected", "read")))
    took = F.col("ocr_outcome") == "read"
    enriched = own.withColumns({"ocr_text": F.when(took, F.col("clean")).otherwise(F.col("ocr_text")), "ocr_confidence": F.when(took, F.round("confidence", 4))})
    return figure_payload(enriched.drop("raw", "confidence", "error", "seen", "clean")), counts


def page_furniture(blocks: DataFrame) -> DataFrame:
    """page_id, header_text, footer_text: the page's running text in reading order, in one line; null without any. blocks: page_id, band, position, text."""

    def joined(band: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("band") == band, F.struct("position", "text"))))
        return F.nullif(collapse_whitespace(F.array_join(F.transform(own, lambda x: x["text"]), " ")), F.lit(""))

    return blocks.groupBy("page_id").agg(joined("header").alias("header_text"), joined("footer").alias("footer_text"))


def looks_like_header(row: Column) -> Column:
    """Short cells, mostly filled and mostly no numbers."""
    filled = F.filter(row, lambda c: F.coalesce(c, F.lit("")) != "")
    words = F.filter(filled, lambda c: ~F.regexp_replace(c, "[,.]", "").rlike(r"^\p{Nd}+$"))
    n = F.size(filled)
    return (n >= F.greatest(F.lit(2.0), F.size(row) * 0.5)) & (F.size(words) >= 0.6 * n) & F.forall(filled, lambda c: F.length(c) <= 40)


def with_header(grids: DataFrame) -> DataFrame:
    """grids (cells, header_names) with columns, rows, header_rows, ragged: the first row where it reads as one, else the extractor's names if two or more, else colN."""
    first = F.col("cells")[0]
    width = F.size(first)
    places = F.sequence(F.lit(1), width)
    named = F.coalesce(F.col("header_names"), F.array().cast("array<string>"))
    own = looks_like_header(first)
    from_names = F.size(F.filter(named, lambda h: F.trim(F.coalesce(h, F.lit(""))) != "")) >= 2

    def filled(values: Column) -> Column:
        return F.transform(places, lambda k: F.coalesce(F.nullif(F.trim(F.try_element_at(values, k)), F.lit("")), F.concat(F.lit("col"), k.cast("string"))))

    body = F.when(own, F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).otherwise(F.col("cells"))
    columns = F.when(own, filled(first)).when(from_names, filled(named)).otherwise(filled(F.array().cast("array<string>")))
    padded = F.transform(body, lambda r: F.transform(places, lambda k: F.try_element_at(r, k)))
    return grids.withColumns({"columns": columns, "rows": padded, "header_rows": own.cast("int"), "ragged": F.size(F.filter(body, lambda r: F.size(r) != width))})


# ---- the corpus store


def structured_metadata(e: dict[str, Column]) -> Column:
    """JSON of what retrieval may condition on, without what is missing. e: columns by name."""
    named = ("doc_id", "page_number", "element_id", "element_type", "extraction_method", "extraction_confidence")
    maybe = ("section", "subsection", "parent_id", "table_type", "table_shape", "figure_type", "has_derived_text")
    return F.to_json(F.struct(*(e[n].alias(n) for n in named), *((F.nullif(e[n], F.lit("")) if n in ("section", "subsection", "parent_id") else e[n]).alias(n) for n in maybe if n in e)))


def vector_payload(chunks: DataFrame) -> DataFrame:
    """chunk_id, payload: the six fields that a vector carries, and section, doc_type, domain, table_type and figure_type where there are any."""
    fixed = ("chunk_id", "doc_id", "page_number", "chunk_type", "variant", "element_ids")
    more = [c for c in ("doc_type", "domain", "table_type", "figure_type") if c in chunks.columns]
    return chunks.select("chunk_id", F.to_json(F.struct(*fixed, F.nullif(F.col("section"), F.lit("")).alias("section"), *more)).alias("payload"))


def active_entries(manifest: DataFrame, doc_ids: list[str] | None = None) -> DataFrame:
    """Enabled entries, or those of some ids; ids that the manifest lacks are refused."""
    own = manifest.where(F.coalesce("enabled", F.lit(True)))
    if doc_ids is None:
        return own
    known = {r.doc_id for r in own.where(F.col("doc_id").isin(doc_ids)).select("doc_id").collect()}
    if lost := sorted(set(doc_ids) - known):
        raise ValueError(f"unknown documents: {lost}")
    return own.where(F.col("doc_id").isin(doc_ids))


def replace_documents(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables with the rows of the new documents in place of their old ones. tables, new: by name, each with doc_id; new['documents'] says which."""
    ids = new["documents"].select("doc_id").distinct()
    return {name: t.join(ids, "doc_id", "left_anti").select(*t.columns).unionByName(new[name]) if name in new else t.join(ids, "doc_id", "left_anti").select(*t.columns) for name, t in tables.items()}


def document(documents: DataFrame, doc_id) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id)


def pages_of(pages: DataFrame, doc_id) -> DataFrame:
    return pages.where(F.col("doc_id") == doc_id).orderBy("page_number")


def document_status(entries: DataFrame, done: DataFrame, failures: DataFrame) -> DataFrame:
    """doc_id, status: failed, skipped (already there with this hash) or ingested. entries: doc_id, sha256; done: doc_id, sha256; failures: doc_id, error."""
    d = done.select("doc_id", F.col("sha256").alias("have"))
    f = failures.groupBy("doc_id").agg(F.min("error").alias("error"))
    both = entries.join(d, "doc_id", "left").join(f, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("error").isNotNull(), "failed").when(F.col("have") == F.col("sha256"), "skipped").otherwise("ingested").alias("status"), "error")


# ---- reports


def flatten_report(flattened: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, kept, skipped_boilerplate, skipped_child, empty, invisible_figures, kept_textless_visuals. flattened: flatten() with kind, body, loss.

    total is skipped_boilerplate + skipped_child + kept + empty - kept_textless_visuals.
    """
    visual, blank = F.col("kind").isin(*VISUAL), F.trim(F.coalesce("body", F.lit(""))) == ""
    stays, loss = F.col("loss").isNull(), F.col("loss")
    empty = (loss == "empty") | stays & blank
    return flattened.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(stays).alias("kept"), F.count_if(loss == "boilerplate").alias("skipped_boilerplate"), F.count_if(loss == "redundant_caption").alias("skipped_child"),
        F.count_if(empty).alias("empty"), F.count_if(empty & visual).alias("invisible_figures"), F.count_if(stays & blank).alias("kept_textless_visuals"),
    )


def chunk_report(chunks: DataFrame, max_table_tokens: int = 1024) -> DataFrame:
    """chunk_type, n, oversized, mean_tokens. chunks: chunk_type, token_count."""
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if(F.col("token_count") > max_table_tokens).alias("oversized"), F.round(F.avg("token_count"), 4).alias("mean_tokens"))


def modality_report(chunks: DataFrame) -> DataFrame:
    """What an index by modality holds: n_documents, n_chunks, n_text, n_tables, n_figures, and figures with an image, without text, without an image, and found by their image alone.

    chunks: doc_id, chunk_type, has_text, image_path.
    """
    figure = F.col("chunk_type") == "figure"
    no_text, no_image = F.count_if(figure & ~F.col("has_text")), F.count_if(figure & F.col("image_path").isNull())
    return chunks.agg(
        F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_type") == "text").alias("n_text"), F.count_if(F.col("chunk_type") == "table").alias("n_tables"), F.count_if(figure).alias("n_figures"),
        F.count_if(figure & F.col("image_path").isNotNull()).alias("n_images"), no_text.alias("n_without_text"), no_image.alias("n_without_image"), (no_text - no_image).alias("text_invisible_recoverable"),
    )


def figure_chunks(elements: DataFrame) -> DataFrame:
    """One chunk per figure with where its text came from. elements: doc_id, page, element_id, body, caption, ocr_text, description, image_path, figure_type."""
    def has(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    return elements.select("doc_id", "page", F.array("element_id").alias("element_ids"), F.lit("figure").alias("chunk_type"), "body", "figure_type", has("caption").alias("has_caption"), has("ocr_text").alias("has_ocr"), has("description").alias("has_description"), "image_path")


# ---- text blocks

#: Bit of a bold font, and the least length of a block.
BOLD, LEAST_CHARS = 16, 2


def text_blocks(spans: DataFrame) -> DataFrame:
    """page_id, block_id, text, font_size, font_name, is_bold of each block: its size is that of most characters, its font that of its longest span, the first of equals.

    spans: page_id, block_id, place, text, size, font, flags. Blocks of less than LEAST_CHARS characters go.
    """
    own = spans.withColumns({"text": F.coalesce("text", F.lit("")), "size": F.round("size", 1)})
    # One grouping: each more of them, and a join of two, sorts the spans again in the same task.
    blocks = own.groupBy("page_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("place", "text", "size", "font", "flags"))).alias("spans"))
    by_size = F.array_sort(F.transform("spans", lambda x: F.struct(x["size"].alias("size"), x["place"].alias("place"), F.length(x["text"]).cast("long").alias("chars"))))

    def better(s: Column) -> Column:
        """The run of a size that ends here, where it has more characters than the best so far, or came first."""
        wins = s["best"].isNull() | (s["chars"] > s["best"]["chars"]) | ((s["chars"] == s["best"]["chars"]) & (s["first"] < s["best"]["first"]))
        return F.when(wins, F.struct(s["chars"].alias("chars"), s["first"].alias("first"), s["size"].alias("size"))).otherwise(s["best"])

    def add(s: Column, x: Column) -> Column:
        same = s["size"].eqNullSafe(x["size"]) & s["first"].isNotNull()
        best = F.when(same | s["first"].isNull(), s["best"]).otherwise(better(s))
        return F.struct(x["size"].alias("size"), F.when(same, s["chars"] + x["chars"]).otherwise(x["chars"]).alias("chars"), F.when(same, s["first"]).otherwise(x["place"]).alias("first"), best.alias("best"))

    size_kind, place_kind = (own.schema[c].dataType.simpleString() for c in ("size", "place"))
    start = F.lit(None).cast(f"struct<size:{size_kind},chars:bigint,first:{place_kind},best:struct<chars:bigint,first:{place_kind},size:{size_kind}>>")
    start = F.struct(start["size"].alias("size"), start["chars"].alias("chars"), start["first"].alias("first"), start["best"].alias("best"))
    lead = F.array_max(F.transform("spans", lambda x: F.struct(F.length(x["text"]).alias("chars"), (-x["place"]).alias("earlier"), x["font"].alias("font"), x["flags"].alias("flags"))))
    parts = blocks.select(
        "page_id", "block_id", F.array_join(F.transform("spans", lambda x: x["text"]), "").alias("text"), F.aggregate(by_size, start, add, lambda s: better(s)["size"]).alias("font_size"), lead.alias("lead")
    )
    bold = (F.coalesce("lead.flags", F.lit(0)).bitwiseAND(BOLD) != 0) | F.contains(F.lower(F.coalesce("lead.font", F.lit(""))), F.lit("bold"))
    shown = parts.withColumn("text", normalize(F.col("text"))).where(F.length("text") >= LEAST_CHARS)
    return shown.select("page_id", "block_id", "text", "font_size", F.col("lead.font").alias("font_name"), bold.alias("is_bold"))


def pages_to_read(documents: DataFrame, cap: int | None = None) -> DataFrame:
    """doc_id, page_number of what is read: up to the least of a document's pages, its own limit and the cap. documents: doc_id, n_pages, page_limit."""
    last = F.least("n_pages", "page_limit", *([F.lit(cap)] if cap is not None else []))
    return documents.where("n_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), last.cast("int"))).alias("page_number"))
