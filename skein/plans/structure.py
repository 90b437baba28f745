"""Named queries over the structure of documents: metadata, element ids and order, figures, tables, store and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import classify, geometry, metadata, text
from skein.operators import chunking, ingestion, layout, relational
from skein.plans import catalog
from skein.plans.catalog import BOX_CTE, boxes, query

SPACES = r"[\s\p{Z}]"


# ---- metadata

_PEOPLE = "concat(c_name, '; ', n_name, CASE WHEN c_custkey % 5 = 0 THEN ' & Adobe' WHEN c_custkey % 5 = 1 THEN ' and ab, ' ELSE ',x , Region' END)"


@query(rf"WITH v AS (SELECT c_custkey, {_PEOPLE} v FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, CASE WHEN regexp_matches(v, '{metadata.TOOLS}') THEN '' ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(v, '{metadata.AUTHOR_GAP}'), lambda x: trim(x)), lambda x: len(x) > 2)[1:20], '|') END authors FROM v")
def authors_parse(t, spark):
    own = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(_PEOPLE).alias("v"))
    return own.select("c_custkey", F.array_join(metadata.authors(F.col("v")), "|").alias("authors"))


_DATE = "concat('D:', CASE WHEN o_orderkey % 9 = 0 THEN 1800 ELSE 1990 + o_orderkey % 40 END, CASE WHEN o_orderkey % 4 > 0 THEN lpad(CAST(o_orderkey % 15 AS {0}), 2, '0') ELSE '' END, CASE WHEN o_orderkey % 4 > 1 THEN lpad(CAST(o_orderkey % 37 AS {0}), 2, '0') ELSE '' END)"


@query(f"""WITH v AS (SELECT o_orderkey, {_DATE.format('VARCHAR')} v FROM orders), p AS (SELECT o_orderkey, CAST(v[3:6] AS INTEGER) y, coalesce(try_cast(v[7:8] AS INTEGER), 1) m, coalesce(try_cast(v[9:10] AS INTEGER), 1) d FROM v),
c AS (SELECT o_orderkey, y, least(greatest(m, 1), 12) m, d FROM p)
SELECT o_orderkey, CASE WHEN y BETWEEN 1900 AND 2100 THEN coalesce(try_cast(printf('%04d-%02d-%02d', y, m, least(greatest(d, 1), CASE WHEN m = 2 THEN 28 ELSE 31 END)) AS DATE), make_date(y, 1, 1)) END published FROM c""")
def file_dates(t, spark):
    return t("orders").select("o_orderkey", metadata.file_date(F.expr(_DATE.format("string"))).alias("published"))


_TITLE = "concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' rev. ' WHEN p_size % 3 = 1 THEN ' v' ELSE ' no ' END, p_size, CASE WHEN p_partkey % 2 = 0 THEN concat(' ', 1990 + p_size) ELSE ' annual report' END)"


@query(rf"""WITH v AS (SELECT p_partkey, {_TITLE} title, CASE WHEN p_partkey % 4 = 0 THEN 'D:20200105' END created, CASE WHEN p_partkey % 3 = 0 THEN 'EN-us-x' WHEN p_partkey % 3 = 1 THEN ' ' END declared FROM part),
x AS (SELECT *, nullif(regexp_extract(title, '{metadata.VERSION}', 1), '') version, nullif(regexp_extract(title, '\b((?:19|20)\d{{2}})\b', 1), '') y FROM v)
SELECT p_partkey, version, CASE WHEN created IS NOT NULL THEN DATE '2020-01-05' WHEN y IS NOT NULL THEN make_date(CAST(y AS INTEGER), 1, 1) END published, coalesce(nullif(trim(left(lower(trim(declared)), 5)), ''), 'en') language,
CASE WHEN title LIKE '%annual report%' THEN 'annual_report' ELSE 'research_paper' END doc_type, concat_ws(',', 'title=manifest', CASE WHEN created IS NOT NULL THEN 'publication_date=file.created' WHEN y IS NOT NULL THEN 'publication_date=title_year' END, CASE WHEN version IS NOT NULL THEN 'version=title' END) sources FROM x""")
def document_records(t, spark):
    p = F.col("p_partkey")
    own = t("part").select("p_partkey", F.expr(_TITLE).alias("title"), F.when(p % 4 == 0, "D:20200105").alias("created"), F.when(p % 3 == 0, "EN-us-x").when(p % 3 == 1, " ").alias("declared"))
    none = F.lit(None).cast("string")
    own = own.select("p_partkey", metadata.document_record(F.col("title"), none, none, F.col("created"), none, F.lit("science"), F.col("declared")).alias("r"))
    sources = F.array_join(F.transform(F.map_entries("r.field_sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return own.select("p_partkey", "r.version", F.col("r.publication_date").alias("published"), "r.language", "r.doc_type", sources.alias("sources"))


@query("SELECT o_orderkey, least(o_custkey % 50, CASE WHEN o_orderkey % 3 > 0 THEN 20 END) pages, concat(c_name, ' (', c_mktsegment, ', ', year(o_orderdate), ')') citation, concat(c_name, ', p. ', o_custkey % 50, CASE WHEN o_orderkey % 2 = 0 THEN concat(' (', o_orderstatus, ')') ELSE '' END) label FROM orders JOIN customer ON o_custkey = c_custkey")
def document_labels(t, spark):
    own = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    page = (F.col("o_custkey") % 50).cast("int")
    return own.select(
        "o_orderkey", metadata.effective_pages(F.col("o_custkey") % 50, F.when(F.col("o_orderkey") % 3 > 0, F.lit(20).cast("long"))).alias("pages"), metadata.citation_label(F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.col("o_orderdate")).alias("citation"),
        metadata.human_label(F.col("c_name"), page, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))).alias("label"),
    )


@query(rf"WITH v AS (SELECT conv_id, turn, trim(regexp_replace(text, '^{SPACES}+|{SPACES}+$', '', 'g')) f FROM conversations) SELECT conv_id, turn, len(f) >= 40 AND len(regexp_replace(f, '{SPACES}', '', 'g')) > 0 AND len(regexp_replace(f, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 0.5 * len(regexp_replace(f, '{SPACES}', '', 'g')) meaningful FROM v")
def ocr_meaningful(t, spark):
    return t("conversations").select("conv_id", "turn", metadata.is_meaningful(F.col("text"), 40).alias("meaningful"))


# ---- ids and order


@query("SELECT conv_id doc_id, turn, printf('%s#p%d#%s%03d', conv_id::VARCHAR, turn % 3, role, row_number() OVER (PARTITION BY conv_id, turn % 3, role ORDER BY turn)) element_id, turn % 3 AS parsed_page FROM conversations")
def element_ids(t, spark):
    own = t("conversations").select(F.col("conv_id").alias("doc_id"), "turn", (F.col("turn") % 3).alias("page"), F.col("role").alias("kind"), F.col("turn").alias("position"))
    return ingestion.with_element_ids(own).select("doc_id", "turn", "element_id", ingestion.parsed_element_id(F.col("element_id"))["page"].cast("long").alias("parsed_page"))


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN turn END bo, CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN turn - 1 END co FROM conversations),
k AS (SELECT conv_id, turn, coalesce(bo::DOUBLE, co - 0.5, count(bo) OVER (PARTITION BY conv_id) + turn) s FROM e)
SELECT conv_id doc_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY s, turn) - 1 AS INTEGER) reading_order FROM k""")
def captioned_order(t, spark):
    thing = F.col("role") == "assistant"
    own = t("conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), "turn", F.col("turn").alias("element_id"), F.when(~thing, F.col("turn")).alias("block_order"), F.when(thing & (F.col("turn") % 3 != 0), F.col("turn") - 1).alias("caption_order"), F.col("turn").alias("ordinal")
    )
    return ingestion.captioned_order(own).select("doc_id", "turn", "reading_order")


@query("SELECT conv_id page_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '[\\s\\p{Z}]+', ' ', 'g')) header_text, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '[\\s\\p{Z}]+', ' ', 'g')) footer_text FROM conversations GROUP BY 1")
def page_furniture_text(t, spark):
    band = F.when(F.col("role") == "user", "header").when(F.col("role") == "assistant", "footer")
    return ingestion.page_furniture(t("conversations").select(F.col("conv_id").alias("page_id"), band.alias("band"), F.col("turn").alias("position"), "text"))


# ---- regions

_META_I = "greatest(0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0)) * greatest(0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"


def _over(a: str, b: str) -> str:
    return _META_I.format(a, b)


def _iou_sql(a: str, b: str) -> str:
    return f"{_over(a, b)} / ({_AREA.format(a)} + {_AREA.format(b)} - {_over(a, b)})"


@query(BOX_CTE + f" SELECT vec_id FROM b WHERE vec_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM b r WHERE r.label = b.label AND r.vec_id % 10 = 0 AND {_over('b', 'r')} / ({_AREA.format('b')}) >= 0.7)")
def text_outside_tables(t, spark):
    own = boxes(t)
    return layout.drop_inside(own.where("vec_id % 10 <> 0"), own.where("vec_id % 10 = 0")).select("vec_id")


@query(BOX_CTE + f" SELECT r.vec_id, round(least(1.0, coalesce(sum({_over('r', 'x')}), 0) / ({_AREA.format('any_value(r)').replace('any_value(r).x1', 'any_value(r.x1)').replace('any_value(r).x0', 'any_value(r.x0)').replace('any_value(r).y1', 'any_value(r.y1)').replace('any_value(r).y0', 'any_value(r.y0)')})), 6) coverage FROM b r LEFT JOIN b x ON x.label = r.label AND x.vec_id % 10 = 3 WHERE r.vec_id % 10 = 1 GROUP BY 1")
def region_text_coverage(t, spark):
    own = boxes(t)
    regions = own.where("vec_id % 10 = 1").select("page_id", F.col("vec_id").alias("region_id"), "bbox")
    blocks = own.where("vec_id % 10 = 3").select("page_id", "bbox", F.lit("x").alias("text"))
    return ingestion.text_coverage(regions, blocks).select(F.col("region_id").alias("vec_id"), F.round("coverage", 6).alias("coverage"))


@query(BOX_CTE + f""", ra AS (SELECT * FROM b WHERE vec_id % 10 = 1 AND {_AREA.format('b')} >= 0.01), tk AS (SELECT label, x0, x1, y0, y1 FROM ra UNION ALL SELECT label, x0, x1, y0, y1 FROM b WHERE vec_id % 10 = 4),
cl AS (SELECT * FROM b WHERE vec_id % 10 IN (2, 3) AND {_AREA.format('b')} BETWEEN 0.01 AND 0.9 AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.label = b.label AND {_iou_sql('b', 'tk')} > 0.5)
  AND least(1.0, coalesce((SELECT sum({_over('b', 'z')}) FROM b z WHERE z.label = b.label AND z.vec_id % 10 = 9), 0) / ({_AREA.format('b')})) <= 0.35)
SELECT vec_id, false is_vector FROM ra UNION ALL SELECT vec_id, true FROM cl WHERE NOT EXISTS (SELECT 1 FROM cl o WHERE o.label = cl.label AND o.vec_id < cl.vec_id AND {_iou_sql('o', 'cl')} > 0.5)""")
def figure_candidates(t, spark):
    own = boxes(t).select("vec_id", "page_id", F.col("vec_id").alias("region_id"), "bbox", F.lit("x").alias("text"))
    kind = F.col("vec_id") % 10
    return ingestion.figures(own.where(kind == 1), own.where(kind.isin(2, 3)), own.where(kind == 4), own.where(kind == 9)).select(F.col("region_id").alias("vec_id"), "is_vector")


_FIGURES = "CASE label % 5 WHEN 0 THEN 'chart' WHEN 1 THEN 'map' WHEN 2 THEN 'photo' WHEN 3 THEN 'diagram' ELSE 'unknown' END"


@query(BOX_CTE + f" SELECT vec_id, CASE label % 5 WHEN 0 THEN 'chart' WHEN 1 THEN 'diagram' WHEN 3 THEN 'diagram' ELSE 'figure' END element_type, vec_id % 3 = 0 has_derived_text, round(greatest(0, least(1, 0.4 + least(0.3, {_AREA.format('b')} * 3.0) + CASE WHEN vec_id % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN vec_id % 3 = 0 THEN 0.05 ELSE 0 END - CASE WHEN vec_id % 4 = 0 THEN 0.1 ELSE 0 END)), 6)::DOUBLE extraction_confidence FROM b")
def figure_payloads(t, spark):
    v = F.col("vec_id")
    own = boxes(t).select("vec_id", "bbox", F.expr(_FIGURES.replace("label", "page_id")).alias("figure_type"), F.when(v % 2 == 0, "c").alias("caption"), F.when(v % 3 == 0, "o").alias("ocr_text"), F.lit(None).cast("string").alias("description"), (v % 4 == 0).alias("is_vector"))
    return ingestion.figure_payload(own).select("vec_id", "element_type", "has_derived_text", "extraction_confidence")


@query(rf"""WITH r AS (SELECT conv_id, arg_min(text, turn) AS text, conv_id % 7 = 0 bad FROM conversations GROUP BY conv_id), o AS (SELECT CASE WHEN r.conv_id IS NULL THEN 'missing_image' WHEN bad THEN 'failed' WHEN trim(coalesce(text, '')) = '' THEN 'no_text'
WHEN NOT (len(trim(regexp_replace(text, '{SPACES}+', ' ', 'g'))) >= 40 AND len(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 0.5 * len(regexp_replace(text, '{SPACES}', '', 'g'))) THEN 'rejected' ELSE 'read' END o FROM (SELECT vec_id FROM embeddings) LEFT JOIN r ON conv_id = vec_id)
SELECT count(*) candidates, count(*) FILTER (o = 'missing_image') missing_image, count(*) FILTER (o = 'failed') failed, count(*) FILTER (o = 'no_text') no_text, count(*) FILTER (o = 'rejected') rejected, count(*) FILTER (o = 'read') "read" FROM o""")
def ocr_enrichment(t, spark):
    none = F.lit(None).cast("string")
    own = boxes(t).select(F.col("vec_id").alias("image_path"), "bbox", F.lit("chart").alias("figure_type"), none.alias("caption"), none.alias("ocr_text"), none.alias("description"), F.lit(False).alias("is_vector"))
    found = t("conversations").groupBy(F.col("conv_id").alias("image_path")).agg(F.min_by("text", "turn").alias("text")).withColumns({"confidence": F.lit(0.9), "error": F.when(F.col("image_path") % 7 == 0, "x")})
    return ingestion.enrich_with_ocr(own, found, 40)[1]


# ---- tables


@query("""SELECT n_regionkey k, CASE n_regionkey % 3 WHEN 0 THEN 'id,name' WHEN 1 THEN 'Key,col2' ELSE 'col1,col2' END AS columns, CASE WHEN n_regionkey % 3 = 0 THEN 1 ELSE 0 END::INTEGER header_rows,
string_agg(concat(n_nationkey, '=', CASE WHEN n_nationkey % 4 > 0 THEN n_name ELSE '-' END), ';' ORDER BY n_nationkey) AS body, count(*) FILTER (n_nationkey % 4 = 0)::INTEGER ragged FROM nation GROUP BY n_regionkey""".replace("count(*) FILTER (n_nationkey % 4 = 0)::INTEGER", "CAST(count(*) FILTER (n_nationkey % 4 = 0 AND n_nationkey <> first_key) AS INTEGER)").replace("FROM nation GROUP BY", "FROM (SELECT *, min(n_nationkey) OVER (PARTITION BY n_regionkey) + CASE WHEN n_regionkey % 3 = 0 THEN 1000 ELSE 1000 END first_key FROM nation) GROUP BY"))
def grid_headers(t, spark):
    row = F.when(F.col("n_nationkey") % 4 > 0, F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).otherwise(F.array(F.col("n_nationkey").cast("string")))
    own = t("nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]).alias("cells"))
    head = F.when(F.col("k") % 3 == 0, F.array(F.array(F.lit("id"), F.lit("name")))).otherwise(F.array(F.array(F.lit("123"), F.lit("456"))))
    own = own.withColumns({"cells": F.concat(head, "cells"), "header_names": F.when(F.col("k") % 3 == 1, F.array(F.lit("Key"), F.lit(" "), F.lit("Third")))})
    out = ingestion.with_header(own)
    # The row of numbers that stands in for a header where there is none isn't shown.
    rows = F.when(F.col("header_rows") == 1, F.col("rows")).otherwise(F.slice("rows", 2, 1000))
    return out.select("k", F.array_join("columns", ",").alias("columns"), "header_rows", F.array_join(F.transform(rows, lambda r: F.concat(r[0], F.lit("="), F.coalesce(r[1], F.lit("-")))), ";").alias("body"), "ragged")


# ---- the store


@query("SELECT doc_id, concat('{\"doc_id\":\"', doc_id, '\",\"page_number\":1,\"element_id\":\"e', doc_id, '\",\"element_type\":\"text\",\"extraction_method\":\"text\",\"extraction_confidence\":1.0', CASE WHEN lang <> 'en' THEN concat(',\"section\":\"', lang, '\"') ELSE '' END, '}') payload FROM documents")
def element_payloads(t, spark):
    d = F.col("doc_id").cast("string")
    e = {"doc_id": d, "page_number": F.lit(1), "element_id": F.concat(F.lit("e"), d), "element_type": F.lit("text"), "extraction_method": F.lit("text"), "extraction_confidence": F.lit(1.0), "section": F.when(F.col("lang") != "en", F.col("lang")).otherwise("")}
    return t("documents").select("doc_id", ingestion.structured_metadata(e).alias("payload"))


@query("SELECT doc_id chunk_id, concat('{\"chunk_id\":', doc_id, ',\"doc_id\":\"', source, '\",\"page_number\":1,\"chunk_type\":\"text\",\"variant\":\"v\",\"element_ids\":[\"', doc_id, '\"]', CASE WHEN lang <> 'de' THEN concat(',\"domain\":\"', lang, '\"') ELSE '' END, '}') payload FROM documents")
def vector_payloads(t, spark):
    own = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.lit(1).alias("page_number"), F.lit("text").alias("chunk_type"), F.lit("v").alias("variant"), F.array(F.col("doc_id").cast("string")).alias("element_ids"), F.lit("").alias("section"), F.when(F.col("lang") != "de", F.col("lang")).alias("domain"))
    return ingestion.vector_payload(own)


@query("SELECT p_partkey FROM part WHERE p_size > 10")
def active_entries(t, spark):
    return ingestion.active_entries(t("part").select("p_partkey", F.when(F.col("p_size") <= 10, F.lit(False)).alias("enabled"))).select("p_partkey")


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, 'new' FROM documents WHERE lang = 'fr' AND doc_id % 2 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND doc_id % 2 = 1")
def replace_documents(t, spark):
    own = t("documents").select("doc_id", "lang")
    new = own.where("lang = 'fr' and doc_id % 2 = 0").withColumn("lang", F.lit("new"))
    return ingestion.replace_documents({"documents": own}, {"documents": new})["documents"]


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'failed' WHEN quality = 1 THEN 'skipped' ELSE 'ingested' END status FROM documents LEFT JOIN labels USING (doc_id)")
def document_statuses(t, spark):
    entries = t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    done = t("labels").join(entries, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("sha256")).otherwise("old").alias("sha256"))
    return ingestion.document_status(entries, done, t("labels").where("toxic = 1").select("doc_id", F.lit("x").alias("error"))).select("doc_id", "status")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7")
def pages_of_document(t, spark):
    own = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_number"), "o_orderstatus")
    return ingestion.pages_of(own, 7).select(F.col("page_number").alias("o_orderkey"), "o_orderstatus")


# ---- flattening and chunks

_KIND = "CASE turn % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'caption' WHEN 2 THEN 'figure' WHEN 3 THEN 'header' ELSE 'table' END"
_FLAT_CTE = f"""WITH e AS (SELECT conv_id * 1000 + turn id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END pid, {_KIND} kind, CASE WHEN turn % 2 = 0 THEN 'c' END caption, CASE WHEN (conv_id + turn) % 3 > 0 THEN text END body, role FROM conversations),
f AS (SELECT e.*, CASE WHEN e.kind IN ('header', 'footer') THEN 'boilerplate' WHEN e.kind = 'caption' AND p.caption IS NOT NULL THEN 'redundant_caption' WHEN trim(coalesce(e.body, '')) = '' AND e.kind <> 'figure' THEN 'empty' END loss FROM e LEFT JOIN e p ON p.id = e.pid)"""


def _flattened(t) -> DataFrame:
    c, n = F.col("conv_id"), F.col("turn")
    own = t("conversations").select((c * 1000 + n).alias("element_id"), F.when(n > 0, c * 1000 + n - 1).alias("parent_id"), F.expr(_KIND).alias("kind"), F.when(n % 2 == 0, "c").alias("caption"), F.when((c + n) % 3 > 0, F.col("text")).alias("body"), "role")
    return chunking.flatten(own, keep_textless_visuals=True)


@query(_FLAT_CTE + " SELECT id element_id, loss FROM f")
def flatten_losses(t, spark):
    return _flattened(t).select("element_id", "loss")


@query(_FLAT_CTE + " SELECT role, count(*) total, count(*) FILTER (loss IS NULL) kept, count(*) FILTER (loss = 'boilerplate') skipped_boilerplate, count(*) FILTER (loss = 'redundant_caption') skipped_child, count(*) FILTER (loss = 'empty' OR (loss IS NULL AND trim(coalesce(body, '')) = '')) \"empty\", count(*) FILTER (loss IS NULL AND trim(coalesce(body, '')) = '' AND kind = 'figure') invisible_figures, count(*) FILTER (loss IS NULL AND trim(coalesce(body, '')) = '') kept_textless_visuals FROM f GROUP BY role")
def flatten_report(t, spark):
    return ingestion.flatten_report(_flattened(t), ["role"])


@query(catalog.TOKENS and f"WITH c AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text' END chunk_type, len({catalog.DOC_TOKENS}) n FROM documents) SELECT chunk_type, count(*) n, count(*) FILTER (n > 500) oversized, round(avg(n), 4) mean_tokens FROM c GROUP BY 1".replace("count(*) n,", "count(*) AS n,").replace(") n FROM documents", ") k FROM documents").replace("n > 500", "k > 500").replace("avg(n)", "avg(k)"))
def chunk_report(t, spark):
    own = t("documents").select(F.expr("CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text' END").alias("chunk_type"), F.size(text.lexical_tokens(F.col("text"))).alias("token_count"))
    return ingestion.chunk_report(own, 500)


_FIG = "doc_id % 3 = 1"


@query(f"SELECT count(DISTINCT source) n_documents, count(*) n_chunks, count(*) FILTER (doc_id % 3 = 2) n_text, count(*) FILTER (doc_id % 3 = 0) n_tables, count(*) FILTER ({_FIG}) n_figures, count(*) FILTER ({_FIG} AND doc_id % 2 = 0) n_images, count(*) FILTER ({_FIG} AND n_chars <= 1500) n_without_text, count(*) FILTER ({_FIG} AND doc_id % 2 = 1) n_without_image, count(*) FILTER ({_FIG} AND n_chars <= 1500) - count(*) FILTER ({_FIG} AND doc_id % 2 = 1) text_invisible_recoverable FROM documents")
def modality_report(t, spark):
    own = t("documents").select(F.col("source").alias("doc_id"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text' END").alias("chunk_type"), (F.col("n_chars") > 1500).alias("has_text"), F.when(F.col("doc_id") % 2 == 0, "p").alias("image_path"))
    return ingestion.modality_report(own)


@query("SELECT doc_id, n_chars > 3000 has_caption, doc_id % 2 = 0 has_ocr, false has_description FROM documents")
def figure_chunk_flags(t, spark):
    d = F.col("doc_id")
    own = t("documents").select("doc_id", F.lit(1).alias("page"), d.alias("element_id"), F.col("text").alias("body"), F.when(F.col("n_chars") > 3000, "c").alias("caption"), F.when(d % 2 == 0, "o").otherwise("").alias("ocr_text"), F.lit(None).cast("string").alias("description"), F.lit("p").alias("image_path"), F.lit("chart").alias("figure_type"))
    return ingestion.figure_chunks(own).select("doc_id", "has_caption", "has_ocr", "has_description")


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%annual%' THEN 'annual_report' WHEN p_size % 2 = 0 THEN 'datasheet' WHEN p_size % 3 = 0 THEN 'technical_manual' ELSE 'policy_report' END doc_type FROM part")
def document_types(t, spark):
    title = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " Reference Manual").when(F.col("p_size") % 3 == 0, " user guide").otherwise(""))
    return t("part").select("p_partkey", classify.document_type(title, F.lit("policy")).alias("doc_type"))


@query(BOX_CTE + " SELECT vec_id, round(greatest(0, least(x1, 0.5) - greatest(x0, 0.1)) / least(x1 - x0, 0.4), 6)::DOUBLE overlap, greatest(0, x0 - 0.5, 0.1 - x1) <= 0.02 AND greatest(0, y0 - 0.5, 0.1 - y1) <= 0.02 near, round((x0 + x1) / 2, 6) center FROM b")
def box_relations(t, spark):
    frame = geometry.box(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.5))
    b = F.col("bbox")
    return boxes(t).select("vec_id", F.round(geometry.horizontal_overlap(frame, b), 6).alias("overlap"), geometry.within_gap(frame, b, 0.02).alias("near"), F.round((b["x0"] + b["x1"]) / 2, 6).alias("center"))


@query("SELECT conv_id doc_id, turn, CAST(sum(CASE WHEN turn % 5 IN (2, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) run FROM conversations")
def prose_runs(t, spark):
    own = t("conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), "turn", F.col("turn").alias("reading_order"), F.col("turn").alias("element_id"), F.expr(_KIND).alias("kind"))
    return chunking.prose_runs(own).select("doc_id", "turn", "run")


@query("SELECT o_orderkey chunk_id, min(l_discount) confidence, count(*) FILTER (l_orderkey IS NULL) n_missing, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (l_returnflag IS NOT NULL)), ','), '') methods FROM (SELECT o_orderkey, unnest(generate_series(1, 3)) n FROM orders WHERE o_orderkey % 10 = 0) LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_discount) l_discount, min(l_returnflag) l_returnflag FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey AND l_linenumber = n GROUP BY 1")
def chunk_provenance(t, spark):
    key = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))
    box = geometry.box(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    elements = t("lineitem").groupBy(key.alias("element_id")).agg(F.min("l_discount").alias("extraction_confidence"), F.min("l_returnflag").alias("extraction_method")).withColumn("bbox", box)
    chunks = t("orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("chunk_id"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.concat_ws("-", F.col("o_orderkey"), n)).alias("element_ids"))
    return relational.chunk_provenance(chunks, elements).select("chunk_id", "confidence", "n_missing", F.array_join("methods", ",").alias("methods"))


@query("SELECT l_orderkey doc_id, l_linenumber FROM lineitem WHERE l_orderkey = 100 AND l_returnflag IN ('A', 'R') AND l_discount >= 0.02")
def element_scan(t, spark):
    own = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("reading_order"), F.col("l_linenumber").alias("element_id"), F.col("l_returnflag").alias("element_type"), F.col("l_discount").alias("extraction_confidence"))
    return relational.element_scan(own, 100, None, ["A", "R"], 0.02).select("doc_id", F.col("element_id").alias("l_linenumber"))


@query("WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 24.0 WHEN doc_id % 3 = 1 THEN 12.0 ELSE 10.0 END size, doc_id % 2 = 0 bold, n_chars, doc_id FROM documents) SELECT doc_id, CASE WHEN n_chars > 200 THEN NULL WHEN size / 10 >= 1.35 THEN 1 WHEN size / 10 >= 1.12 OR (bold AND size / 10 >= 1.0) THEN 2 END AS level FROM x")
def heading_levels(t, spark):
    d = F.col("doc_id")
    size = F.when(d % 3 == 0, 24.0).when(d % 3 == 1, 12.0).otherwise(10.0)
    return t("documents").select("doc_id", layout.heading_level(F.rpad(F.lit("x"), F.col("n_chars").cast("int"), F.lit("x")), size, d % 2 == 0, F.lit(10.0)).alias("level"))


@query(BOX_CTE + """, c AS (SELECT label, count(*) n, count(*) FILTER (x0 < 1/3 - 0.02 AND x1 > 1/3 + 0.02) a, count(*) FILTER (x0 < 2/3 - 0.02 AND x1 > 2/3 + 0.02) b, count(*) FILTER (x0 < 0.48 AND x1 > 0.52) h FROM b GROUP BY label),
k AS (SELECT label, CASE WHEN n < 4 THEN 1 WHEN a <= 0.15 * n AND b <= 0.15 * n THEN 3 WHEN h <= 0.15 * n THEN 2 ELSE 1 END n_columns FROM c)
SELECT vec_id, n_columns, CAST(least(floor((x0 + x1) / 2 * n_columns), n_columns - 1) AS INTEGER) AS "column" FROM b JOIN k USING (label)""")
def detect_columns(t, spark):
    return layout.detect_columns(boxes(t)).select("vec_id", "n_columns", "column")


@query("WITH b AS (SELECT source, doc_id % 7 size, sum(n_chars) c, min(doc_id) f FROM documents GROUP BY 1, 2) SELECT source doc_id, arg_max(size, {'c': c, 'f': -f}) body_size FROM b GROUP BY 1")
def body_sizes(t, spark):
    own = t("documents").select(F.col("source").alias("doc_id"), (F.col("doc_id") % 7).alias("font_size"), F.rpad(F.lit("x"), F.col("n_chars").cast("int"), F.lit("x")).alias("text"), F.col("doc_id").alias("position"))
    return layout.body_size(own)


@query(BOX_CTE + """, f AS (SELECT label, CASE WHEN y1 <= 0.08 THEN 'header' WHEN y0 >= 0.12 THEN 'footer' END band, concat('page ', vec_id % 40) line, vec_id % 25 page FROM (SELECT vec_id, label, y0 * 0.5 y0, y1 * 0.5 y1 FROM b)),
p AS (SELECT label, count(DISTINCT page) n_pages FROM f GROUP BY 1), c AS (SELECT label, band, regexp_replace(line, '[0-9]+', '#', 'g') AS key, count(*) n FROM f WHERE band = 'header' GROUP BY ALL)
SELECT label doc_id, band, key, n FROM c JOIN p USING (label) WHERE n >= greatest(3, floor(n_pages * 0.3))""")
def running_furniture(t, spark):
    half = F.struct(*((F.col(f"bbox.{c}") * (0.5 if c[0] == "y" else 1.0)).alias(c) for c in ("x0", "y0", "x1", "y1")))
    own = boxes(t).select(F.col("page_id").alias("doc_id"), (F.col("vec_id") % 25).alias("page_id"), half.alias("bbox"), F.concat(F.lit("page "), F.col("vec_id") % 40).alias("text"))
    return layout.furniture(own)


@query("""WITH s AS (SELECT o_custkey page_id, o_orderkey block_id, l_linenumber place, l_partkey, repeat('x', CAST(l_quantity AS INTEGER) % 7) t, round(l_tax * 100, 1) size, l_returnflag font FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY place, l_partkey, size, t) p FROM s),
z AS (SELECT block_id, size, sum(len(t)) c, min(p) f FROM u GROUP BY 1, 2), b AS (SELECT block_id, arg_max(size, {'c': c, 'f': -f}) font_size FROM z GROUP BY 1),
l AS (SELECT page_id, block_id, string_agg(t, '' ORDER BY p) AS text, arg_max(font, {'n': len(t), 'p': -p}) font_name, arg_max(p, {'n': len(t), 'p': -p}) % 2 = 0 even FROM u GROUP BY 1, 2)
SELECT page_id, block_id, text, font_size, font_name, even is_bold FROM l JOIN b USING (block_id) WHERE len(text) >= 2""")
def text_blocks(t, spark):
    from pyspark.sql import Window

    # Join, places and blocks share this partitioning; a stated number is not merged into fewer, larger tasks.
    lines = t("lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    own = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = own.select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("block_id"), "l_linenumber", "l_partkey", F.expr("repeat('x', cast(l_quantity as int) % 7)").alias("text"), F.round(F.col("l_tax") * 100, 1).alias("size"), F.col("l_returnflag").alias("font"))
    place = F.row_number().over(Window.partitionBy("block_id").orderBy("l_linenumber", "l_partkey", "size", "text"))
    own = own.withColumn("place", place).withColumn("flags", F.when(F.col("place") % 2 == 0, 16).otherwise(1))
    return ingestion.text_blocks(own)


@query("SELECT o_custkey doc_id, CAST(unnest(generate_series(1, least(count(*), 7, CASE WHEN o_custkey % 2 = 0 THEN 3 END))) AS INTEGER) page_number FROM orders GROUP BY o_custkey")
def pages_to_read(t, spark):
    own = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n_pages"))
    return ingestion.pages_to_read(own.withColumn("page_limit", F.when(F.col("doc_id") % 2 == 0, F.lit(3).cast("long"))), 7)


@query("WITH c AS (SELECT doc_id, n_chars % 5 k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'header' WHEN 1 THEN 'title' WHEN 2 THEN 'heading' WHEN 3 THEN 'caption' ELSE 'text' END kind FROM c")
def element_types(t, spark):
    k = F.col("n_chars") % 5
    words = F.when(k == 3, "Table 12: x").otherwise("Some text")
    return t("documents").select("doc_id", layout.element_type(F.when(k == 0, "header"), F.when(k == 1, 1).when(k == 2, 2), words).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - least(1.0, p_size / 100.0 * 3) - CASE WHEN p_size < 15 THEN 0.2 ELSE 0 END - CASE WHEN p_size % 3 = 0 AND p_size > 20 THEN 0.2 ELSE 0 END)) END::DOUBLE confidence FROM part".replace("SELECT p_partkey, CASE", "SELECT p_partkey, round(CASE").replace("END::DOUBLE confidence", "END::DOUBLE, 6) confidence"))
def text_confidences(t, spark):
    n = F.col("p_size")
    score = classify.text_confidence(n / 100, F.when(n % 4 == 0, 0).otherwise(n), F.when(n % 3 == 0, 0.1).otherwise(0.9))
    return t("part").select("p_partkey", F.round(score, 6).alias("confidence"))
