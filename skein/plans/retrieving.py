"""Named queries of retrieval by modality, indexes and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import dense, generation, indexes, methods, retrieval, understanding
from skein.plans import catalog
from skein.plans.catalog import BM25_CTE, DOC_TOKENS, LISTS_CTE, query
from skein.sources import store

# ---- retrievers and their composition


@query(LISTS_CTE + """, w AS (SELECT bm.query_id, chunk_id, CAST(row_number() OVER (PARTITION BY bm.query_id ORDER BY rank) AS INTEGER) AS rank FROM bm JOIN documents d ON d.doc_id = chunk_id WHERE bm.rank <= 50 AND (bm.query_id % 2 = 1 OR d.lang = 'en')),
f AS (SELECT query_id, chunk_id, sum(w / (60 + rank)) s, min(rank) best FROM (SELECT query_id, chunk_id, rank, 1.0::DOUBLE w FROM w UNION ALL SELECT query_id, chunk_id, rank, 0.5::DOUBLE FROM de WHERE rank <= 50) GROUP BY ALL)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, best, chunk_id) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, best, chunk_id) <= 10""")
def hybrid_filtered(t, spark):
    """Words and vectors, the words narrowed for every other query to English documents."""
    words = catalog.bm25_hits(t, 50).withColumn("doc_id", F.col("chunk_id"))
    english = t("documents").where("lang = 'en'").select("doc_id")
    found = words.select("query_id", "doc_id").where("query_id % 2 = 0")
    allowed = found.join(english, "doc_id").unionByName(found.select("query_id", F.lit(None).cast("long").alias("doc_id")).distinct())
    vectors = dense.dense_top_k(catalog.document_vectors(t), catalog.item_vectors(t), 50)
    return retrieval.hybrid(words, vectors, allowed, (1.0, 0.5)).select("query_id", "chunk_id", "rank")


@query(LISTS_CTE + catalog.WITHIN_SQL + f""", p1 AS (SELECT query_id, chunk_id FROM wr WHERE modality = 'text' AND mrank <= 8),
p2 AS (SELECT query_id, chunk_id FROM wr WHERE modality = 'table' AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM p1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mrank, chunk_id) <= 8),
pk AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), ch AS (SELECT ts.query_id, ts.chunk_id, rank fr FROM ts LEFT JOIN pk ON ts.query_id = pk.query_id AND ts.chunk_id = pk.chunk_id QUALIFY row_number() OVER (PARTITION BY ts.query_id ORDER BY pk.chunk_id IS NULL, rank, ts.chunk_id) <= 25),
qt AS (SELECT item_id query_id, list_distinct({DOC_TOKENS}) qt FROM benchmark), dt AS (SELECT doc_id chunk_id, list_distinct({DOC_TOKENS}) dt FROM documents),
pr AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fr, chunk_id) AS INTEGER) fused_rank FROM ch), rs AS (SELECT pr.*, round(len(list_intersect(qt, dt)) / len(qt), 6) score FROM pr JOIN qt USING (query_id) JOIN dt USING (chunk_id))
SELECT query_id, chunk_id, score, fused_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS INTEGER) AS rank FROM rs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) <= 10""")
def modality_rerank(t, spark):
    """Retrieval by modality with a balanced pool, reranked by the share of the question's words in the whole text."""
    own = catalog.lists(t)
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(text.lexical_tokens(F.col("text"))).alias("qt"))
    # Texts are split after the join: only those that a list has.
    d = t("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    both = own.select("query_id", "chunk_id").distinct().join(q, "query_id").join(d, "chunk_id").withColumn("dt", F.array_distinct(text.lexical_tokens(F.col("text"))))
    scores = both.select("query_id", "chunk_id", F.round(F.size(F.array_intersect("qt", "dt")) / F.size("qt"), 6).alias("rerank_score"))
    return retrieval.by_modality(catalog.retrievers(t), own, 10, 8, 25, scores=scores).select("query_id", "chunk_id", "score", "fused_rank", "rank")


@query(LISTS_CTE + " SELECT query_id, count(*) n, count(*) FILTER (a AND NOT b) words_only, count(*) FILTER (b AND NOT a) vectors_only, count(*) FILTER (a AND b) \"both\" FROM (SELECT l.query_id, l.chunk_id, w.chunk_id IS NOT NULL a, v.chunk_id IS NOT NULL b FROM l LEFT JOIN (SELECT query_id, chunk_id FROM sc JOIN documents d ON d.doc_id = sc.chunk_id WHERE score > 0 AND " + catalog.TABLE_DOCS + " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40) w ON w.query_id = l.query_id AND w.chunk_id = l.chunk_id LEFT JOIN (SELECT query_id, chunk_id FROM ds WHERE " + catalog.TABLE_DOCS + " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40) v ON v.query_id = l.query_id AND v.chunk_id = l.chunk_id WHERE retriever = 'table') GROUP BY 1")
def table_view_diagnostics(t, spark):
    tables = catalog.table_docs(t("documents")).select(F.col("doc_id").alias("chunk_id"))
    both = retrieval.two_views(catalog.bm25_hits(t, 40, tables), dense.dense_top_k(catalog.table_docs(catalog.document_vectors(t)), catalog.item_vectors(t), 40), 20)
    return retrieval.view_diagnostics(both)


@query(LISTS_CTE + " SELECT retriever, modality, count(DISTINCT query_id) n_queries, count(*) n_hits, round(count(*) / count(DISTINCT query_id), 6) mean_hits FROM l GROUP BY ALL")
def retriever_summary(t, spark):
    return retrieval.summary(catalog.lists(t)).drop("top_score")


@query(LISTS_CTE + " SELECT query_id, retriever, count(*) n FROM l WHERE query_id % 3 > 0 AND (modality = 'text' OR query_id % 3 = 2) GROUP BY ALL")
def routed_lists(t, spark):
    """Lists of the modalities that each query was routed to."""
    q = t("benchmark").select(F.col("item_id").alias("query_id"))
    routed = q.select("query_id", F.when(F.col("query_id") % 3 == 2, F.array(F.lit("text"), F.lit("table"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("text"))).otherwise(F.array().cast("array<string>")).alias("modalities"))
    return retrieval.retrieve(catalog.retrievers(t), q, {"bm25": 30, "dense": 30, "table": 20}, routed).groupBy("query_id", "retriever").agg(F.count("*").alias("n"))


_TYPE = "CASE {0} % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'chart' ELSE 'paragraph' END"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text' END chunk_type, CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'image' ELSE 'text' END modality FROM documents")
def chunk_types(t, spark):
    kind = retrieval.chunk_type_for(F.expr(_TYPE.format("doc_id")))
    return t("documents").select("doc_id", kind.alias("chunk_type"), retrieval.modality_of(kind).alias("modality"))


@query(BM25_CTE + " SELECT query_id, CASE WHEN chunk_id % 10 = 9 THEN NULL WHEN chunk_id % 3 = 0 THEN 'table' WHEN chunk_id % 3 = 1 THEN 'image' ELSE 'text' END modality, count(*) FILTER (chunk_id % 10 <> 9) returned, count(*) FILTER (chunk_id % 10 = 9) missing FROM bm WHERE rank <= 10 GROUP BY ALL")
def modality_counts(t, spark):
    chunks = t("documents").where("doc_id % 10 <> 9").select(F.col("doc_id").alias("chunk_id"), retrieval.chunk_type_for(F.expr(_TYPE.format("doc_id"))).alias("chunk_type"))
    return retrieval.modality_counts(catalog.bm25_hits(t), chunks)


@query(BM25_CTE + " SELECT query_id, count(*) FILTER (chunk_id % 10 = 9) missing FROM bm WHERE rank <= 10 GROUP BY 1")
def missing_chunks(t, spark):
    chunks = t("documents").where("doc_id % 10 <> 9").select(F.col("doc_id").alias("chunk_id"), "lang")
    return retrieval.with_chunks(catalog.bm25_hits(t), chunks)[1]


@query("SELECT doc_id chunk_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id + 1) THEN d.doc_id + 1 WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN d.doc_id END element_id FROM documents d")
def source_elements(t, spark):
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), F.array(F.lit(-1).cast("long"), F.col("doc_id") + 1, F.col("doc_id")).alias("element_ids"))
    return retrieval.source_element(chunks, t("labels").select(F.col("doc_id").alias("element_id")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 7, 20)")
def page_candidates(t, spark):
    own = t("orders").select(F.col("o_orderstatus").alias("doc_id"), F.col("o_custkey").alias("page_number"), "o_orderkey")
    return retrieval.page_candidates(own, ["F", "P"], [1, 7, 20]).select("o_orderkey", F.col("page_number").alias("o_custkey"))


@query("SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Lead line' END, concat('Columns: ', p_brand, ', ', p_type), CASE WHEN p_size % 2 = 0 THEN 'Table type: financial' END, concat(p_size, ' rows by 2 columns'), CASE WHEN p_size > 25 THEN concat('Section: ', p_type) END) AS view FROM part")
def table_schema_views(t, spark):
    p = F.col("p_partkey")
    view = retrieval.table_schema_view(F.when(p % 2 == 0, F.col("p_name")).otherwise(" "), F.lit("| a |\n\n Lead line \n| b |"), F.array(F.col("p_brand"), F.lit(" "), F.lit(None), F.col("p_type")), F.when(F.col("p_size") % 2 == 0, "financial").otherwise("unknown"), F.col("p_size"), F.lit(2), F.when(F.col("p_size") > 25, F.col("p_type")))
    return t("part").select("p_partkey", view.alias("view"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN trim(text) ELSE trim(concat(lang, 'x')) END) AS view, doc_id % 2 = 0 AND trim(text) = '' IS FALSE OR doc_id % 2 = 1 has_text FROM documents".replace("doc_id % 2 = 0 AND trim(text) = '' IS FALSE OR doc_id % 2 = 1 has_text", "(doc_id % 2 = 1 OR trim(text) <> '') has_text"))
def figure_views(t, spark):
    own = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(" "), "text")).otherwise(F.concat("lang", F.lit("x")))
    header = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("none")
    return t("documents").select("doc_id", F.sha2(retrieval.figure_text_view(own, header), 256).alias("view"), retrieval.has_figure_text(own, header).alias("has_text"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, ',') terms FROM (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(concat_ws(' ', replace(p_name, '_', ' '), 'The Annual report-of x1 ab', p_brand), '[A-Za-z][A-Za-z0-9\\-]+'), lambda x: lower(x)), lambda x: len(x) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in understanding.STOPWORDS) + "], x)) l, list_filter(l, lambda x, i: list_position(l, x) = i) list_distinct_ordered FROM part)")
def metadata_terms(t, spark):
    return t("part").select("p_partkey", F.array_join(understanding.facet_terms(F.col("p_name"), F.lit("The Annual report-of x1 ab"), F.col("p_brand")), ",").alias("terms"))


@query(catalog.METRICS_SQL + f" SELECT coalesce(lang, 'all') lang, count(*) n, {', '.join(f'round(avg({m}), 6) {m}' for m in catalog.SHOWN)} FROM (SELECT pq.*, lang FROM pq JOIN (SELECT query_id, arg_min(lang, doc_id) lang FROM gi JOIN documents USING (doc_id) GROUP BY 1) USING (query_id)) GROUP BY GROUPING SETS ((), (lang))")
def retrieval_metrics_by_lang(t, spark):
    langs = catalog.gold(t).join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("query_id").agg(F.min_by("lang", "doc_id").alias("lang"))
    from skein.operators import evaluation

    return evaluation.macro_average(catalog.per_query(t).join(langs, "query_id"), catalog.SHOWN, ["lang"]).withColumn("lang", F.coalesce("lang", F.lit("all")))


_RESOLVED = catalog.ORACLES["resolve_docs"]


@query(f"SELECT item_id query_id, coalesce(CASE WHEN item_id % 3 = 0 THEN 'src1' END, doc_ids) doc_ids FROM benchmark LEFT JOIN ({_RESOLVED}) ON query_id = item_id")
def engine_filters(t, spark):
    own = catalog.bodies(t)
    facets = own.where("length(term) >= 3").join(understanding.generic_terms(own, own), "term", "left_anti")
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(understanding.TERM), F.lit(0)), F.lower)).alias("term"))
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("src1"))).alias("doc_ids"))
    return retrieval.engine_filters(asked, understanding.resolve(q, facets)).select("query_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(BM25_CTE + ", p AS (SELECT query_id, chunk_id // 10 page, chunk_id, score FROM bm WHERE rank <= 40 QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id // 10 ORDER BY score DESC, chunk_id) = 1) SELECT query_id, page, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5")
def best_pages(t, spark):
    hits = catalog.bm25_hits(t, 40).select("query_id", "chunk_id", "score", F.lit("d").alias("doc_id"), F.expr("chunk_id div 10").alias("page"))
    return retrieval.first_by_page(hits, 5).select("query_id", "page", "chunk_id", "rank")


# ---- indexes


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'empty' WHEN vec_id % 5 = 1 THEN 'wrong_dimension' ELSE 'not_finite' END problem FROM embeddings WHERE vec_id % 5 < 3 UNION ALL SELECT vec_id, 'duplicate' FROM embeddings WHERE vec_id % 50 = 3")
def vector_problems(t, spark):
    v = F.col("vec_id")
    e = F.when(v % 5 == 0, F.array().cast("array<float>")).when(v % 5 == 1, F.slice("embedding", 1, 3)).when(v % 5 == 2, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    own = t("embeddings").select("vec_id", e.alias("embedding"))
    return indexes.vector_problems(own.unionByName(own.where("vec_id % 50 = 3")), "vec_id", "embedding", 64)


@query("SELECT vec_id chunk_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END label FROM embeddings WHERE vec_id % 2 = 0")
def vector_collection(t, spark):
    """A collection written, read back and upserted; and a missing one that is none."""
    path, own = store.workspace(spark, "vectors"), t("embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    indexes.recreate(own, path, 64)
    assert indexes.collection(spark, path + "-none") is None
    new = own.where("chunk_id % 4 = 0").withColumn("label", F.lit(-1))
    return indexes.upserted(indexes.collection(spark, path), new).select("chunk_id", "label")


@query("SELECT p_partkey, p_size % 2 = 0 AND (p_size % 3 > 0 OR p_partkey % 2 = 0) compatible FROM part")
def encoder_identities(t, spark):
    a = {"model": F.lit("m"), "dim": F.lit(64), "revision": F.lit("r1"), "commit": F.lit("")}
    b = {"model": F.when(F.col("p_size") % 2 == 0, "m").otherwise("n"), "dim": F.lit(64), "revision": F.when(F.col("p_size") % 3 > 0, "r1").when(F.col("p_partkey") % 2 == 0, F.lit(None)).otherwise("r2"), "commit": F.lit("c")}
    return t("part").select("p_partkey", indexes.compatible_identity(a, b).alias("compatible"))


_PAGES_SQL = "WITH p AS (SELECT label doc_id, vec_id // 10 page, printf('%03d-%05d', label, vec_id // 10) page_id, count(*) n FROM embeddings GROUP BY ALL)"


def _page_tokens(t) -> DataFrame:
    own = t("embeddings").groupBy(F.col("label").alias("doc_id"), F.expr("vec_id div 10").alias("page")).agg(F.collect_list("embedding").alias("vectors"))
    return own.withColumn("page_id", F.format_string("%03d-%05d", "doc_id", "page"))


@query(_PAGES_SQL + " SELECT page_id, CAST(sum(n) OVER (ORDER BY doc_id, page_id) - n AS BIGINT) AS first, n n_tokens FROM p")
def page_index(t, spark):
    return indexes.page_index(_page_tokens(t), 64)[0].select("page_id", "first", "n_tokens")


@query(_PAGES_SQL + " SELECT count(*) pages, sum(n)::BIGINT tokens, min(n) least, quantile_cont(n, 0.5) middle, max(n) most FROM p")
def page_index_figures(t, spark):
    return indexes.page_index(_page_tokens(t), 64)[1]


@query("SELECT 'dim' problem, '64 instead of 128' detail UNION ALL SELECT 'document_changed', source FROM documents WHERE lang = 'fr' GROUP BY source UNION ALL SELECT DISTINCT 'page_missing', concat(source, '#p', doc_id % 5) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = d.source AND x.doc_id % 5 = d.doc_id % 5 AND x.lang = 'fr')")
def index_problems(t, spark):
    own = t("documents").select(F.col("source").alias("doc_id"), (F.col("doc_id") % 5).alias("page"), "lang")
    pages = own.where("lang = 'fr'").select(F.format_string("%s#p%d", "doc_id", "page").alias("page_id"), "doc_id", "page", F.lit("old").alias("doc_sha256")).distinct()
    pins = own.select("doc_id", F.lit("new").alias("sha256")).distinct()
    return indexes.index_problems(pages, {"kind": "pages", "dim": 64, "revision": None, "complete": True}, {"kind": "pages", "dim": 128, "revision": "r"}, pins, own)


@query("SELECT doc_id page_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1 AND toxic = 0)")
def pages_to_encode(t, spark):
    wanted = t("documents").select(F.col("doc_id").alias("page_id"), F.sha2("text", 256).alias("image_sha256"))
    done = t("labels").join(wanted, F.col("doc_id") == F.col("page_id")).select("page_id", F.when(F.col("toxic") == 0, F.col("image_sha256")).otherwise("old").alias("image_sha256"), F.when(F.col("quality") == 1, "m1").otherwise("m0").alias("identity"))
    return indexes.to_encode(wanted, done, "m1").select("page_id")


@query(f"SELECT item_id query_id, CASE WHEN item_id % 2 = 0 THEN item_id::DOUBLE ELSE len({DOC_TOKENS})::DOUBLE END AS first FROM benchmark")
def query_vector_lookup(t, spark):
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    q = q.withColumn("query", F.concat("query", F.lit(" #"), "query_id"))
    cache = q.where("query_id % 2 = 0").select(F.sha2("query", 256).alias("query_sha256"), F.lit("m").alias("identity"), F.array(F.col("query_id").cast("double")).alias("vector"))

    def encode(new: DataFrame) -> DataFrame:
        return new.select("query_sha256", F.array((F.size(text.lexical_tokens(F.regexp_replace("query", " #[0-9]+$", "")))).cast("double")).alias("vector"))

    return indexes.query_vectors(q, cache, "m", encode).select("query_id", F.col("query_vec")[0].alias("first"))


@query("SELECT 'text' AS name, count(*) n_chunks, count(*) n_indexed, true complete FROM documents WHERE doc_id % 3 = 2 UNION ALL SELECT 'table', count(*), count(*) FILTER (lang = 'en'), count(*) = count(*) FILTER (lang = 'en') FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'figure', count(*), 0, count(*) = 0 FROM documents WHERE doc_id % 3 = 1 AND n_chars > 1500 UNION ALL SELECT 'figure_image', count(*), 0, count(*) = 0 FROM documents WHERE doc_id % 3 = 1 AND doc_id % 2 = 0")
def index_coverage(t, spark):
    own = t("documents").select(F.col("doc_id").alias("chunk_id"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text' END").alias("chunk_type"), (F.col("n_chars") > 1500).alias("has_text"), F.when(F.col("doc_id") % 2 == 0, "p").alias("image_path"), "lang")
    return indexes.coverage(own, {"text": own, "table": own.where("lang = 'en'")})


# ---- generation

_SOURCES_SQL = BM25_CTE + """, so AS (SELECT query_id, rank, chunk_id, d.source, doc_id % 3 page, CASE WHEN lang = 'en' THEN NULL ELSE lang END section, text FROM bm JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5),
g AS (SELECT *, concat('[', rank, '] ', source, ' · page ', page, ' · text', CASE WHEN section IS NOT NULL THEN concat(' · ', section) ELSE '' END, chr(10), text) AS block, min(rank) OVER (PARTITION BY query_id, source, page) f FROM so)"""


def _sources(t, k: int = 5) -> DataFrame:
    docs = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("source").alias("doc_id"), (F.col("doc_id") % 3).cast("int").alias("page"), F.lit("text").alias("chunk_type"), F.when(F.col("lang") != "en", F.col("lang")).alias("section"), "text", F.lit("").alias("context_header"), F.lit(False).alias("has_caption"))
    return catalog.bm25_hits(t, k).select("query_id", "rank", "chunk_id").join(docs, "chunk_id")


@query(_SOURCES_SQL + " SELECT query_id, rank number, chunk_id, sha256(block) AS block, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, rank) AS INTEGER) display_order FROM g")
def evidence_blocks(t, spark):
    return generation.evidence_pack(_sources(t), 10**9).select("query_id", "number", "chunk_id", F.sha2("block", 256).alias("block"), "display_order")


@query(_SOURCES_SQL + ", p AS (SELECT query_id, f, string_agg(block, chr(10) || chr(10) ORDER BY rank) part, count(*) n FROM g GROUP BY 1, 2), w AS (SELECT query_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY f) sb, sum(n)::BIGINT n FROM p GROUP BY 1) SELECT item_id query_id, sha256(coalesce(sb, '(no sources retrieved)')) sources_block, coalesce(n, 0) n_sources FROM benchmark LEFT JOIN w ON query_id = item_id")
def prompt_sources(t, spark):
    questions = t("benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))
    return generation.prompts(questions, generation.evidence_pack(_sources(t), 10**9)).select("query_id", F.sha2("sources_block", 256).alias("sources_block"), "n_sources")


@query(_SOURCES_SQL + ", o AS (SELECT DISTINCT item_id query_id, concat('src', item_id % 20) source, item_id % 3 page FROM benchmark WHERE item_id % 4 > 0) SELECT g.query_id, rank number, chunk_id, CASE WHEN g.query_id % 4 > 0 THEN o.source IS NOT NULL END is_gold FROM g LEFT JOIN o ON o.query_id = g.query_id AND o.source = g.source AND o.page = g.page")
def source_refs(t, spark):
    gold = t("benchmark").where("item_id % 4 > 0").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("doc_id"), (F.col("item_id") % 3).cast("int").alias("page"))
    return generation.source_refs(generation.evidence_pack(_sources(t), 10**9), gold)


@query("SELECT conv_id * 1000 + turn query_id, CASE WHEN turn % 3 = 0 THEN 'error' ELSE 'ok' END status, CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END attempts, CASE WHEN turn % 3 = 0 THEN 'TimeoutError: late' END AS error, CASE WHEN turn % 3 > 0 THEN len(text) // 4 END prompt_tokens FROM conversations")
def generation_records(t, spark):
    """Answers of a stand-in provider, some of which fail twice."""

    def provider(prompt: str) -> tuple[str, int, int]:
        turn, _, rest = prompt.partition("|")
        if int(turn) % 3 == 0:
            raise TimeoutError("late")
        return rest[:40] + " [1]", len(rest) // 4, 10

    own = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat_ws("|", "turn", "text").alias("prompt"))
    return generation.complete(own, provider).select("query_id", "status", "attempts", "error", "prompt_tokens")


_ANSWER = "CASE n_chars % 6 WHEN 0 THEN 'Revenue rose to 22,360 units [1]. It fell later.' WHEN 1 THEN 'Both rose in 2019. [2] Nothing else.' WHEN 2 THEN 'The sources do not mention model X99.' WHEN 3 THEN 'The value was 5.1% in total [7].' WHEN 4 THEN 'I cannot answer this from the provided sources.' ELSE 'Yes. Never. The long answer holds 22360 of them [1, 2].' END"
_EXPECTED = {0: (2, 2, 1, 0.5, 1, 0, 0, False, False), 1: (2, 1, 1, 1.0, 0, 0, 0, False, True), 2: (1, 0, 0, None, 0, 0, 0, False, True), 3: (1, 1, 1, 1.0, 0, 1, 1, False, False), 4: (1, 0, 0, None, 0, 0, 0, True, True), 5: (3, 1, 1, 1.0, 0, 0, 0, False, True)}
_NAMES = ("n_sentences", "n_factual", "n_cited", "coverage", "uncited", "unresolved", "ungrounded", "refused", "passed")


def _cases(k: int) -> str:
    def shown(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    return "CASE n_chars % 6 " + " ".join(f"WHEN {c} THEN {shown(row[k])}" for c, row in _EXPECTED.items()) + " END"


@query("SELECT doc_id query_id, " + ", ".join(f"CAST({_cases(k)} AS {'DOUBLE' if n == 'coverage' else 'BOOLEAN' if n in ('refused', 'passed') else 'BIGINT'}) {n}" for k, n in enumerate(_NAMES)) + " FROM documents")
def answer_validation(t, spark):
    """Six kinds of answers against two sources, with what a reader finds."""
    own = t("documents").select(F.col("doc_id").alias("query_id"), F.expr(_ANSWER).alias("answer"))
    sources = own.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("number"), F.lit("Some 22360 units of it").alias("text")), F.struct(F.lit(2).alias("number"), F.lit("In 2019 both").alias("text")))).alias("s")).select("query_id", "s.*")
    out = generation.validation_report(own, sources)
    return out.select("query_id", *(F.col(n).cast("long").alias(n) if n not in ("coverage", "refused", "passed") else F.col(n) for n in _NAMES))


_REPLY = """CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'no json' WHEN 2 THEN '{"claims": [], "required_facts": []}' WHEN 3 THEN '{"claims": [{"text": "a", "supported_by_sources": "yes"}], "required_facts": [], "contradicts_reference": false, "declines_to_answer": false, "context_sufficient": true}'
WHEN 4 THEN '{"claims": [], "required_facts": [{"fact": "f", "covered": true}], "contradicts_reference": false, "declines_to_answer": false, "context_sufficient": true}' ELSE '```json {"claims": [], "required_facts": [], "contradicts_reference": true, "declines_to_answer": false, "context_sufficient": true} ```' END"""


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_json' WHEN 2 THEN 'missing_field' WHEN 3 THEN 'missing_field' WHEN 4 THEN CASE WHEN quality = 0 THEN 'fact_count' END ELSE CASE WHEN quality = 1 THEN 'fact_count' END END problem, CASE WHEN doc_id % 6 = 4 AND quality = 1 THEN false WHEN doc_id % 6 = 5 AND quality = 0 THEN true END contradicts FROM labels")
def verdict_parsing(t, spark):
    own = t("labels").select("doc_id", F.expr(_REPLY).alias("reply"), F.col("quality").alias("n_facts"))
    return generation.parse_verdicts(own).select("doc_id", "problem", F.col("verdict.contradicts_reference").alias("contradicts"))


@query("SELECT doc_id query_id, CASE WHEN doc_id % 3 = 2 THEN 'not_json' END problem, doc_id % 3 = 1 repaired, CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 20 END::BIGINT prompt_tokens FROM labels")
def judge_repairs(t, spark):
    """A stand-in judge whose first reply to some is broken; some are broken both times."""
    good = '{"claims": [], "required_facts": [], "contradicts_reference": false, "declines_to_answer": false, "context_sufficient": true}'

    def provider(prompt: str) -> tuple[str, int, int]:
        kind, asked = int(prompt.split("|")[0]) % 3, "no verdict" in prompt
        return (good if kind == 0 or kind == 1 and asked else "broken", 10, 5)

    own = t("labels").select(F.col("doc_id").alias("query_id"), F.concat_ws("|", "doc_id", F.lit("judge this")).alias("prompt"), F.lit(0).alias("n_facts"))
    return generation.judge(own, provider).select("query_id", "problem", "repaired", F.col("prompt_tokens").cast("long").alias("prompt_tokens"))


# ---- whole methods


@query(BM25_CTE + ", n AS (SELECT query_id, count(*) n FROM bm WHERE rank <= 3 GROUP BY 1) SELECT item_id query_id, CASE WHEN item_id % 5 = 0 THEN 'error' ELSE 'ok' END status, coalesce(n, 0) n_sources, CASE WHEN item_id % 5 > 0 THEN '1' END cited, CASE WHEN item_id % 5 = 0 OR n > 0 THEN 0 ELSE 1 END::BIGINT unresolved, item_id % 5 = 0 OR n > 0 passed FROM benchmark LEFT JOIN n ON query_id = item_id")
def answered_questions(t, spark):
    """From questions to validated answers of a stand-in provider that cites its first source and fails on some prompts."""

    def provider(prompt: str) -> tuple[str, int, int]:
        if "(fails)" in prompt:
            raise TimeoutError("late")
        return "Nothing more is known about this here [1].", len(prompt) // 4, 8

    text_ = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("item_id") % 5 == 0, " (fails)").otherwise(""))
    questions = t("benchmark").select(F.col("item_id").alias("query_id"), text_.alias("question"))
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("source").alias("doc_id"), F.lit(1).alias("page"), F.lit("text").alias("chunk_type"), F.lit("").alias("section"), "text", F.lit("").alias("context_header"), F.lit(False).alias("has_caption"))
    out = methods.answer(questions, catalog.bm25_hits(t, 3), chunks, provider, budget=10**9)
    return out.select("query_id", "status", "n_sources", F.when(F.col("status") == "ok", F.array_join(F.col("cited").cast("array<string>"), ",")).alias("cited"), F.col("unresolved").cast("long").alias("unresolved"), "passed")


_METHOD_SQL = LISTS_CTE + """, w AS (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 50), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) s, min(rank) best FROM (SELECT * FROM w UNION ALL SELECT query_id, chunk_id, rank FROM de WHERE rank <= 50) GROUP BY ALL)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, best, chunk_id) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, best, chunk_id) <= 10"""


@query(_METHOD_SQL)
def flat_method(t, spark):
    return methods.run("flat", catalog.retrievers(t), t("benchmark").select(F.col("item_id").alias("query_id"))).select("query_id", "chunk_id", "rank")


@query(catalog.MAXSIM_CTE.replace("QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) <= 10", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) <= 50") + " SELECT r.query_id, v.vec_id chunk_id, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank, v.vec_id) AS INTEGER) AS rank FROM r JOIN embeddings v ON v.vec_id // 10 = r.page_id QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank, v.vec_id) <= 10")
def pages_method(t, spark):
    """A page retriever alone, by its method."""
    e = t("embeddings")
    tokens = e.where("vec_id % 100 = 0 or vec_id % 100 = 50").select(F.expr("vec_id div 100").alias("query_id"), F.col("vec_id").alias("token_id"), F.col("embedding").alias("query_vec"))
    page = methods.page_retriever(e.select(F.expr("vec_id div 10").alias("page_id"), F.col("embedding").alias("vec")), tokens, e.select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 10").alias("page_id"), F.col("vec_id").alias("ordinal")))
    return methods.run("pages", [page], tokens.select("query_id").distinct()).select("query_id", "chunk_id", "rank")
