"""Named queries of the engine over the driver's tables and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import classify, geometry, text
from skein.operators import answering, chunking, dense, evaluation, fusion, layout, lexical, production, ranking, relational, retrieval, runs, understanding
from skein.sources import store
from skein.streaming import latency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir), spark)
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# ---- SQL that several oracles share

TOKENS = r"list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[._,][A-Za-z0-9]+)*'), lambda x: lower(x))"
DOC_TOKENS = TOKENS.format("coalesce(text, '')")
BM25_CTE = f"""
WITH d AS (SELECT doc_id, lang, {DOC_TOKENS} toks FROM documents),
s AS (SELECT count(*) n, avg(len(toks)) a FROM d),
q AS (SELECT DISTINCT item_id, unnest({DOC_TOKENS}) term FROM benchmark),
tf AS (SELECT doc_id, dl, term, count(*) tf FROM (SELECT doc_id, len(toks) dl, unnest(toks) term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM tf GROUP BY term),
sc AS (SELECT q.item_id query_id, tf.doc_id chunk_id, round(sum(ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf / (tf.tf + 1.5 * (1.0 - 0.75 + 0.75 * tf.dl / s.a))), 6) score
       FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN s GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc WHERE score > 0)"""
COSINE = "list_sum(list_transform(generate_series(1, len({0})), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE))) / (sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform({1}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"
DENSE_SELECT = f"SELECT q.vec_id query_id, v.vec_id chunk_id, round({COSINE.format('v.embedding', 'q.embedding')}, 6) score, q.label ql, v.label vl FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0"


_INDEXES: dict[tuple[str, str], lexical.LexicalIndex] = {}


def document_index(t: Tables) -> lexical.LexicalIndex:
    """The lexical index of the documents: written once for each folder and application, read by every query."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _INDEXES:
        _INDEXES[key] = lexical.build(t("documents"), "doc_id", "text", store.workspace(t.spark, "lexical"))
    return _INDEXES[key]


def bm25_hits(t: Tables, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    return lexical.search(document_index(t), t("benchmark"), k, "item_id", "text", allowed)


def dense_queries(t) -> DataFrame:
    """Every row whose id is divisible by 100 searches all rows."""
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("query_label"))


def vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


# ---- lexical and dense retrieval


@query(f"SELECT doc_id, len(t) n_tokens, len(list_distinct(t)) n_distinct FROM (SELECT doc_id, {DOC_TOKENS} t FROM documents)")
def tokenize_stats(t, spark):
    tokens = text.lexical_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, CAST(floor(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')) * 1.25) AS INTEGER) n_tokens FROM documents")
def token_count_heuristic(t, spark):
    return t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("n_tokens"))


@query(f"""WITH d AS (SELECT doc_id, {DOC_TOKENS} toks FROM documents), u AS (SELECT DISTINCT doc_id, unnest(toks) term FROM d)
SELECT term, count(*) df, round(ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)), 6) idf FROM u GROUP BY term""")
def bm25_term_stats(t, spark):
    return lexical.term_stats(document_index(t)).withColumn("idf", F.round("idf", 6))


@query(BM25_CTE + " SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10")
def bm25_top10(t, spark):
    return bm25_hits(t)


@query(BM25_CTE + " SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS INTEGER) AS rank FROM bm JOIN documents d ON d.doc_id = bm.chunk_id WHERE bm.rank <= 40 AND d.lang = 'en' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm.rank, chunk_id) <= 10")
def bm25_filtered(t, spark):
    """The over-fetching form: 4k hits first, then the filter."""
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    allowed = t("benchmark").select(F.col("item_id").alias("query_id"), F.array(F.lit("en")).alias("lang_in"))
    return understanding.apply_filter(bm25_hits(t, 40), chunks, allowed, ("lang",)).where("rank <= 10")


@query(f"SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM ({DENSE_SELECT}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")
def dense_top10(t, spark):
    return dense.dense_top_k(vectors(t), dense_queries(t), 10, exclude_self=True)


@query(f"SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM ({DENSE_SELECT}) WHERE ql = vl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")
def dense_filtered(t, spark):
    return dense.dense_top_k(vectors(t), dense_queries(t), 10, exclude_self=True, match=("label", "query_label"))


DOT = "list_sum(list_transform(generate_series(1, len({0})), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
MAXSIM_CTE = f"""WITH m AS (SELECT q.vec_id // 100 query_id, q.vec_id token_id, v.vec_id // 10 page_id, max({DOT.format('v.embedding', 'q.embedding')}) best
FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0 OR q.vec_id % 100 = 50 GROUP BY ALL),
p AS (SELECT query_id, page_id, round(sum(best), 6) score FROM m GROUP BY ALL),
r AS (SELECT query_id, page_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) <= 10)"""


def page_hits(t) -> DataFrame:
    tokens = t("embeddings").where("vec_id % 100 = 0 or vec_id % 100 = 50").select(F.expr("vec_id div 100").alias("query_id"), F.col("vec_id").alias("token_id"), F.col("embedding").alias("query_vec"))
    pages = t("embeddings").select(F.expr("vec_id div 10").alias("page_id"), F.col("embedding").alias("vec"))
    return ranking.top_k(dense.maxsim(pages, tokens, 10), 10, [F.col("score").desc(), F.col("page_id")])


@query(MAXSIM_CTE + " SELECT * FROM r")
def maxsim_pages(t, spark):
    return page_hits(t)


@query(MAXSIM_CTE + " SELECT r.query_id, v.vec_id chunk_id, r.page_id, r.score, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank, v.vec_id) AS INTEGER) AS rank FROM r JOIN embeddings v ON v.vec_id // 10 = r.page_id QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank, v.vec_id) <= 25")
def page_chunk_expand(t, spark):
    chunks = t("embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 10").alias("page_id"), F.col("vec_id").alias("ordinal"))
    return dense.expand_pages(page_hits(t), chunks, 25)


@query(BM25_CTE + " SELECT query_id, chunk_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END normalized FROM bm WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)")
def minmax_normalize(t, spark):
    return ranking.normalize_scores(bm25_hits(t)).select("query_id", "chunk_id", F.round("normalized", 6).alias("normalized"))


# ---- fusion: hybrid retrieval. The vector of document d is that of vec_id = d, the vector of an item that of vec_id =
# item_id; documents of even-numbered sources play the tables, found by both kinds of search as a modality of their own.

TABLE_DOCS = "try_cast(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 = 0"
LISTS_CTE = BM25_CTE + f""",
iv AS (SELECT b.item_id query_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
ds AS (SELECT iv.query_id, e.vec_id chunk_id, d.source, round({COSINE.format('e.embedding', 'iv.embedding')}, 6) score FROM iv CROSS JOIN embeddings e JOIN documents d ON d.doc_id = e.vec_id),
de AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM ds),
tl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) r FROM sc JOIN documents d ON d.doc_id = sc.chunk_id WHERE score > 0 AND {TABLE_DOCS} QUALIFY r <= 40
  UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) r FROM ds WHERE {TABLE_DOCS} QUALIFY r <= 40),
tm AS (SELECT query_id, chunk_id, max(1.0::DOUBLE / (60 + r)) s, count(*) n, min(r) best FROM tl GROUP BY ALL),
l AS (SELECT query_id, 'bm25' retriever, 'text' modality, chunk_id, rank FROM bm WHERE rank <= 30
UNION ALL SELECT query_id, 'dense', 'text', chunk_id, rank FROM de WHERE rank <= 30
UNION ALL SELECT query_id, 'table', 'table', chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, n DESC, best, chunk_id) AS INTEGER) AS rank FROM tm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, n DESC, best, chunk_id) <= 20)"""


def item_vectors(t: Tables) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id")).join(t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id")


def document_vectors(t: Tables) -> DataFrame:
    docs = t("documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return docs.join(t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")


def table_docs(docs: DataFrame) -> DataFrame:
    return docs.where(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as int) % 2 = 0"))


def retrievers(t: Tables) -> list[retrieval.Retriever]:
    """Text by words and by vectors, and the tables."""
    tables = table_docs(t("documents")).select(F.col("doc_id").alias("chunk_id"))

    def words(queries: DataFrame, k: int) -> DataFrame:
        return bm25_hits(t, k)

    def by_vector(queries: DataFrame, k: int) -> DataFrame:
        return dense.dense_top_k(document_vectors(t), item_vectors(t), k)

    def of_tables(queries: DataFrame, k: int) -> DataFrame:
        return retrieval.two_views(bm25_hits(t, 2 * k, tables), dense.dense_top_k(table_docs(document_vectors(t)), item_vectors(t), 2 * k), k)

    return [retrieval.Retriever("bm25", "text", words), retrieval.Retriever("dense", "text", by_vector), retrieval.Retriever("table", "table", of_tables, 0.7)]


def lists(t: Tables) -> DataFrame:
    """The ranked lists of all retrievers: 30 of words, 30 of vectors, 20 of tables; searched for once, as plans use them several times."""
    found = retrieval.retrieve(retrievers(t), t("benchmark").select(F.col("item_id").alias("query_id")), {"bm25": 30, "dense": 30, "table": 20})
    return store.kept(found, "lists")


def _rrf_sql(weights: str = "1.0", method: str = "sum", top: int = 10) -> str:
    order = "score DESC, n DESC, best, chunk_id" if method == "max" else "score DESC, best, chunk_id"
    agg = "max" if method == "max" else "sum"
    return f""", f AS (SELECT query_id, chunk_id, {agg}(w / (60.0 + rank)) raw, count(*) n, min(rank) best FROM (SELECT *, CAST({weights} AS DOUBLE) w FROM l) WHERE w <> 0 GROUP BY ALL),
g AS (SELECT query_id, chunk_id, round(raw, 12) score, n, best FROM f)
SELECT query_id, chunk_id, round(score, 9) score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS rank, n n_lists FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}) <= {top}"""


def _shown(fused: DataFrame) -> DataFrame:
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank", F.size("component_ranks").cast("long").alias("n_lists"))


@query(LISTS_CTE + _rrf_sql())
def hybrid_rrf(t, spark):
    return _shown(fusion.rrf(lists(t), top=10))


@query(LISTS_CTE + _rrf_sql(method="max"))
def rrf_max(t, spark):
    return _shown(fusion.rrf(lists(t), "max", top=10))


@query(LISTS_CTE + _rrf_sql("CASE retriever WHEN 'dense' THEN 0 WHEN 'table' THEN 0.7 ELSE 1 END"))
def rrf_weighted_zero(t, spark):
    weight = F.when(F.col("retriever") == "dense", 0.0).when(F.col("retriever") == "table", 0.7).otherwise(1.0)
    return _shown(fusion.rrf(lists(t).withColumn("weight", weight), top=10))


WITHIN_SQL = """, wi AS (SELECT query_id, modality, chunk_id, sum(1.0::DOUBLE / (60.0 + rank)) s, min(rank) best FROM l GROUP BY ALL),
wr AS (SELECT query_id, modality, chunk_id, row_number() OVER (PARTITION BY query_id, modality ORDER BY round(s, 12) DESC, best, chunk_id) mrank FROM wi),
ac AS (SELECT query_id, chunk_id, sum(CASE modality WHEN 'table' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END / (60.0 + mrank)) s, min(mrank) best, count(*) n FROM wr GROUP BY ALL),
ts AS (SELECT query_id, chunk_id, round(s, 9) score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, best, chunk_id) AS INTEGER) AS rank, n n_lists FROM ac)"""


def _two_stage(own: DataFrame, spark, top=None) -> DataFrame:
    weights = fusion.modality_weights(spark.createDataFrame([("bm25", "text", 1.0), ("dense", "text", 1.0), ("table", "table", 0.7)], "retriever string, modality string, weight double"))
    return fusion.two_stage(own, weights, top=top)


@query(LISTS_CTE + WITHIN_SQL + " SELECT * FROM ts WHERE rank <= 10")
def two_stage_fusion(t, spark):
    return _shown(_two_stage(lists(t), spark, 10))


@query(LISTS_CTE + """, c AS (SELECT query_id, chunk_id, count(DISTINCT retriever) k FROM l GROUP BY ALL), nl AS (SELECT query_id, count(DISTINCT retriever) m FROM l GROUP BY ALL)
SELECT l.query_id, l.retriever, count(*) candidates, count(*) contributed, count(*) FILTER (k = 1) found_only_by, count(*) FILTER (k = m) found_by_all FROM l JOIN c USING (query_id, chunk_id) JOIN nl USING (query_id) GROUP BY ALL""")
def fusion_diagnostics(t, spark):
    own = lists(t)
    return fusion.diagnostics(fusion.rrf(own), own)


@query(LISTS_CTE + WITHIN_SQL + """, o AS (SELECT ts.query_id, ts.chunk_id, ts.rank fr FROM ts),
p1 AS (SELECT query_id, chunk_id FROM wr WHERE modality = 'text' AND mrank <= 8),
p2 AS (SELECT query_id, chunk_id FROM wr WHERE modality = 'table' AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM p1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mrank, chunk_id) <= 8),
pk AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
ch AS (SELECT o.query_id, o.chunk_id, fr FROM o LEFT JOIN pk ON o.query_id = pk.query_id AND o.chunk_id = pk.chunk_id QUALIFY row_number() OVER (PARTITION BY o.query_id ORDER BY pk.chunk_id IS NULL, fr, o.chunk_id) <= 25)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fr, chunk_id) AS INTEGER) AS rank FROM ch""")
def balanced_pool(t, spark):
    own = lists(t)
    within = fusion.rrf(own, keys=("query_id", "modality"))
    return fusion.balanced_pool(_two_stage(own, spark), within, ["text", "table"], 8, 25)


RERANK_SQL = f""", pl AS (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 25),
qt AS (SELECT item_id query_id, list_distinct({DOC_TOKENS}) qt FROM benchmark), dt AS (SELECT doc_id chunk_id, list_distinct({TOKENS.format("left(coalesce(text, ''), 2000)")}) dt FROM documents),
rs AS (SELECT pl.query_id, pl.chunk_id, pl.rank fused_rank, round(len(list_intersect(qt, dt)) / len(qt), 6) score FROM pl JOIN qt USING (query_id) JOIN dt USING (chunk_id))
SELECT query_id, chunk_id, score, fused_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS INTEGER) AS rank FROM rs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) <= 10"""


@query(BM25_CTE + RERANK_SQL)
def rerank_stub(t, spark):
    """Reranks by the share of query tokens in a passage's first 2000 characters, in place of a cross-encoder."""
    pool = bm25_hits(t, 25).select("query_id", "chunk_id", "rank")
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(text.lexical_tokens(F.col("text"))).alias("qt"))
    d = t("documents").select(F.col("doc_id").alias("chunk_id"), F.substring("text", 1, 2000).alias("passage"))
    # Passages are split after the join: only those of the pool.
    scored = pool.join(q, "query_id").join(d, "chunk_id").withColumn("dt", F.array_distinct(text.lexical_tokens(F.col("passage"))))
    scored = scored.select("query_id", "chunk_id", "rank", F.round(F.size(F.array_intersect("qt", "dt")) / F.size("qt"), 6).alias("rerank_score"))
    return fusion.reranked(scored).select("query_id", "chunk_id", "score", "fused_rank", "rank")


# ---- query understanding

ROUTABLE = [(1, "What does Figure 3 show?"), (2, "How many rows are in Table 2?"), (3, "Why did revenue fall?"), (4, "total cost per segment on page 12"), (5, "plot of the axis, pp. 7 and p. 9"), (6, "taxes in general"), (7, "list of all 12 % values, breakdown"), (8, "Who is the author?")]
_VALUES = ", ".join(f"({k}, '{q}')" for k, q in ROUTABLE)


def _routed_sql() -> str:
    def score(signals):
        return " + ".join(f"CASE WHEN regexp_matches(q, '(?i){p}') THEN {w}::DOUBLE ELSE 0 END" for p, w in signals)

    prose = " OR ".join(f"regexp_matches(q, '(?i){p}')" for p in understanding.PROSE)
    return f"""WITH x AS (SELECT query_id, q, lower(regexp_extract(q, '{understanding.NUMBERED}', 1)) kind, {score(understanding.TABLE_SIGNALS)} ts, {score(understanding.IMAGE_SIGNALS)} ims, ({prose}) prose FROM src),
y AS (SELECT query_id, CASE WHEN kind = 'table' THEN 1.0 ELSE round(least(1.0, ts), 6) END table_score, CASE WHEN kind <> '' AND kind <> 'table' THEN 1.0 ELSE round(least(1.0, ims), 6) END image_score, prose FROM x)
SELECT query_id, table_score, image_score, concat('text', CASE WHEN table_score >= 0.5 OR (table_score < 0.5 AND image_score < 0.5 AND NOT prose) THEN ',table' ELSE '' END, CASE WHEN image_score >= 0.5 OR (table_score < 0.5 AND image_score < 0.5 AND NOT prose) THEN ',image' ELSE '' END) modalities FROM y"""


def _routed(queries: DataFrame) -> DataFrame:
    return understanding.route(queries, "q").select("query_id", "table_score", "image_score", F.concat_ws(",", "modalities").alias("modalities"))


@query(f"WITH src AS (SELECT * FROM (VALUES {_VALUES}) v(query_id, q)) " + _routed_sql().replace("WITH x AS", ", x AS", 1))
def route_questions(t, spark):
    return _routed(spark.createDataFrame(ROUTABLE, "query_id int, q string"))


@query("WITH src AS (SELECT conv_id * 1000 + turn query_id, coalesce(text, '') q FROM conversations WHERE role = 'user') " + _routed_sql().replace("WITH x AS", ", x AS", 1))
def route_conversations(t, spark):
    return _routed(t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("q")))


@query(f"SELECT query_id, array_to_string(list_transform(regexp_extract_all(q, '{understanding.PAGE}', 1), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') pages FROM (VALUES {_VALUES}) v(query_id, q) WHERE regexp_matches(q, '{understanding.PAGE}')")
def page_filter_extract(t, spark):
    q = spark.createDataFrame(ROUTABLE, "query_id int, q string")
    return q.select("query_id", F.array_join(understanding.page_filter(F.col("q")).cast("array<string>"), ",").alias("pages")).where("pages is not null")


@query("SELECT * FROM (VALUES (1, 'b,c'), (2, 'a'), (3, 'x'), (4, ''), (5, NULL)) v(id, merged)")
def filter_merge(t, spark):
    rows = [(1, ["a", "b", "c"], ["c", "b"]), (2, ["a"], None), (3, None, ["x"]), (4, ["a"], ["b"]), (5, None, None)]
    return spark.createDataFrame(rows, "id int, a array<string>, b array<string>").select("id", F.array_join(understanding.merge_filters(F.col("a"), F.col("b")), ",").alias("merged"))


BODY_SQL = r"WITH b AS (SELECT DISTINCT source doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9\-]+'), lambda x: lower(x))) term FROM documents)"


def bodies(t) -> DataFrame:
    return t("documents").select(F.col("source").alias("doc_id"), F.explode(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(understanding.TERM), F.lit(0)), F.lower)).alias("term")).distinct()


@query(BODY_SQL + ", f AS (SELECT DISTINCT doc_id, term FROM b WHERE len(term) >= 3) SELECT term, count(*) df FROM b WHERE term IN (SELECT term FROM f) GROUP BY term HAVING count(*) >= 0.5 * (SELECT count(DISTINCT doc_id) FROM b)")
def generic_terms(t, spark):
    own = bodies(t)
    return understanding.generic_terms(own.where("length(term) >= 3"), own)


@query(BODY_SQL + f""", g AS (SELECT term FROM b GROUP BY term HAVING count(*) >= 0.5 * (SELECT count(DISTINCT doc_id) FROM b)), f AS (SELECT doc_id, term FROM b WHERE len(term) >= 3 AND term NOT IN (SELECT term FROM g)),
q AS (SELECT DISTINCT item_id query_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9\\-]+'), lambda x: lower(x))) term FROM benchmark),
m AS (SELECT DISTINCT query_id, doc_id FROM q JOIN f USING (term)), n AS (SELECT count(DISTINCT doc_id) n FROM f)
SELECT query_id, array_to_string(list_sort(list(doc_id)), ',') doc_ids FROM m GROUP BY query_id HAVING count(*) <= greatest(1, (SELECT n FROM n) // 2)""")
def resolve_docs(t, spark):
    own = bodies(t)
    facets = own.where("length(term) >= 3").join(understanding.generic_terms(own, own), "term", "left_anti")
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(understanding.TERM), F.lit(0)), F.lower)).alias("term"))
    return understanding.resolve(q, facets).select("query_id", F.array_join("doc_ids", ",").alias("doc_ids"))


# ---- evaluation

GOLD_CTE = BM25_CTE + """, gold AS (SELECT b.item_id query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''),
gi AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS INTEGER) idx FROM gold),
mt AS (SELECT bm.query_id, bm.rank, bm.chunk_id, gi.idx matched FROM bm LEFT JOIN gi ON gi.query_id = bm.query_id AND gi.doc_id = bm.chunk_id WHERE bm.rank <= 10)"""


def gold(t: Tables) -> DataFrame:
    """Documents that contain an item word for word. Candidates hold the item's rarest inner token, by the lexical index; items of fewer than three tokens, few and short, are looked for in every document."""
    index = document_index(t)
    items = t("benchmark").where("text <> ''").select(F.col("item_id").alias("query_id"), F.lower("text").alias("needle"), text.lexical_tokens(F.col("text")).alias("tokens"))
    docs = t("documents").where("text is not null").select("doc_id", F.lower("text").alias("hay"))
    long, short = items.where("size(tokens) > 2"), items.where("size(tokens) <= 2")
    inner = long.select("query_id", F.explode(F.slice("tokens", 2, F.size("tokens") - 2)).alias("term")).distinct()
    rarest = inner.join(index.terms, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    meets = store.kept(rarest.join(index.postings.select("term", F.col("chunk_id").alias("doc_id")), "term").select("query_id", "doc_id"), "candidates")
    named = meets.select("doc_id").distinct()
    # Texts of other documents than candidates are neither shuffled nor sorted.
    held = docs.join(F.broadcast(named) if meets.limit(1_000_001).count() <= 1_000_000 else named, "doc_id", "left_semi")
    hits = meets.join(long.select("query_id", "needle"), "query_id").join(held, "doc_id").where(F.contains("hay", F.col("needle"))).select("query_id", "doc_id")
    if short.head(1):
        few = short.limit(1001).count() <= 1000
        pairs = docs.join(F.broadcast(short) if few else short, F.contains("hay", F.col("needle")))
        hits = hits.unionByName(pairs.select("query_id", "doc_id"))
    return ranking.ranked(hits.withColumnRenamed("doc_id", "chunk_id"), [F.col("chunk_id")]).select("query_id", F.col("chunk_id").alias("doc_id"), (F.col("rank") - 1).alias("idx"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("modality"))


def matched(t, own: DataFrame | None = None) -> DataFrame:
    hits = bm25_hits(t).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.lit(1).alias("page"), F.lit("text").alias("modality"))
    return evaluation.match_gold(hits, own if own is not None else gold(t))


@query(GOLD_CTE + " SELECT query_id, rank, chunk_id, matched FROM mt")
def gold_match(t, spark):
    return matched(t).select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "matched")


METRICS_SQL = GOLD_CTE + """, ng AS (SELECT query_id, count(*) n_gold FROM gi GROUP BY query_id),
pq AS (SELECT ng.query_id, any_value(ng.n_gold) n_gold, round(coalesce(max(CASE WHEN matched IS NOT NULL THEN 1.0::DOUBLE / rank END), 0), 6) mrr,
round(count(DISTINCT CASE WHEN rank <= 5 THEN matched END) / any_value(n_gold), 6) recall_5, round(count(DISTINCT matched) / any_value(n_gold), 6) recall_10,
CASE WHEN count(rank) > 0 THEN round(count(matched) / count(rank), 6) ELSE 0.0 END precision_10, CASE WHEN count(matched) > 0 THEN 1.0::DOUBLE ELSE 0.0 END hit_10,
round(coalesce(sum(CASE WHEN matched IS NOT NULL THEN 1 / log2(rank + 1.0) END), 0) / any_value(list_sum(list_transform(generate_series(1, least(n_gold, 10)), lambda i: 1 / log2(i + 1.0)))), 6) ndcg_10
FROM ng LEFT JOIN mt USING (query_id) GROUP BY ng.query_id)"""
SHOWN = ["mrr", "recall_5", "recall_10", "precision_10", "hit_10", "ndcg_10"]


def per_query(t) -> DataFrame:
    own = store.kept(gold(t), "gold")
    n_gold = own.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return evaluation.metrics(matched(t, own).select("query_id", "rank", "matched"), n_gold, (5, 10))


@query(METRICS_SQL + " SELECT * FROM pq")
def retrieval_metrics(t, spark):
    return per_query(t).select("query_id", "n_gold", *SHOWN)


@query(METRICS_SQL + f" SELECT CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END stratum, count(*) n, {', '.join(f'round(avg({m}), 6) {m}' for m in SHOWN)} FROM (SELECT *, CASE WHEN n_gold > 1 THEN 'several' ELSE 'single' END stratum FROM pq) GROUP BY GROUPING SETS ((), (stratum))")
def retrieval_metrics_by_stratum(t, spark):
    own = per_query(t).withColumn("stratum", F.when(F.col("n_gold") > 1, "several").otherwise("single"))
    return evaluation.macro_average(own, SHOWN, ["stratum"]).withColumn("stratum", F.coalesce("stratum", F.lit("all")))


@query("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown_document' WHEN l.quality = 1 AND d.lang <> 'en' THEN 'no_such_modality' END problem FROM labels l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL OR (l.quality = 1 AND d.lang <> 'en')")
def gold_validation(t, spark):
    docs = t("documents").select("doc_id", F.lit(1).alias("page"), F.col("lang").alias("modality"))
    wanted = t("labels").select("doc_id", F.lit(1).alias("page"), F.when(F.col("quality") == 1, F.lit("en")).alias("modality"))
    return evaluation.gold_problems(wanted, docs, docs, docs).select("doc_id", "problem")


# ---- relational


@query("""SELECT c.c_custkey doc_id, coalesce(p.n, 0) n_pages, coalesce(e.n, 0) n_elements, coalesce(e.t, 0) n_tables, coalesce(e.f, 0) n_figures, e.m mean_confidence, coalesce(e.lo, 0) n_low_confidence FROM customer c
LEFT JOIN (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1) p ON p.k = c.c_custkey
LEFT JOIN (SELECT o_custkey k, count(*) n, count(*) FILTER (l_returnflag = 'R') t, count(*) FILTER (l_returnflag = 'A') f, round(avg(l_discount), 3) m, count(*) FILTER (l_discount < 0.5) lo FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) e ON e.k = c.c_custkey""")
def corpus_stats(t, spark):
    orders = t("orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("doc_id", F.when(F.col("l_returnflag") == "R", "table").when(F.col("l_returnflag") == "A", "chart").otherwise("text").alias("element_type"), F.col("l_discount").alias("extraction_confidence"))
    return relational.corpus_stats(t("customer").select(F.col("c_custkey").alias("doc_id")), orders, lines)


@query("SELECT s.s_suppkey element_id, n.n_nationkey page_id, r.r_regionkey doc_id, n.n_name section, r.r_name title FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def provenance_join(t, spark):
    elements = t("supplier").join(t("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("element_id"), F.col("n_nationkey").alias("page_id"), F.col("n_regionkey").alias("doc_id"), F.lit(None).cast("string").alias("section"))
    pages = t("nation").select(F.col("n_nationkey").alias("page_id"), F.col("n_name").alias("section"), F.lit("").alias("image_path"))
    docs = t("region").select(F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("title"), F.lit("").alias("doc_type"), F.lit("").alias("domain"))
    return relational.element_provenance(elements, pages, docs).select("element_id", "page_id", "doc_id", "section", "title")


@query("SELECT c.conv_id * 1000 + c.turn - 1 parent_id, c.conv_id * 1000 + c.turn element_id, 1 AS ordinal FROM conversations c JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def children_selfjoin(t, spark):
    own = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("element_id"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id"), F.col("turn").alias("reading_order"))
    return relational.children(own)


@query("SELECT sha256(text) content, count(*) n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t, spark):
    return relational.duplicates(t("documents").select(F.sha2("text", 256).alias("content")), ["content"])


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def cache_misses(t, spark):
    cache = t("labels").select("doc_id", F.when(F.col("quality") == 1, "done").alias("completion"))
    return relational.cache_misses(t("documents").select("doc_id"), cache, "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, upper(source) source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, source FROM documents WHERE lang <> 'en')")
def upsert_documents(t, spark):
    base = t("documents").select("doc_id", "source", "lang")
    new = base.where("lang = 'en'").withColumn("source", F.upper("source"))
    return relational.upsert(base, new, ["doc_id"]).select("doc_id", "source")


@query("SELECT conv_id doc_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_cascade(t, spark):
    tables = {"turns": t("conversations").select(F.col("conv_id").alias("doc_id"), "turn")}
    return relational.delete_cascade(tables, t("labels").where("toxic = 1"))["turns"]


# ---- text functions


@query(r"SELECT doc_id, length(text) n_chars, length(regexp_replace(text, '[^\p{L}]', '', 'g')) n_alpha, length(text) > 0 AND length(regexp_replace(text, '[^\x{FFFD}]', '', 'g')) / length(text) < 0.1 is_usable FROM documents")
def text_quality(t, spark):
    q = t("documents").select("doc_id", text.quality(F.col("text")).alias("q"))
    return q.select("doc_id", F.col("q.n_chars").cast("long").alias("n_chars"), F.col("q.n_alpha").cast("long").alias("n_alpha"), "q.is_usable")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) flat FROM documents")
def collapse_ws(t, spark):
    return t("documents").select("doc_id", F.sha2(text.collapse_whitespace(F.col("text")), 256).alias("flat"))


def _normalized_sql() -> str:
    """The steps after the compatibility forms; the tables' texts have none to fold."""
    out = "nfc_normalize(text)"
    for sign, plain in {**text.LIGATURES, **text.PLAIN, **dict.fromkeys(text.INVISIBLE, "")}.items():
        out = f"replace({out}, chr({ord(sign)}), '{plain.replace(chr(39), chr(39) * 2)}')"
    for pattern, to in ((r"\r\n?", "chr(10)"), (r"[\x00-\x08\x0b-\x1f\x7f]", "''"), (r"([a-z])-\n([a-z])", r"'\1\2'"), (r"[ \t]+\n", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''")):
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents"


@query(_normalized_sql())
def normalize_text(t, spark):
    return t("documents").select("doc_id", text.normalize(F.col("text")).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents), k AS (SELECT doc_id, trim(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g')) f FROM l)
SELECT lower(regexp_replace(f, '[0-9]+', '#', 'g')) AS key, count(*) n, count(DISTINCT doc_id) n_docs FROM k WHERE length(f) BETWEEN 2 AND 200 GROUP BY 1 HAVING count(*) >= 3""")
def mask_digits_furniture(t, spark):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("key", text.furniture_key(F.col("line"))).where("key is not null")
    return lines.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n >= 3")


@query("SELECT page_id, concat_ws(' > ', trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), CASE WHEN split_part(regexp_extract(url, '://([^/]*)', 1), '.', 1) <> trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) THEN split_part(regexp_extract(url, '://([^/]*)', 1), '.', 1) END) header FROM pages")
def context_header(t, spark):
    host = F.split_part(F.regexp_extract("url", "://([^/]*)", 1), F.lit("."), F.lit(1))
    return t("pages").select("page_id", text.context_header(F.regexp_extract("html", "<title>([^<]*)</title>", 1), host, host).alias("header"))


_ABBREVIATIONS = "[" + ", ".join(f"'{a}'" for a in text.ABBREVIATIONS) + "]"
#: A gap after a sentence becomes a mark, as RE2 looks neither back nor ahead; a piece whose forerunner ends in an abbreviation or an initial goes on with it.
SENTENCES_CTE = rf"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) para, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) pi FROM documents),
q AS (SELECT doc_id, pi, list_filter(list_transform(string_split(regexp_replace(regexp_replace(para, '^\s+|\s+$', '', 'g'), '([.!?])\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') l FROM p),
r AS (SELECT doc_id, pi, unnest(l) s, generate_subscripts(l, 1) k, l FROM q), w AS (SELECT *, CASE WHEN k > 1 THEN lower(regexp_extract(l[k - 1], '(\S+)\s*$', 1)) ELSE '' END lw FROM r),
m AS (SELECT *, list_contains({_ABBREVIATIONS}, lw) OR (len(lw) = 2 AND lw[2] = '.' AND regexp_matches(lw[1], '[\p{{L}}\p{{N}}]')) joins FROM w),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pi, k) grp FROM m)"""


@query(SENTENCES_CTE + " SELECT doc_id, CAST(grp - 1 AS INTEGER) place, string_agg(s, ' ' ORDER BY pi, k) sentence FROM g GROUP BY doc_id, grp")
def sentence_split(t, spark):
    return t("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))


@query("SELECT conv_id doc_id, turn AS position, last_value(CASE WHEN role = 'system' OR turn = 0 THEN left(text, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) section FROM conversations")
def section_carry_forward(t, spark):
    own = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.when((F.col("role") == "system") | (F.col("turn") == 0), 1).alias("level"), F.substring("text", 1, 20).alias("text"))
    return layout.sections(own).select("doc_id", "position", "section")


@query("SELECT doc_id, concat('v1#', left(sha1(concat_ws('|', CAST(doc_id AS VARCHAR), '1', concat('e', doc_id), text, '')), 16)) chunk_id FROM documents")
def chunk_ids(t, spark):
    return t("documents").select("doc_id", chunking.chunk_id(F.lit("v1"), F.col("doc_id").cast("string"), F.lit(1), F.array(F.concat(F.lit("e"), F.col("doc_id").cast("string"))), F.col("text")).alias("chunk_id"))


@query()
def chunk_pack(t, spark):
    own = t("documents").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("run"), F.posexplode(F.split("text", "\n")).alias("reading_order", "body"))
    own = own.withColumn("element_id", F.concat(F.col("doc_id").cast("string"), F.lit("#p1#text"), F.lpad(F.col("reading_order").cast("string"), 5, "0")))
    return chunking.pack_prose(own)


# ---- geometry and layout: boxes made of embedding components

BOX_CTE = """WITH b AS (SELECT vec_id, label, least(abs(embedding[1]), abs(embedding[2])) x0, greatest(abs(embedding[1]), abs(embedding[2])) + 0.05 x1, least(abs(embedding[3]), abs(embedding[4])) y0, greatest(abs(embedding[3]), abs(embedding[4])) + 0.05 y1
FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) embedding FROM embeddings))"""


def boxes(t) -> DataFrame:
    e = [F.abs(F.col("embedding")[k].cast("double")) for k in range(4)]
    box = geometry.box(F.least(e[0], e[1]), F.least(e[2], e[3]), F.greatest(e[0], e[1]) + 0.05, F.greatest(e[2], e[3]) + 0.05)
    return t("embeddings").select("vec_id", F.col("label").alias("page_id"), F.col("vec_id").alias("block_id"), box.alias("bbox"))


@query(BOX_CTE + " SELECT vec_id, round((x1 - x0) * (y1 - y0), 6) area, round(greatest(0.0, y0 - 0.1), 6) gap, x0 >= 0 AND y0 >= 0 AND x1 <= 0.3 AND y1 <= 0.3 inside FROM b")
def bbox_ops(t, spark):
    strip = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.1))
    corner = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(0.3), F.lit(0.3))
    b = F.col("bbox")
    return boxes(t).select("vec_id", F.round(geometry.area(b), 6).alias("area"), F.round(geometry.vertical_gap(strip, b), 6).alias("gap"), geometry.contains(corner, b).alias("inside"))


@query(BOX_CTE + """, f AS (SELECT * FROM b WHERE vec_id % 100 = 0), i AS (SELECT f.vec_id a_id, b.vec_id b_id, greatest(0, least(f.x1, b.x1) - greatest(f.x0, b.x0)) * greatest(0, least(f.y1, b.y1) - greatest(f.y0, b.y0)) c, (f.x1 - f.x0) * (f.y1 - f.y0) fa, (b.x1 - b.x0) * (b.y1 - b.y0) ba FROM f JOIN b ON f.label = b.label AND f.vec_id <> b.vec_id)
SELECT a_id, b_id, round(c / (fa + ba - c), 6) iou FROM i WHERE c / (fa + ba - c) > 0.5""")
def iou_pairs(t, spark):
    own = boxes(t)
    f = own.where("vec_id % 100 = 0").select("page_id", F.col("vec_id").alias("a_id"), F.col("bbox").alias("fb"))
    overlap = geometry.iou(F.col("fb"), F.col("bbox"))
    return f.join(own, "page_id").where((F.col("a_id") != F.col("vec_id")) & (overlap > 0.5)).select("a_id", F.col("vec_id").alias("b_id"), F.round(overlap, 6).alias("iou"))


@query(BOX_CTE + " SELECT vec_id, label page_id, CAST(row_number() OVER (PARTITION BY label ORDER BY CASE WHEN x0 < 0.1 THEN 0 ELSE 1 END, round_even(y0 / 0.01, 0), x0, vec_id) - 1 AS INTEGER) reading_order FROM b")
def reading_order(t, spark):
    own = boxes(t).withColumn("column", F.when(F.col("bbox.x0") < 0.1, 0).otherwise(1))
    return layout.reading_order(own).select("vec_id", "page_id", "reading_order")


@query()
def cluster_boxes(t, spark):
    own = boxes(t).select("page_id", "bbox.*").withColumn("page_id", F.xxhash64("page_id", F.round("x0", 1)))
    return layout.cluster_boxes(own).select("page_id", "n", F.round("bbox.x0", 6).alias("x0"), F.round("bbox.y1", 6).alias("y1"))


# ---- tables

GRID_SQL = "SELECT r_regionkey k, concat('| id | name |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', n_nationkey, ' | ', n_name, ' |'), chr(10) ORDER BY n_nationkey)) markdown FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"


def grids(t) -> DataFrame:
    rows = t("nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return rows.select("k", F.array(F.lit("id"), F.lit("name")).alias("columns"), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])).alias("rows"))


@query(GRID_SQL)
def table_markdown(t, spark):
    return grids(t).select("k", text.markdown_table(F.col("columns"), F.col("rows")).alias("markdown"))


@query("SELECT n_regionkey k, 1.0::DOUBLE fill, 'simple' kind, round(0.25 + 0.6 + 0.1, 6)::DOUBLE confidence FROM nation GROUP BY 1")
def table_fill(t, spark):
    fill = classify.fill_ratio(F.col("rows"))
    confidence = classify.table_confidence(fill, F.size("rows"), F.size("columns"), F.lit(True), F.lit(0))
    return grids(t).select("k", fill.alias("fill"), classify.table_type(F.col("columns"), F.col("rows")).alias("kind"), F.round(confidence, 6).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN p_retailprice IS NULL THEN 'unknown' ELSE 'financial' END kind FROM part")
def classify_table(t, spark):
    return t("part").select("p_partkey", classify.table_type(F.array(F.lit("name"), F.lit("Cost"), F.lit("size")), F.array(F.array("p_name", F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")))).alias("kind"))


# ---- answering

ANSWERS = [(1, "Both [1] and [2, 3] say so [1]."), (2, "Nothing is cited."), (3, "Source [9] is missing, [2] isn't.")]


@query("SELECT * FROM (VALUES (1, '1,2,3'), (2, ''), (3, '9,2')) v(query_id, numbers)")
def citations_parse(t, spark):
    return spark.createDataFrame(ANSWERS, "query_id int, a string").select("query_id", F.array_join(text.citations(F.col("a")).cast("array<string>"), ",").alias("numbers"))


@query("SELECT * FROM (VALUES (1, 0, 1, 'c1'), (1, 1, 2, 'c2'), (1, 2, 3, NULL), (3, 0, 9, NULL), (3, 1, 2, 'c2')) v(query_id, place, number, chunk_id)")
def citation_resolve(t, spark):
    sources = spark.createDataFrame([(q, n, f"c{n}") for q in (1, 2, 3) for n in (1, 2)], "query_id int, number int, chunk_id string")
    return answering.resolve_citations(spark.createDataFrame(ANSWERS, "query_id int, answer string"), sources)


def _budget_oracle() -> str:
    return BM25_CTE + f""", c AS (SELECT query_id, rank, len({TOKENS.format("coalesce(d.text, '')")}) AS cost FROM bm JOIN documents d ON d.doc_id = bm.chunk_id WHERE rank <= 10),
f AS (SELECT query_id, list_reduce(list({{'used': cost, 'ranks': [rank], 'cost': cost}} ORDER BY rank), lambda s, x: CASE WHEN s.used + x.cost <= 1500 THEN {{'used': s.used + x.cost, 'ranks': list_concat(s.ranks, x.ranks), 'cost': s.cost}} ELSE s END).ranks r FROM c GROUP BY query_id)
SELECT query_id, unnest(r) AS rank, CAST(generate_subscripts(r, 1) AS INTEGER) number FROM f"""


@query(_budget_oracle())
def context_budget(t, spark):
    sources = bm25_hits(t).join(t("documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return answering.admit(sources.withColumn("cost", F.size(text.lexical_tokens(F.col("text")))), 1500)


@query(BM25_CTE + " SELECT query_id, string_agg(concat(left(text, 80), ' [', rank, ']'), ' ' ORDER BY rank) answer, CAST(floor(sum(len(text)) / 4) AS BIGINT) prompt_tokens FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY 1")
def echo_answers(t, spark):
    sources = bm25_hits(t, 3).join(t("documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").withColumnRenamed("rank", "number")
    return answering.echo_answer(sources)


@query(GOLD_CTE + r""", k AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.,%\-/]*'), lambda x: lower(regexp_replace(x, '^[.,]+|[.,]+$', '', 'g'))), lambda x: regexp_matches(x, '[0-9]')) toks FROM benchmark)
SELECT item_id, doc_id, len(toks) > 0 checkable, len(toks) > 0 AND len(list_filter(toks, lambda x: NOT contains(lower(text), x))) = 0 "found" FROM gold JOIN k ON item_id = query_id JOIN documents USING (doc_id)""")
def fact_lexical(t, spark):
    facts = t("benchmark").select("item_id", "text").join(gold(t).select(F.col("query_id").alias("item_id"), "doc_id"), "item_id").join(t("documents").select("doc_id", F.lower("text").alias("hay")), "doc_id")
    return evaluation.fact_coverage(facts, F.col("hay"), text.key_tokens(F.col("text"))).select("item_id", "doc_id", "checkable", "found")


# ---- production analytics


@query("SELECT event_type, count(*) n, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, round(max(value), 6) max, count(*) < 100 small_sample FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_percentiles_linear(t, spark):
    return production.distribution(t("events"), "value", ["event_type"])


@query("SELECT event_type, s[least(CAST(floor(len(s) * 0.5) AS INTEGER), len(s) - 1) + 1] median, s[least(CAST(floor(len(s) * 0.9) AS INTEGER), len(s) - 1) + 1] p90 FROM (SELECT event_type, list_sort(list(value)) s FROM events WHERE value IS NOT NULL GROUP BY 1)")
def latency_percentiles_nearest(t, spark):
    return runs.nearest_ranks(t("events"), "value", ["event_type"], {"median": 0.5, "p90": 0.9})


@query("SELECT user_id, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ROLLUP (user_id, event_type)")
def stage_rollup(t, spark):
    return t("events").rollup("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, round(coalesce(value, 0) + 2, 6) retrieval_total, value IS NOT NULL consistent FROM events")
def stage_mapping(t, spark):
    stages = F.map_filter(F.create_map(F.lit("bm25_ms"), F.col("value"), F.lit("fusion_ms"), F.lit(2.0), F.lit("total_ms"), F.col("value") + 2.0), lambda _, v: v.isNotNull())
    s = t("events").select("event_id", "value", production.canonical_stages(stages).alias("s"))
    return s.select("event_id", F.round("s.retrieval_total", 6).alias("retrieval_total"), (F.col("s.total_consistent") & F.col("value").isNotNull()).alias("consistent"))


@query("SELECT user_id, count(*) n, count(*) FILTER (event_type = 'error') error_count, count(*) error_of, round(count(*) FILTER (event_type = 'error') / count(*), 4) error_rate FROM events GROUP BY 1")
def error_rates(t, spark):
    own = t("events").select("user_id", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.lit(1).alias("attempts"), F.lit("other").alias("error_kind"))
    return production.reliability(own, ["user_id"]).select("user_id", "n", "error_count", "error_of", "error_rate")


PRICES = [("small", ["en", "de"], 0.15, 0.6), ("large", ["fr"], 2.5, 10.0)]


@query(f"SELECT doc_id, round((len({DOC_TOKENS}) * CASE WHEN lang IN ('en', 'de') THEN 0.15::DOUBLE WHEN lang = 'fr' THEN 2.5::DOUBLE END + 50 * CASE WHEN lang IN ('en', 'de') THEN 0.6::DOUBLE WHEN lang = 'fr' THEN 10.0::DOUBLE END) / 1e6, 9) cost FROM documents")
def token_cost(t, spark):
    usage = t("documents").select("doc_id", F.col("lang").alias("model"), F.size(text.lexical_tokens(F.col("text"))).alias("prompt_tokens"), F.lit(50).alias("completion_tokens"))
    prices = spark.createDataFrame(PRICES, "model string, aliases array<string>, input_per_million double, output_per_million double")
    return production.token_cost(usage, prices).select("doc_id", F.round("cost", 9).alias("cost"))


@query("""WITH r AS (SELECT user_id % 3 AS level, epoch(ts) submitted, epoch(ts) + 1 AS started, epoch(ts) + 1 + coalesce(value, 0) finished, event_type <> 'error' ok FROM events)
SELECT level, count(*) n, count(*) FILTER (ok) n_ok, round(max(finished) - min(submitted), 4) wall, round(quantile_cont(finished - started, 0.95), 4) p95 FROM r GROUP BY 1""")
def load_level_summary(t, spark):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    own = t("events").select((F.col("user_id") % 3).alias("level"), at.alias("submitted"), (at + 1).alias("started"), (at + 1 + F.coalesce("value", F.lit(0.0))).alias("finished"), (F.col("event_type") != "error").alias("ok"))
    return production.load_levels(own).select("level", "n", "n_ok", F.round("wall", 4).alias("wall"), F.round("p95", 4).alias("p95"))


@query("SELECT date_trunc('hour', ts) window_start, event_type, count(*) n, round(avg(value), 6) mean FROM events GROUP BY ALL")
def latency_windows(t, spark):
    return latency.latency_windows(t("events").withColumn("ts", F.col("ts").cast("timestamp"))).drop("p95").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) session_start, count(*) n FROM s GROUP BY user_id, k")
def event_sessions(t, spark):
    return latency.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))
