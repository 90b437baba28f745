"""What reviews found: each test failed before its finding was settled."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import blocks, chunking, dense, ingestion, lexical
from skein.plans import catalog, retrieving  # noqa: F401


def folder(spark, path, docs, items):
    """The tables that retrieval queries read; documents and items are texts by id."""
    spark.createDataFrame([(k, x, "en", f"src{k}", len(x)) for k, x in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, [1.0, float(k)], 0) for k in docs], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_reranks_by_whole_texts(spark, tmp_path):
    own = folder(spark, tmp_path, {1: "filler " * 400 + "amber lantern", 2: "amber stone"}, {1: "amber lantern"})
    rows = {r.chunk_id: (r.score, r.rank) for r in catalog.QUERIES["modality_rerank"](spark, own).collect()}
    assert rows == {1: (1.0, 1), 2: (0.5, 2)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_packed_in_streams(spark):
    rows = [(d, 1, r, k, f"e{k}", None if k == 3 else f"Line {k} of it. It ends.") for d in ("a", "b") for r in (0, 1) for k in (2, 0, 3, 1)]
    own = spark.createDataFrame(rows, "doc_id string, page int, run int, reading_order int, element_id string, body string")
    out = chunking.pack_prose(own, 16, 6)
    assert "FlatMapGroups" not in plan(out)  # a call for each run costs more than its packing
    got = {(r.doc_id, r.run, r.ordinal): (r.body, r.element_ids, r.token_count) for r in out.collect()}
    pieces = [(s, f"e{k}") for k in (0, 1, 2) for s in (f"Line {k} of it.", "It ends.")]
    want = chunking.pack_sentences(pieces, 16, 6)
    assert got == {(d, r, k): tuple(c) for d in "ab" for r in (0, 1) for k, c in enumerate(want)}
    assert all(n == chunking.count_tokens(body) for body, _, n in want)


def test_blocks_are_grouped_once(spark):
    rows = [(1, 1, 1, "ab", 9.0, "F", 0), (1, 1, 2, "cd", 10.0, "G-Bold", 0), (1, 1, 3, "e", 9.0, "F", 16), (1, 2, 2, "y", None, "F", 0), (1, 2, 1, "x", 8.04, "F", 16), (1, 3, 1, "z", 8.0, "F", 0), (1, 4, 1, None, 8.0, "F", 0), (1, 4, 2, "uv", None, None, None)]
    own = spark.createDataFrame(rows, "page_id int, block_id int, place int, text string, size double, font string, flags int")
    out = ingestion.text_blocks(own)
    assert plan(out).count("Aggregate") == 2 and "Join" not in plan(out)  # partial and whole
    assert {r.block_id: (r.text, r.font_size, r.font_name, r.is_bold) for r in out.collect()} == {1: ("abcde", 9.0, "F", False), 2: ("xy", 8.0, "F", True), 4: ("uv", None, None, False)}


def test_scores_come_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    x[700:] = x[:200]  # ties
    monkeypatch.setattr(blocks, "CELLS", 600)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    own = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "chunk_id long, embedding array<double>, label int").coalesce(1)
    asked = own.where("chunk_id % 45 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("ql"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for match in (None, ("label", "ql")):
        got = {}
        for r in dense.dense_top_k(own, asked, 5, True, match).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.chunk_id
        for q in range(0, 900, 45):
            order = sorted((-round(float(s), 6), k) for k, s in enumerate(unit @ unit[q]) if k != q and (not match or k % 3 == q % 3))[:5]
            assert [got[q][n] for n in range(1, 6)] == [k for _, k in order]
    pages = own.select(F.expr("chunk_id div 10").alias("page_id"), F.col("embedding").alias("vec"))
    tokens = own.where("chunk_id < 40").select(F.expr("chunk_id div 10").alias("query_id"), F.col("chunk_id").alias("token_id"), F.col("embedding").alias("query_vec"))
    rows = dense.maxsim(pages, tokens, 3).collect()
    sums = {(q, p): sum(max(float(x[d] @ x[t]) for d in range(10 * p, 10 * p + 10)) for t in range(10 * q, 10 * q + 10)) for q in range(4) for p in range(90)}
    for q in range(4):
        own_rows = sorted((-r.score, r.page_id) for r in rows if r.query_id == q)
        assert [p for _, p in own_rows[:3]] == [p for _, p in sorted((-round(sums[q, p], 6), p) for p in range(90))[:3]]
        assert len(own_rows) < 45  # queries of several blocks keep to their best, too


def test_a_task_hands_on_what_may_be_best():
    best, handed = blocks.Best(2, 1), 0
    for part in np.split(np.arange(1000.0)[::-1, None], 100):
        handed += int(best.chosen(part).sum())
    assert handed == 2


def test_searches_shuffle_no_postings(spark, tmp_path):
    texts = [f"common word{k % 7} word{k % 11} term{k}" for k in range(600)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    index = lexical.build(chunks, "id", "text", str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "common word3 word5"), (2, "term17 common")], "q int, t string")
    out = lexical.search(index, queries, 4, "q", "t")
    assert "Aggregate" not in plan(out) and "Join" not in plan(out)
    joined = lexical._search_by_join(index, lexical.query_terms(queries, "q", "t"), 4, None, 1.5, 0.75)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, joined.collect()))


def test_texts_are_normalised_in_the_jvm(spark):
    raw = ["ﬁne ① ＡＢＣ", "e\u0301a\u0323\u0302", "\u1112\u1161\u11ab 각", "plain", "", "x" * 70_000 + "²", "\U0001d400 \ufdfa", None]
    own = spark.createDataFrame(list(enumerate(raw)), "id int, t string")
    out = own.select("id", text._nfkc(F.col("t")).alias("t"), text.normalize(F.col("t")).alias("whole"))
    assert "Python" not in plan(out)  # a worker held up to 10,000 texts at once
    got = {r.id: (r.t, r.whole) for r in out.collect()}
    assert [got[k][0] for k in range(len(raw))] == [None if t is None else unicodedata.normalize("NFKC", t) for t in raw]
    assert got[0][1] == "fine 1 ABC" and got[7][1] is None


def test_texts_are_split_in_the_jvm(spark):
    words = [*text.ABBREVIATIONS, "CF.", "xe.g.", "(e.g.", "A.", "é.", "İ.", "_.", "\U0001d400.", "\u0870.", "①.", "a.b.", "No!", "Yes?", "end", "end."]
    gaps = [" ", "  ", "\n", "\n\n", "\n\n\n", "\n \n", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "\r\n", ""]
    raw = [f"{gap}Says {word}{gap}{mark}Then 1.{gap}2 {word}{gap}" for word in words for gap in gaps for mark in ("", "(", '"', "“")]
    raw += [None, "", " ", "\n\n\n\n", ".", "Dr. " * 20_000 + "A", "word. " + " " * 50_000 + "Next"]
    own = spark.createDataFrame(list(enumerate(raw)), "id int, t string")
    out = own.select("id", text.sentences(F.col("t")).alias("s"))
    assert "Python" not in plan(out)  # a worker held up to 10,000 texts at once
    got = {r.id: r.s for r in out.collect()}
    assert [got[k] for k in range(len(raw))] == [text.split_sentences(t) for t in raw]
