"""Small fixtures with results known by hand."""

import random

import pytest
from pyspark.sql import functions as F

from skein import config
from skein.functions import classify, geometry, text
from skein.operators import answering, chunking, dense, evaluation, fusion, generation, indexes, layout, lexical, relational, retrieval, runs, understanding
from skein.sources import store
from skein.streaming import latency


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_lexical_tokens(spark):
    for t, want in {"GPIO_OE register": ["gpio_oe", "register"], "version 1.5.2 shipped": ["version", "1.5.2", "shipped"], "total was 22,360 dollars": ["total", "was", "22,360", "dollars"], "!!! ???": []}.items():
        assert one(spark, text.lexical_tokens(F.col("t")), t=t) == want


def test_bm25_ranks(spark):
    chunks = spark.createDataFrame([("c1", "the transformer uses attention"), ("c2", "revenue was 22,360 dollars"), ("c3", "set GPIO_OE to enable output"), ("c4", "climate policy and climate risk"), ("c5", None)], "id string, t string")
    queries = spark.createDataFrame([(1, "GPIO_OE"), (2, "22,360"), (3, "nothing here"), (4, "climate transformer")], "q int, t string")
    got = {}
    for r in lexical.bm25(chunks, queries, 10, "id", "t", "q", "t").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    assert got[1][0][1] == "c3" and got[2][0][1] == "c2" and 3 not in got
    assert [x[0] for x in sorted(got[4])] == [1, 2] and sorted(got[4])[0][1] == "c4"


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, retriever string, chunk_id string, rank int")


def test_rrf_sum_and_max(spark):
    both = hits(spark, [(1, "a", "x", 1), (1, "b", "x", 1), (1, "a", "y", 2), (1, "b", "z", 2), (1, "a", "x", 5)])
    top = fusion.rrf(both).orderBy("rank").collect()
    assert top[0].chunk_id == "x" and top[0].score == pytest.approx(2 / 61) and top[0].component_ranks == {"a": 1, "b": 1}
    assert [r.chunk_id for r in top] == ["x", "y", "z"]
    best = fusion.rrf(both, "max").orderBy("rank").first()
    assert best.score == pytest.approx(1 / 61)
    none = fusion.rrf(both.withColumn("weight", F.when(F.col("retriever") == "b", 0.0).otherwise(1.0))).collect()
    assert all("b" not in r.component_ranks for r in none) and len(none) == 2
    with pytest.raises(ValueError):
        fusion.rrf(both, k=0)


def tied_lists(spark):
    """x at 12 of the text and 3 of the table list, y at 8 of both: both have 0.025, but for the last bit of a double."""
    text_list = {8: "y", 12: "x"}
    table_list = {3: "x", 8: "y"}
    rows = [(1, "bm25", "text", text_list.get(k, f"t{k:02}"), k) for k in range(1, 31)] + [(1, "table", "table", table_list.get(k, f"u{k:02}"), k) for k in range(1, 21)]
    return spark.createDataFrame(rows, "query_id int, retriever string, modality string, chunk_id string, rank int")


def test_equal_sums_tie(spark):
    own = tied_lists(spark)
    weights = spark.createDataFrame([("text", 1.0), ("table", 0.7)], "modality string, weight double")
    fused = fusion.two_stage(own, weights)
    first = {r.chunk_id: r.rank for r in fused.collect()}
    assert (first["x"], first["y"]) == (1, 2)
    pool = fusion.balanced_pool(fused, fusion.rrf(own, keys=("query_id", "modality")), ["text", "table"], 8, 25)
    assert [r.chunk_id for r in pool.orderBy("rank").limit(2).collect()] == ["x", "y"]
    scores = own.select("query_id", "chunk_id", F.lit(0.5).alias("rerank_score")).distinct()
    found = [retrieval.Retriever("bm25", "text", None), retrieval.Retriever("table", "table", None, 0.7)]
    best = retrieval.by_modality(found, own, 10, 8, 25, scores=scores).orderBy("rank").limit(2).collect()
    assert [(r.chunk_id, r.fused_rank) for r in best] == [("x", 1), ("y", 2)]


def test_weights_and_pool(spark):
    r = spark.createDataFrame([("bm25", "text", 1.0), ("dense", "text", None), ("table", "table", 0.4)], "retriever string, modality string, weight double")
    assert {x.modality: x.weight for x in fusion.modality_weights(r, {"table": 0.9}).collect()} == {"text": 1.0, "table": 0.9}
    lists = [(1, m, f"{m}{k}", k) for m in ("t", "b", "f") for k in range(1, 21)]
    by = spark.createDataFrame([(q, m, c, k) for q, m, c, k in lists], "query_id int, modality string, chunk_id string, rank int")
    fused = spark.createDataFrame([(1, c, n + 1) for n, (_, _, c, _) in enumerate(lists)], "query_id int, chunk_id string, rank int")
    pool = [x.chunk_id for x in fusion.balanced_pool(fused, by, ["t", "b", "f"], 8, 25).orderBy("rank").collect()]
    assert len(pool) == len(set(pool)) == 25 and {c[0] for c in pool} == {"t", "b", "f"} and pool == sorted(pool, key=lambda c: "tbf".index(c[0]) * 100 + int(c[1:]))
    assert [x.chunk_id for x in fusion.balanced_pool(fused, by, ["t", "b", "f"], 0, 5).orderBy("rank").collect()] == [f"t{k}" for k in range(1, 6)]


def test_metrics(spark):
    rows = [(1, 1, 0), (1, 2, 0), (1, 3, 0), (2, 1, 0), (2, 2, None), (2, 3, 1), (3, 1, None), (3, 2, None), (3, 3, 1), (4, 1, None)]
    m = spark.createDataFrame(rows, "query_id int, rank int, matched int")
    n = spark.createDataFrame([(1, 1), (2, 4), (3, 1), (4, 2), (5, 1)], "query_id int, n_gold int")
    got = {r.query_id: r for r in evaluation.metrics(m, n, (2, 10)).collect()}
    assert got[1].recall_10 == 1 and got[2].recall_10 == 0.5 and got[3].recall_2 == 0 and got[3].mrr == pytest.approx(1 / 3, abs=1e-6)
    assert got[3].ndcg_10 == 0.5 and got[1].ndcg_10 == 1 and got[1].precision_10 == 1 and got[5].recall_10 == 0 and got[5].precision_10 == 0


def test_gold_match_takes_the_first_entry(spark):
    h = spark.createDataFrame([(1, 1, "d", 9, "text"), (1, 2, "d", 4, "text"), (1, 3, "d", 3, "table")], "query_id int, rank int, doc_id string, page int, modality string")
    g = spark.createDataFrame([(1, 0, "d", 3, None), (1, 1, "d", 4, "text"), (1, 2, "d", 9, "table")], "query_id int, idx int, doc_id string, page int, modality string")
    assert [r.matched for r in evaluation.match_gold(h, g).orderBy("rank").collect()] == [None, 1, 0]


def test_routing_and_filters(spark):
    q = spark.createDataFrame([(1, "What does Figure 3 show?"), (2, "See Table 2"), (3, "Why did it fail?"), (4, "numbers please")], "id int, text string")
    got = {r.id: r for r in understanding.route(q).collect()}
    assert got[1].image_score == 1 and got[2].table_score == 1 and "image" not in got[2].modalities and got[3].modalities == ["text"] and got[4].modalities == ["text", "table", "image"]
    assert one(spark, understanding.page_filter(F.col("t")), t="on page 12 and p. 7, pp. 3") == [12, 7, 3]
    h = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 2.0, 2), (1, "gone", 1.5, 3), (1, "c", 1.0, 4)], "query_id int, chunk_id string, score double, rank int")
    c = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "chunk_id string, doc_id string")
    allowed = spark.createDataFrame([(1, ["x"])], "query_id int, doc_id_in array<string>")
    assert [(r.chunk_id, r.rank) for r in understanding.apply_filter(h, c, allowed, ("doc_id",)).orderBy("rank").collect()] == [("a", 1), ("c", 2)]


def test_budget_skips_but_does_not_stop(spark):
    s = spark.createDataFrame([(1, 1, 5), (1, 2, 8), (1, 3, 4), (1, 4, 1)], "query_id int, rank int, cost int")
    assert [r["rank"] for r in answering.admit(s, 10).orderBy("number").collect()] == [1, 3, 4]


def test_validation_finds_ungrounded_and_unresolved(spark):
    a = spark.createDataFrame([(1, 0, "It cost 22,360 in v1.5 [1]."), (1, 1, "And 77 units [4].")], "query_id int, sentence_id int, sentence string")
    s = spark.createDataFrame([(1, 1, "The cost was 22360 for V1.5")], "query_id int, number int, text string")
    got = {r.sentence_id: r for r in answering.validate(a, s).collect()}
    assert got[0].ungrounded == [] and got[1].unresolved == [4] and got[1].ungrounded == ["77"]


def test_chunk_packing():
    pieces = [(f"word{k} " * 9 + "end.", f"e{k // 3}") for k in range(40)]
    chunks = chunking.pack_sentences(pieces, 60, 20)
    assert all(n <= 60 + 1 for _, _, n in chunks) and all(set(p[0].split()) <= set(" ".join(c[0] for c in chunks).split()) for p in pieces)
    assert chunks[0][0].split(". ")[-1].rstrip(".") in chunks[1][0]
    assert chunking.pack_sentences([("x " * 100, "e")], 60, 20)[0][1] == ["e"]
    parts = chunking.split_table("Cap", ["a", "b"], [["x" * 5, str(k)] for k in range(50)], 100)
    assert [p for p, _ in parts] == list(range(1, len(parts) + 1)) and all(t.startswith("Cap\n| a | b |") for _, t in parts)
    assert chunking.split_table("", ["a"], [["1"]])[0][0] is None


def test_sentences_and_normalisation(spark):
    assert text.split_sentences("See Fig. 3 for J. Smith. It works! Yes.\n\nNew para") == ["See Fig. 3 for J. Smith.", "It works!", "Yes.", "New para"]
    raw = "ﬁne “quoted”‑text here​  two\r\nexam-\nple\n\n\n\nend \x07"
    clean = one(spark, text.normalize(F.col("t")), t=raw)
    assert clean == 'fine "quoted"-text here two\nexample\n\nend' and one(spark, text.normalize(F.col("t")), t=clean) == clean
    assert one(spark, text.redact(F.col("t")), t="key sk-abcdefgh1 x") == "key [redacted] x"


def test_geometry(spark):
    row = spark.range(1).select(geometry.box(*map(F.lit, (0.0, 0.0, 0.4, 0.4))).alias("a"), geometry.box(*map(F.lit, (0.2, 0.2, 0.6, 0.6))).alias("b"))
    got = row.select(F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("i"), geometry.horizontal_overlap(F.col("a"), F.col("b")).alias("h"), geometry.contained_share(F.col("a"), F.col("b")).alias("c")).first()
    assert got.i == pytest.approx(0.04 / 0.28, abs=1e-6) and got.h == pytest.approx(0.5) and got.c == pytest.approx(0.25)


def test_layout(spark):
    drawings = spark.createDataFrame([(1, 0.1 + 0.01 * k, 0.1, 0.15 + 0.01 * k, 0.4) for k in range(9)] + [(1, 0.8, 0.8, 0.81, 0.81)], "page_id int, x0 double, y0 double, x1 double, y1 double")
    assert [r.n for r in layout.cluster_boxes(drawings).collect()] == [9]
    assert layout.compact_grid([["$", "1", ""], ["$", "2"], ["", " ", None]]) == [["$1"], ["$2"]]
    figure = spark.createDataFrame([(1, "f1", (0.1, 0.1, 0.5, 0.5)), (1, "f2", (0.1, 0.6, 0.5, 0.8))], "page_id int, figure_id string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    lines = spark.createDataFrame([(1, "b1", "Figure 1: A", (0.1, 0.51, 0.5, 0.53)), (1, "b2", "Figure 2: B", (0.1, 0.81, 0.5, 0.83))], "page_id int, block_id string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert {r.figure_id: r.block_id for r in layout.assign_captions(figure, lines).collect()} == {"f1": "b1", "f2": "b2"}


def test_relational_semantics(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    pages = spark.createDataFrame([("a", f"a#p{k}") for k in range(3)], "doc_id string, page_id string")
    elements = spark.createDataFrame([("a", "table", 0.4), ("a", "text", 0.9)], "doc_id string, element_type string, extraction_confidence double")
    got = {r.doc_id: r for r in relational.corpus_stats(docs, pages, elements).collect()}
    assert (got["a"].n_pages, got["a"].n_elements, got["a"].n_low_confidence) == (3, 2, 1) and got["b"].n_elements == 0 and got["b"].mean_confidence is None
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(base, spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert one(spark, classify.document_type(F.col("t"), F.lit("science")), t="RP2040 Datasheet") == "datasheet"
    assert one(spark, classify.error_kind(F.col("t")), t="openai.RateLimitError: 429") == "rate_limit"


def test_store_and_stream(spark, tmp_path):
    store.write_table(spark.range(5).withColumn("part", F.col("id") % 2), str(tmp_path / "t"), ["part"])
    assert store.read_table(spark, str(tmp_path / "t")).count() == 5
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    files = store.scan_files(spark, str(tmp_path / "f"))
    assert files.first().is_pdf
    pins = spark.createDataFrame([("a.pdf", files.first().sha256), ("b.pdf", "0")], "name string, sha256 string")
    assert {r.name: r.status for r in store.verify_files(files, pins).collect()} == {"a.pdf": "ok", "b.pdf": "missing"}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = latency.latency_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("lat").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("lat").agg(F.sum("n")).first()[0] == events.count()


def test_maxsim_equals_naive(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    pages = {p: rng.standard_normal((n, 4)) for p, n in enumerate([5, 1, 9, 3])}
    query = rng.standard_normal((4, 4))
    pt = spark.createDataFrame([(p, v.tolist()) for p, m in pages.items() for v in m], "page_id int, vec array<double>")
    qt = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(query)], "query_id int, token_id int, query_vec array<double>")
    for r in dense.maxsim(pt, qt).collect():
        assert r.score == pytest.approx((pages[r.page_id] @ query.T).max(0).sum(), abs=1e-5)


def test_cuts_against_the_rule_piece_by_piece():
    rng = random.Random(3)

    def naive(sizes, target, overlap):
        out, held = [], []
        for k, n in enumerate(sizes):
            if held and sum(sizes[j] for j in held) + n > target:
                out.append((held[0], held[-1] + 1))
                tail = []
                for j in reversed(held):
                    if overlap <= 0 or tail and sum(sizes[i] for i in tail) + sizes[j] > overlap:
                        break
                    tail.insert(0, j)
                held = tail if len(tail) < len(held) else tail[-1:]
            held.append(k)
            if len(held) == 1 and n >= target:
                out.append((k, k + 1))
                held = []
        return out + ([(held[0], held[-1] + 1)] if held else [])

    for _ in range(2000):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(0, 14))]
        target, overlap = rng.randint(1, 20), rng.randint(0, 12)
        assert chunking.cuts(sizes, target, min(overlap, target - 1)) == naive(sizes, target, min(overlap, target - 1))
    pieces = [("a b c d.", "e1"), ("e f.", "e2"), ("g h.", "e3"), ("i " * 50 + ".", "e4")]
    assert chunking.pack_sentences(pieces, 30, 20)[1][0].startswith("g h.") and not chunking.pack_sentences(pieces, 30, 0)[1][0].startswith("g h.")


def test_split_tables_hold_every_row_once_and_fit():
    rng = random.Random(6)
    for _ in range(200):
        rows = [["w " * rng.randint(0, 9), str(k)] for k in range(rng.randint(0, 12))]
        limit = rng.randint(10, 80)
        parts = chunking.split_table("Cap", ["a", "b"], rows, limit)
        lines = [x for _, t in parts for x in t.split("\n")[3:]]
        assert [x.split("|")[2].strip() for x in lines] == [r[1] for r in rows]
        for n, t in parts:
            assert chunking.count_tokens(t) <= limit or len(t.split("\n")) <= 4
            assert (n is None) == (len(parts) == 1)


def test_index_on_disk_and_views(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "alpha beta"), ("c2", "22,360 beta"), ("c3", "GPIO_OE"), ("c4", "!!!")], "id string, text string")
    index = lexical.build(chunks, "id", "text", str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "gpio_oe"), (2, "22,360"), (3, "none such"), (4, "beta")], "qid int, q string")
    got = [(r.query_id, r.chunk_id, r.rank) for r in lexical.search(index, queries, 3, "qid", "q").orderBy("query_id", "rank").collect()]
    assert got == [(1, "c3", 1), (2, "c2", 1), (4, "c1", 1), (4, "c2", 2)] and index.n_docs == 4
    assert lexical.search(lexical.LexicalIndex.load(spark, str(tmp_path / "index")), queries, 3, "qid", "q").count() == 4
    joined = lexical._search_by_join(index, lexical.query_terms(queries, "qid", "q"), 3, None, 1.5, 0.75)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, lexical.search(index, queries, 3, "qid", "q").collect()))
    for bad in ([("a", "x"), ("a", "y z")], []):
        with pytest.raises(ValueError):
            lexical.build(spark.createDataFrame(bad, "id string, text string"), "id", "text")
    row = spark.createDataFrame([(None, "Staff.\n| a |", ["a", " ", None], "unknown", 2, 1, "Two")], "c string, t string, n array<string>, k string, r int, m int, s string")
    view = row.select(retrieval.table_schema_view(*(F.col(x) for x in "ctnkrms"))).first()[0]
    assert view == "Staff.\nColumns: a\n2 rows by 1 columns\nSection: Two"


def test_answer_sentences_take_their_citations_back(spark):
    got = spark.createDataFrame([("It rose. [3] Then it fell. [2]",), ("[1] First. Second [2].",), (None,), ("",)], "a string").select(generation.answer_sentences("a").alias("s")).collect()
    assert [r.s for r in got] == [["It rose. [3]", "Then it fell. [2]"], ["[1] First.", "Second [2]."], [], []]


def test_evidence_bodies(spark):
    rows = [("Doc > S\n\nTable 3: Staff\n| a |", "Doc > S", "table", False), ("lead\nFigure 2 | x\nrest", None, "figure", False), ("plain\ntext", None, "figure", True), ("plain", None, "text", True), ("", None, "table", True)]
    frame = spark.createDataFrame(rows, "t string, h string, k string, c boolean")
    got = frame.select(generation.evidence_body(F.col("t"), F.col("h"), F.col("k"), F.col("c")).alias("e")).select("e.*").collect()
    assert [(r.body, r.caption) for r in got] == [("Caption: Table 3: Staff\n| a |", "Table 3: Staff"), ("Caption: Figure 2 | x\nlead\nrest", "Figure 2 | x"), ("Caption: plain\ntext", "plain"), ("plain", None), ("", None)]
    assert generation.prompt_version("v1") != generation.prompt_version("v2")
    with pytest.raises(PermissionError):
        generation.refuse_calls("x")


def test_evidence_pack_groups_pages_and_skips_what_does_not_fit(spark):
    rows = [(1, 1, "a", "T", "d", 3, "text", None, "w " * 20, None, False), (1, 2, "b", "T", "d", 4, "text", None, "w " * 500, None, False), (1, 3, "c", "T", "d", 5, "text", " S ", "w", None, False), (1, 4, "e", "T", "d", 3, "text", None, "z", None, False)]
    sources = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, title string, doc_id string, page int, chunk_type string, section string, text string, context_header string, has_caption boolean")
    pack = generation.evidence_pack(sources, 100).orderBy("display_order").collect()
    assert [(r.chunk_id, r.number) for r in pack] == [("a", 1), ("e", 3), ("c", 2)] and pack[2].block == "[2] T · page 5 · text · S\nw"
    asked = spark.createDataFrame([(1, "why?"), (2, "none?")], "query_id int, question string")
    got = {r.query_id: r for r in generation.prompts(asked, generation.evidence_pack(sources, 100)).collect()}
    assert "\n\n---\n\n" in got[1].sources_block and generation.NO_SOURCES in got[2].prompt and len(got[1].prompt_sha256) == 64


def test_runs_are_gated(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.0)], "query_id int, value double")
    runs.save_run(frame, str(tmp_path / "r"), "judged", "a")
    assert runs.load_run(spark, str(tmp_path / "r"), "judged", "a").count() == 1
    for call in (lambda: runs.load_run(spark, str(tmp_path / "r"), "judged", "b"), lambda: runs.save_run(frame, str(tmp_path / "r"), "other", "a")):
        with pytest.raises(ValueError):
            call()
    hits = spark.createDataFrame([("c1",), ("c9",)], "chunk_id string")
    with pytest.raises(ValueError, match="c9"):
        runs.rebuild_retrieved(hits, hits.where("chunk_id = 'c1'"))
    gold = spark.createDataFrame([("q1", 0)], "query_id string, position int")
    with pytest.raises(ValueError):
        runs.select_work(gold, gold.limit(0), query_ids=["q1", "zz"])
    cost = runs.estimate(spark.createDataFrame([(100, False), (50, True)], "prompt_tokens int, cache_hit boolean"), 1.0, 2.0)
    assert runs.live_call_gate(cost, True, 1.0) == cost.where("stage = 'total'").first().cost_usd
    for confirmed, budget in ((False, 1.0), (True, 0.0)):
        with pytest.raises(PermissionError):
            runs.live_call_gate(cost, confirmed, budget)
    assert runs.to_markdown(frame) == "| query_id | value |\n| --- | --- |\n| 1 | 2.0000 |"


def test_indexes_refuse_bad_vectors(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(indexes.IndexIntegrityError):
        indexes.recreate(vectors, str(tmp_path / "v"), 2)
    indexes.recreate(vectors.where("chunk_id = 'a'"), str(tmp_path / "v"), 2)
    assert indexes.collection(spark, str(tmp_path / "v")).count() == 1
    queries = spark.createDataFrame([("q", "text")], "query_id string, query string")
    cache = spark.createDataFrame([], "query_sha256 string, identity string, vector array<double>")
    with pytest.raises(KeyError):
        indexes.query_vectors(queries, cache, "m")
    unit = vectors.select(indexes.encoded(lambda s: s.map(lambda x: [3.0, 4.0]), F.col("chunk_id"), "passage: ").alias("v")).first().v
    assert unit == pytest.approx([0.6, 0.8])


def test_configuration(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": [1]}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "a": {"y": 3}, "b": [2]}')
    assert config.load(tmp_path / "own.json", {"a": {"z": 4}}) == {"a": {"x": 1, "y": 3, "z": 4}, "b": [2]}
    (tmp_path / "base.json").write_text('{"extends": "own.json"}')
    with pytest.raises(ValueError, match="extends itself"):
        config.load(tmp_path / "own.json")
    settings = config.Settings.from_environment("APP_", {"APP_API_KEY": "sk-1", "APP_HOST": "h", "OTHER": "x"})
    assert settings.shown() == {"api_key": "***", "host": "h"} and "sk-1" not in repr(settings)
