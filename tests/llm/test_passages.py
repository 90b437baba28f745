import random

import xxhash

from skein.llm import passages


def sentence(rng, n):
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 7))) for _ in range(n)]
    return words[0].capitalize() + " " + " ".join(words[1:]) + "."


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, rng.randint(6, 11)) for _ in range(7))
    whole = [sentence(rng, 9) for _ in range(20)]
    docs = [(k, " ".join(sentence(rng, rng.randint(3, 14)) for _ in range(25))) for k in range(40)]
    for k in (5, 9, 20):
        docs[k] = (k, docs[k][1][:300] + " " + passage + " " + docs[k][1][300:])
    docs += [(50, "\n".join(whole)), (51, " ".join(whole)), (52, "\n".join([*whole[:10], sentence(rng, 6), *whole[10:]]))]
    licence = "This work is licensed under some public terms, version three."
    docs += [(60 + k, sentence(rng, 30) + "\n" + licence) for k in range(5)]
    docs += [(70, None), (71, ""), (72, "short"), (None, "x " * 10), (73, "tail " * 30000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, row int").repartition(5)
    got = {r.doc_id: r for r in passages.repeated(frame).collect()}
    assert set(got) == {5, 9, 20, 50, 51, 52}
    assert got[5].kept and not got[9].kept and got[9].component_id == 5 and got[51].component_id == 50
    n = len(passage.split())
    words = docs[9][1].split()
    for a, b in (map(int, s.split(":")) for s in got[9].spans.split(",")):
        assert " ".join(words[a + 1 : b - 1]).lower() in " ".join(passage.split()).lower()
    assert n - 20 <= got[9].n_repeated <= n + 12
    assert got[51].n_removed >= 170 and got[52].n_removed >= 150
    assert passages.repeated(frame.limit(0)).count() == 0


def test_repeated_rows_are_copies(spark):
    rng = random.Random(1)
    text = " ".join(sentence(rng, 12) for _ in range(5))
    got = passages.repeated(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in got) == [(1, False), (1, True)]


def unbroken(rng, n):
    """n words with no place to cut between them."""
    out = []
    while len(out) < n:
        word = "".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 7)))
        if xxhash.xxh64_intdigest(word) % 32:
            out.append(word)
    return out


def test_near_wordings_of_several_documents_each_are_compared(spark):
    rng = random.Random(4)
    passage = unbroken(rng, 44)
    wordings = [[*passage[:-1 - k], f"nearby{k}", *passage[len(passage) - k :]] for k in range(3)]
    far = unbroken(rng, 44)
    texts = [wordings[0], wordings[0], wordings[1], wordings[1], wordings[2], wordings[2], far, far]
    docs = [(k, f"{sentence(rng, 25)}\n{' '.join(text)}\n{sentence(rng, 25)}") for k, text in enumerate(texts, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for tile in (512, 2):
        got = {r.doc_id: r for r in passages.repeated(frame, tile=tile).collect()}
        assert {d: r.component_id for d, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7}
        assert [d for d, r in sorted(got.items()) if r.kept] == [1, 7]


def test_overlaps_within_a_document_are_no_links(spark):
    rng = random.Random(6)
    parts = [" ".join(sentence(rng, 3) for _ in range(30)) for _ in range(4)]
    docs = [(1, parts[0]), (2, f"{parts[0]} {parts[1]}"), (3, f"{parts[1]} {parts[2]}"), (4, parts[3])]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3}
    assert 80 <= got[2].n_removed <= 96 and got[1].n_removed == 0
    assert 80 <= got[3].n_removed <= 96 and got[3].n_repeated <= 96 and 160 <= got[2].n_repeated


def test_one_document_of_a_group_keeps_its_passage(spark):
    rng = random.Random(11)
    base = unbroken(rng, 53)
    # Each wording is near the one before and after it only, so ids 2 and 5 meet ids 9 and 10 alone.
    wordings = [base[3 * k : 3 * k + 44] for k in range(4)]
    docs = [(i, f"{sentence(rng, 25)}\n{' '.join(w)}\n{sentence(rng, 25)}") for i, w in zip((2, 9, 5, 10), wordings)]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(1)).collect()}
    assert {d: r.component_id for d, r in got.items()} == dict.fromkeys((2, 5, 9, 10), 2)
    assert [d for d, r in got.items() if r.kept] == [2]


def test_passages_of_51_words_amid_sentences(spark):
    rng = random.Random(51)
    planted = [[w for _ in range(51) for w in unbroken(rng, 1)] for _ in range(12)]
    docs = [(100 + k, " ".join(sentence(rng, 12) for _ in range(6))) for k in range(8)]
    for k, passage in enumerate(planted):
        for copy in range(2):
            before, after = unbroken(rng, rng.randint(3, 40)), unbroken(rng, rng.randint(3, 40))
            docs.append((2 * k + copy, " ".join([*before, *passage, *after])))
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == set(range(24))
    for d, r in got.items():
        assert r.component_id == d // 2 * 2 and r.kept == (d % 2 == 0) and 41 <= r.n_repeated <= 51
        words = dict(docs)[d].split()
        a, b = map(int, r.spans.split(":"))
        assert " ".join(words[a:b]) in " ".join(planted[d // 2])


def test_near_paragraphs_against_all_pairs(spark):
    """Of all pairs of different paragraphs with a Jaccard similarity of 0.8, nearly all end in one component; no other pair is an edge."""
    rng = random.Random(77)
    texts = []
    for _ in range(60):
        base = unbroken(rng, 300)
        for _ in range(3):
            own = list(base)
            for _ in range(3):
                own[rng.randrange(300)] = "".join(rng.choices("pqrstu", k=5))
            texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    chunks = passages.materialize(passages.chunks(frame, "doc_id", "text"), "chunks", 3000)
    paragraphs = {}
    for row in chunks.collect():
        found = passages.Passages(row.asDict(), 20, 5, 4, 11)
        for s, e, content, keys in zip(found.start.tolist(), found.end.tolist(), found.content.tolist(), found.keys.T.tolist()):
            paragraphs[content] = set(found.rolled[s : e - 4].tolist()), keys
    names = sorted(paragraphs)
    near = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if len(paragraphs[a][0] & paragraphs[b][0]) >= 0.8 * len(paragraphs[a][0] | paragraphs[b][0])}
    signed = {n: (n ^ 1 << 63) - (1 << 63) for n in names}
    rows = [(signed[n], [(k ^ 1 << 63) - (1 << 63) for k in keys], passages.np.unique((passages.np.array(sorted(own), passages.np.uint64) >> passages.np.uint64(32)).astype("<u4")).tobytes()) for n, (own, keys) in paragraphs.items()]
    links = passages.near_links(spark.createDataFrame(rows, "content long, keys array<long>, own binary"), 0.8, 16)
    pairs = {(signed[a], signed[b]) for a, b in near}
    for r in links.collect():
        assert (r.content, r.other) in pairs or (r.other, r.content) in pairs
    component = {r.node: r.component for r in passages.connected_components(links, "content", "other").collect()}
    joined = sum(component.get(a, a) == component.get(b, b) for a, b in pairs)
    print(f"near pairs {len(pairs)}, joined {joined}")
    assert len(pairs) > 100 and joined >= 0.99 * len(pairs)


def test_every_shared_run_of_thirty_words_is_found_to_the_word(spark):
    rng = random.Random(30)
    docs, want = [], {}
    for k in range(40):
        run = unbroken(rng, rng.randint(30, 45))
        for copy in range(2):
            before, after = unbroken(rng, rng.randint(0, 30)), unbroken(rng, rng.randint(0, 30))
            docs.append((2 * k + copy, " ".join([*before, *run, *after])))
            want[2 * k + copy] = f"{len(before)}:{len(before) + len(run)}"
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), similarity=1.01).collect()}  # no near paragraphs, which count whole
    assert {d: r.spans for d, r in got.items()} == want
    assert all(r.component_id == d // 2 * 2 and r.removed == (want[d] if d % 2 else "") for d, r in got.items())
