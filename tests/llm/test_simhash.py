import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from skein.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: id -> fingerprint; id -> smallest reachable id."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints_match_brute_force():
    texts = ["", "One", "one TWO", "a b c", "The cat\tsat\non the mat", "É è x y z ÀB", "w " * 3000, None, " lead trail "]
    got = simhash.fingerprints(pa.array([t or "" for t in texts]))
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


def test_every_pair_within_threshold_meets_at_an_anchor():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        rows, words = simhash.anchors(np.array([x, y], np.uint64), 2)
        assert set(words[rows == 0].tolist()) & set(words[rows == 1].tolist())


def test_every_word_is_within_the_covering_radius():
    """So the midpoint of any two fingerprints within the threshold has an anchor within radius, and they within radius + half of it."""
    for length, generator, radius in simhash.CODES:
        bits, (starts, *_) = simhash._patterns(length, generator, radius, 0)
        assert len(set(bits.tolist())) == length
        assert (np.diff(starts[0]) >= 1).all()  # each syndrome has an error pattern of weight radius or less
        assert 1 << (length - len(bin(generator)) + 3) == (1 << length) // (len(starts[0]) - 1)


def test_clashing_names(spark):
    rows = [(1, "a b c d", 1, 2), (2, "a b c d", 1, 2), (2, "a b c d", 1, 2), (3, "other words stand here", 1, 2)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _id int, component_id int"))
    assert kept.columns == ["doc_id", "text", "_id", "component_id"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_on_clusters_and_hot_anchors(spark):
    rng = random.Random(5)
    fps, at = {}, 0
    for size in (1, 2, 3, 40, 120):
        centre = rng.getrandbits(64)
        for _ in range(size):
            fp = centre
            for b in rng.sample(range(12), rng.randint(0, 3)):
                fp ^= 1 << b
            fps[at] = fp
            at += 1
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in sorted(set(fps.values()))], "fp long")
    for bucket in (2, 16):
        links = simhash.fingerprint_links(frame, 2, bucket)
        comps = {np.int64(r.node).astype(np.uint64).item(): r.component for r in simhash.connected_components(links, "a", "b").collect()}
        by = {}
        for i, f in fps.items():
            by.setdefault(comps.get(f, f"own{f}"), set()).add(i)
        want = {}
        for i, c in brute_components(fps).items():
            want.setdefault(c, set()).add(i)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_edge_rows(spark):
    long = "alpha beta gamma delta " * 5000
    rows = [(7, long, "x"), (3, long, "y"), (3, long, "y"), (5, None, None), (9, "", None), (11, "Alpha", None), (12, "alpha", None), (None, "solo text here now", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    want = {i: brute_fingerprint(t) for i, t, _ in rows if i}
    comp = brute_components(want)
    assert [g[1:] for g in got if not g[0]] == sorted((i, f"{want[i]:016x}", comp[i]) for i, _, _ in rows if i)
    kept = sorted((r.doc_id or 0) for r in simhash.keep_one(docs).collect())
    assert kept == [0, 3, 5, 11]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).columns == docs.columns
