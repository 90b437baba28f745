import hashlib
import random
import re

import pyarrow as pa

from skein.llm import decontaminate


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    sets = {}
    for i, t in items:
        w = words_of(t)
        n = min(len(w), window)
        if n and i is not None:
            for p in range(len(w) - n + 1):
                sets.setdefault(tuple(w[p : p + n]), set()).add(i)
    sizes = {len(k) for k in sets}
    out = []
    for d, t in docs:
        w = words_of(t)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if own := sets.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= own
        named = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return out


def test_scan_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(30)] + ["Éa", "x9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 9, 10, 14, 30])))) for k in range(25)]
    items = [(k, t if len(t.split()) != 1 else "single") for k, t in items] + [(None, "a b"), (90, None), (3, items[3][1]), (10, items[4][1])]
    docs = [(1, None), (2, ""), (3, "!!! ---")]
    for d in range(10, 60):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            own = words_of(rng.choice(items)[1])
            at = rng.randint(0, len(w))
            w[at:at] = own[rng.randint(0, 3) :]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs.append((70, "alpha, beta " * 20000 + "single"))
    docs.append((70, "repeated id"))
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):
        got = decontaminate.scan(frame, bench, block_chars=block).collect()
        assert sorted(tuple(r)[:6] for r in got) == sorted(brute(docs, items))
    clean = decontaminate.remove_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == sorted((d, t or "") for (d, t), b in zip(docs, brute(docs, items), strict=True) if not b[5])
    assert decontaminate.scan(frame.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.scan(frame, bench.limit(0)).collect())


def test_longest_match(spark):
    item = " ".join(f"t{k}" for k in range(40))
    doc = "lead in " + " ".join(f"T{k}" for k in range(5, 30)) + " tail"
    row = decontaminate.scan(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (row.longest_run, row.longest_run_at, row.n_hit) == (25, 2, 25)


def test_suffix_array_and_search_against_plain_python():
    rng = random.Random(12)
    for _ in range(60):
        texts = [" ".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        shard = decontaminate.Shard.of(pa.array(texts), 64)
        assert sorted(shard.array.tolist()) == list(range(len(shard.codes)))
        suffixes = [shard.codes[p : shard.end[p]].tolist() for p in shard.array]
        assert suffixes == sorted(suffixes)
        items = [(k, " ".join(rng.choices("abcd", k=rng.randint(0, 12)))) for k in range(4)]
        found = decontaminate.Shard.of(pa.array(texts), 4).search(decontaminate.Block(items, 4))
        for d, text in enumerate(texts):
            w, longest, held = text.split(), 0, set()
            for i, t in items:
                own = t.split()
                size = min(4, len(own))
                for p in range(len(w)):
                    for q in range(len(own) - size + 1 if size else 0):
                        n = 0
                        while p + n < len(w) and q + n < len(own) and w[p + n] == own[q + n]:
                            n += 1
                        if n >= size:
                            longest = max(longest, n)
                            held.add(str(i))
            got = found.get(d, decontaminate.NOTHING)
            assert (got[1], got[2]) == (held, longest)


def test_a_written_index_gives_the_same_rows(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choices("abcdefgh", k=12))) for k in range(9)]
    docs = [(k, " ".join(rng.choices("abcdefgh", k=40)) + " " + rng.choice(items)[1] * (k % 2)) for k in range(20)] + [(None, None), (30, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.scan(frame, bench).collect()), key=str)
    for block in (1 << 20, 40):
        assert sorted(map(tuple, decontaminate.lookup(decontaminate.index(frame), bench, block_chars=block).collect()), key=str) == want
        assert sorted(map(tuple, decontaminate.scan(frame, bench, block_chars=block).collect()), key=str) == want
        assert decontaminate.remove_contaminated(frame, bench, block_chars=block).count() == sum(not r[5] for r in want)
