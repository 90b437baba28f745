import math
import random
import re
import zlib
from collections import Counter

from skein.llm import interpolation


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_base_and_model_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "é", "cat", "dog", *(f"w{k}" for k in range(80))]
    docs = [(k, rng.choice([" ", "\t", "\n"]).join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randint(0, 60)))) for k in range(300)]
    docs += [(400, None), (401, ""), (None, "the of cat"), (7, docs[7][1]), (402, "long " * 20000)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, chunk string").repartition(4)
    got = interpolation.score(frame).collect()
    assert len(got) == len(docs)
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    unigrams, bigrams = Counter(), Counter()
    for d, t in docs:
        if not held[d]:
            own = tokens_of(t)
            unigrams.update(own)
            bigrams.update(zip([None, *own[:-1]], own))
    n, v = sum(unigrams.values()), len(unigrams)
    texts = dict(docs)
    for r in got:
        own = tokens_of(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(unigrams[t] > 0 for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((unigrams[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
        assert r.score < 0
    # the model is a distribution: for any context the probabilities of all types and of one unknown add up to 1
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert interpolation.score(frame.limit(0)).count() == 0


def test_weights_are_a_mixture():
    import numpy as np

    zero = interpolation.STEPS * interpolation.TOP_RATIO
    cells = np.array([(5 << 32) | (zero + 80 << 16) | zero + 40, (5 << 32) | (0 << 16) | zero + 40, (2 << 32) | (0 << 16) | 0, (0 << 32) | zero + 30], np.int64)
    weights = interpolation.expectation_maximisation(cells, np.array([100.0, 5.0, 7.0, 9.0]))
    assert np.allclose(weights.sum(1), 1) and weights[5, 0] > 0.8 and weights[2, 2] > 0.9 and weights[0, 0] == 0


def test_scores_against_plain_python(spark):
    """The model's estimates, the deletion of a token from its own counts, the learning of the weights and the sum over a text; and that it is a distribution."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(0, 25)))) for k in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    texts = {d: tokens_of(t) for d, t in docs}
    words, pairs = Counter(), Counter()
    for d, own in texts.items():
        if not held[d]:
            words.update(own)
            pairs.update(zip([None, *own[:-1]], own))
    n, types = sum(words.values()), len(words)

    def bucket(count):
        return min(int(math.log2(count + 1)), interpolation.BUCKETS - 1)

    def rounded(ratio):
        level = round(math.log2(ratio) * interpolation.STEPS)
        return 2.0 ** (max(-60 * interpolation.STEPS, min(60 * interpolation.STEPS, level)) / interpolation.STEPS)

    # expectation-maximisation, token by token; ratios in the histogram's steps
    events = []
    for d, own in texts.items():
        if not held[d]:
            for before, word in zip([None, *own[:-1]], own):
                context, both, single = words[before] - 1, pairs[before, word] - 1, words[word] - 1
                first = rounded(both / max(context, 1) * (types + 1)) if both else 0.0
                second = rounded(single / (n - 1) * (types + 1)) if single else 0.0
                events.append((bucket(context), (first, second, 1.0)))
    weights = {b: [0.3, 0.6, 0.1] if b else [0.0, 0.9, 0.1] for b in range(interpolation.BUCKETS)}
    for _ in range(60):
        mass = {b: [0.0, 0.0, 0.0] for b, _ in events}
        for b, ratios in events:
            share = [w * r for w, r in zip(weights[b], ratios)]
            for k in range(3):
                mass[b][k] += share[k] / sum(share)
        for b, m in mass.items():
            weights[b] = [(x + 1e-3) / (sum(m) + 3e-3) for x in m]
    rest = sum(weights[0][1:])
    weights[0] = [0.0, weights[0][1] / rest, weights[0][2] / rest]

    def probability(before, word):
        w, context = weights[bucket(words[before])], words[before]
        return w[0] * pairs[before, word] / max(context, 1) + w[1] * words[word] / n + w[2] / (types + 1)

    for r in interpolation.score(frame).collect():
        own = texts[r.doc_id]
        assert math.isclose(r.score, sum(math.log10(probability(b, w)) for b, w in zip([None, *own[:-1]], own)), rel_tol=1e-6)
    for before in [None, "w0", "w7", "w39"]:
        if words[before]:
            assert math.isclose(sum(probability(before, w) for w in words) + probability(before, "never seen"), 1.0, rel_tol=1e-9)
