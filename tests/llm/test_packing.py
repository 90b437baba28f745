import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skein.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library_s():
    rng = random.Random(2)
    signs = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "　", "'s", "'ll", "1", "99", ".", "!?", "<|endoftext|>", "the", "\x85", "\x1c", "漢", "\x00"]
    texts = ["", " ", "a", " a", "a ", "a  b", "a \nb", "don't we'll"] + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(600)]
    own = packing.ByteTokenizer(PATH)
    library = Tokenizer.from_file(PATH)
    for text in texts:
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_best_fit_is_gapless_and_tight():
    sizes = np.array(random.Random(4).choices(range(1, 2049), k=3000), np.int64)
    bins, offsets, held = packing.best_fit(sizes, 2048)
    assert held.max() <= 2048 and held.sum() == sizes.sum()
    for b in range(len(held)):
        own = sorted((int(o), int(s)) for o, s in zip(offsets[bins == b], sizes[bins == b], strict=True))
        at = 0
        for o, s in own:
            assert o == at
            at += s
    assert len(held) <= -(-int(sizes.sum()) // 2048) * 1.02


def check_rows(rows, docs, capacity):
    library = Tokenizer.from_file(PATH)
    want = []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids), capacity))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((w[0] or -1, *w[1:]) for w in want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_pack_round_trip_and_tree(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choices(["alpha", "Beta,", "gamma\n", "12", "é"], k=rng.choice([0, 1, 5, 20, 60])))) for k in range(300)]
    docs += [(500, None), (None, "no id"), (7, docs[7][1]), (501, "word " * 5000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, bin int").repartition(9)
    rows = packing.pack(frame, PATH, capacity=64, nearly=62, fan_in=2).collect()
    bins, tokens = check_rows(rows, docs, 64)
    assert bins <= 1.05 * tokens / 64 + 2
    assert packing.pack(frame.limit(0), PATH).count() == 0


def test_units_of_one_task_are_merged(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choices(["alpha", "Beta,", "gamma\n", "12", "é"], k=rng.choice([0, 1, 5, 20, 60])))) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    counts = []
    for parts, unit in ((1, 1 << 16), (1, 10), (15, 1 << 16), (3, 7)):
        rows = packing.pack(frame.repartition(parts), PATH, capacity=64, nearly=62, fan_in=4, unit_pieces=unit).collect()
        counts.append(check_rows(rows, docs, 64)[0])
    assert max(counts) <= 1.05 * counts[0] + 1


def test_best_fit_leaves_one_small_bin():
    rng = random.Random(3)
    for _ in range(200):
        held = packing.best_fit(np.array(rng.choices(range(1, 65), k=rng.randint(1, 80)), np.int64), 64)[2]
        assert (held <= 32).sum() <= 1
