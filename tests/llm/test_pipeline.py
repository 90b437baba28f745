"""The pipeline's rows, stage by stage, against plain Python on the smallest tables."""

import os
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontaminate import brute
from test_simhash import brute_components, brute_fingerprint

DATA = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def identifiers(text):
    ips = {m[0] for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))}
    phones = {m[0] for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15}
    return {m[0] for m in EMAIL.finditer(text)} | ips | phones


def test_run_against_brute_force(spark, monkeypatch):
    tables, materialize = {}, corpus_pipeline.materialize

    def record(df, name):
        out = materialize(df, name)
        tables[name] = out.columns, out.collect(), out._skein_path
        return out

    monkeypatch.setattr(corpus_pipeline, "materialize", record)
    rows = corpus_pipeline.run(spark, DATA).collect()
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in source.collect()}
    stages = {}
    for name, (columns, found, path) in tables.items():
        assert columns == source.columns and os.path.exists(path) == (name == "pii")  # the others are done with
        stages[name] = {r.doc_id: r.text for r in found}
        assert len(stages[name]) == len(found)
    spoken = stages["language_id"]
    assert all(texts[d] == t and any(c.isalpha() for c in t) for d, t in spoken.items()) and len(spoken) >= 0.9 * len(texts)
    least = brute_components({d: brute_fingerprint(t) for d, t in spoken.items()})
    assert set(stages["simhash_near_dedup"]) == {d for d in spoken if least[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute(stages["simhash_near_dedup"].items(), items) if not r[5]}
    assert set(stages["decontamination"]) == clean
    assert set(stages["pii"]) == clean
    for d, text in stages["pii"].items():
        named = identifiers(stages["decontamination"][d])
        assert not identifiers(text) & named
        if not re.search("[0-9@]", stages["decontamination"][d]):
            assert text == stages["decontamination"][d]
    assert all(r.n_chars == len(r.text) for r in tables["pii"][1])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == clean
    for d, own in pieces.items():
        ids = np.array([*library.encode(stages["pii"][d], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
