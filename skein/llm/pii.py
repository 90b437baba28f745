"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of what else reveals them.

An identifier or secret that was found is a protected entity. Over the whole corpus the operator counts how often each
term stands within `window` words of each entity and how often it occurs at all. From that, PMI(term; entity) =
log p(entity | term) / p(entity), and IC(entity) = -log p(entity) is what there is to know. A term that gives away
alpha of it, PMI >= alpha * IC, in at least `support` documents, discloses the entity; it is a span of kind "term"
wherever it stands, in documents that name the entity and in those that don't. risk_curve() measures what each alpha
would take.

Only counts leave a task: terms as 64-bit hashes, summed per task before the shuffle, so a frequent word or entity is
one row per task. The disclosing terms are broadcast up to BROADCAST_TERMS of them; beyond, they join the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import ALNUM_WORDS, Words, fresh, frugal, materialize, release, text_slices

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: n for n, k in enumerate((*KINDS, "secret", "term"))}
BROADCAST_TERMS = 200_000

# The patterns of direct identifiers.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?i:(?<![a-z])(?:api[_-]?key|access[_-]?key|token|secret|passwd|password)\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9+/_.~-]{16,})|\b(?P<known>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,})")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of direct identifiers by start, then kind; each kind leftmost without overlaps, in linear time."""
    out: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for run in DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of credentials: long values with a digit after a word like token, and those of a known form."""
    return [("secret", *m.span(m.lastgroup)) for m in SECRET.finditer(text) if re.search("[0-9]", m[m.lastgroup])]


def direct_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans and secrets; a secret that overlaps a base span stays beside it."""
    found = base_spans(text)
    more = secrets(text)
    return sorted([*found, *more], key=lambda x: (x[1], ORDER[x[0]])) if more else found


def entity_key(kind: str, value: str) -> int:
    """64-bit key of an identifier, the same for its spellings (case, separators)."""
    value = value.lower() if kind in ("email", "ip") else value if kind == "secret" else "".join(c for c in value if "0" <= c <= "9")
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


def term_key(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, bytes]]:
    """(start, end, term) of the words that no span overlaps; span ends are marked by where they stand in the list order."""
    out, k = [], 0
    cover: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if cover and s <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], e)
        else:
            cover.append([s, e])
    for m in TERM.finditer(text):
        while k < len(cover) and cover[k][1] <= m.start():
            k += 1
        if k == len(cover) or m.end() <= cover[k][0]:
            out.append((m.start(), m.end(), m[0].translate(ASCII_LOWER).encode()))
    return out


def near_terms(text: str, spans: list[tuple[str, int, int]], window: int) -> dict[int, Counter]:
    """For each entity the terms within window words of a mention, each occurrence once."""
    found = terms(text, spans)
    starts = np.array([s for s, _, _ in found], np.int64)
    places: dict[int, set[int]] = {}
    for kind, s, e in spans:
        at = int(np.searchsorted(starts, s))
        places.setdefault(entity_key(kind, text[s:e]), set()).update(range(max(0, at - window), min(len(found), at + window)))
    return {key: Counter(found[p][2] for p in own) for key, own in places.items()}


def _suspects(texts: pa.Array) -> np.ndarray:
    """Rows that can hold an identifier."""
    return np.flatnonzero(pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False))


def counts(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """Per task: (null, term, n, 0) for all occurrences of a term outside identifiers, (entity, term, n, docs) for those near an entity."""
    source = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        keys, sizes = [], []
        near: dict[tuple[int, bytes], list[int]] = {}
        for _, texts in text_slices(batches, 0):
            codes, values = Words(texts, ALNUM_WORDS).codes()
            keys.append(np.fromiter(map(term_key, values), np.int64, len(values)))
            sizes.append(np.bincount(codes, minlength=len(values)))
            for i in _suspects(texts).tolist():
                text = texts[i].as_py()
                if spans := direct_spans(text):
                    inside = Counter(m[0].translate(ASCII_LOWER).encode() for m in TERM.finditer(text))
                    inside.subtract(t for _, _, t in terms(text, spans))
                    keys.append(np.array([term_key(t) for t in inside], np.int64))
                    sizes.append(-np.array(list(inside.values()), np.int64))
                    for entity, own in near_terms(text, spans, window).items():
                        for term, n in own.items():
                            held = near.setdefault((entity, term_key(term)), [0, 0])
                            held[0] += n
                            held[1] += 1
            if len(keys) >= 64:
                keys, sizes = map(list, zip(_sum(keys, sizes), strict=True))
            if len(near) > 1 << 18:
                yield _near_rows(near)
                near = {}
        if keys:
            key, n = _sum(keys, sizes)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(key), pa.array(n), pa.array(np.zeros(len(key), np.int64))], NAMES)
        if near:
            yield _near_rows(near)

    return source.mapInArrow(frugal(run), "entity long, term long, n long, docs long")


NAMES = ["entity", "term", "n", "docs"]


def _near_rows(near: dict[tuple[int, int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in near], pa.int64()), pa.array([k[1] for k in near], pa.int64()), pa.array([v[0] for v in near.values()], pa.int64()), pa.array([v[1] for v in near.values()], pa.int64())], NAMES)


def _sum(keys: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(which, np.concatenate(sizes), len(key)).astype(np.int64)


def risks(docs: DataFrame, text_col: str, window: int, support: int) -> DataFrame:
    """entity, term, n (near the entity), all (occurrences), docs, pmi, ic for the terms near an entity in `support` documents.

    What is released by the caller: the tables it is made of, as out._skein_tables.
    """
    found = materialize(counts(docs, text_col, window), "counts")
    total = found.where("entity is null").agg(F.sum("n")).first()[0] or 1
    near = found.where("entity is not null").groupBy("entity", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    near = materialize(near, "near")
    entity = near.groupBy("entity").agg(F.sum("n").alias("around"))
    pairs = near.where(f"docs >= {support}")
    wanted = pairs.select("term").distinct().hint("merge")  # it grows with the corpus
    overall = found.where("entity is null").select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("all"))
    ic = -F.log(F.col("around") / F.lit(float(total)))
    pmi = F.log(F.col("n") / F.col("all")) + ic
    out = pairs.join(overall, "term").join(entity, "entity").select("entity", "term", "n", "all", "docs", pmi.alias("pmi"), ic.alias("ic")).where("ic > 0")
    out._skein_tables = (found, near)
    return out


def disclosures(docs: DataFrame, text_col: str = "text", window: int = 8, alpha: float = 0.98, support: int = 2) -> DataFrame:
    """Terms that disclose an entity, as a table of distinct hashes: term."""
    found = risks(docs, text_col, window, support)
    out = materialize(found.where(F.col("pmi") >= alpha * F.col("ic")).select("term").distinct(), "disclosures")
    release(*found._skein_tables)
    return out


def risk_curve(docs: DataFrame, text_col: str = "text", window: int = 8, support: int = 2, steps: int = 20) -> DataFrame:
    """alpha, terms, pairs, occurrences: what a threshold of alpha = 0, 1 / steps, ... 1 would take from the corpus."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pmi") / F.col("ic")))
    held = risks(docs, text_col, window, support).select("entity", "term", "all", F.floor(share * steps).cast("int").alias("step"))
    at = held.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("step"))))
    per_term = at.groupBy("at", "term").agg(F.count("*").alias("pairs"), F.max("all").alias("all"))
    return per_term.groupBy((F.col("at") / steps).alias("alpha")).agg(F.count("*").alias("terms"), F.sum("pairs").alias("pairs"), F.sum("all").alias("occurrences"))


def all_spans(text: str, revealing: set[int], spans: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Direct spans and spans of the terms that disclose an entity."""
    spans = direct_spans(text) if spans is None else spans
    more = [("term", s, e) for s, e, t in terms(text, spans) if term_key(t) in revealing] if revealing else []
    return sorted([*spans, *more], key=lambda x: (x[1], ORDER[x[0]])) if more else spans


def _listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with identifiers as their kind and disclosing terms generalised; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            label = kind if kind != "term" else "number" if any("0" <= c <= "9" for c in text[s:e]) else "word"
            out += [text[at:s], f"[{label.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _spans_of(texts: pa.Array, revealing) -> list[list[tuple[str, int, int]]]:
    """All spans of each text. revealing(row): the disclosing terms that it may hold."""
    spans: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    for i in _suspects(texts).tolist():
        spans[i] = direct_spans(texts[i].as_py())
    for i in range(len(texts)):
        if own := revealing(i):
            spans[i] = all_spans(texts[i].as_py(), own, spans[i])
    return spans


def _applied(docs: DataFrame, text_col: str, revealing: DataFrame, fn, schema, columns: list[str], broadcast_terms: int) -> DataFrame:
    """fn(record batch, texts, spans of each row) over docs.select(columns). The terms are broadcast, or beyond broadcast_terms joined."""
    at = columns.index(text_col)
    source = docs.select(*columns)
    if revealing.limit(broadcast_terms + 1).count() <= broadcast_terms:
        sent = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r.term for r in revealing.toLocalIterator()), np.int64))

        def run(batches):
            known = set(sent.value.tolist())
            for rows, texts in text_slices(batches, at):
                hit = set()
                if known:
                    words = Words(texts, ALNUM_WORDS)
                    codes, values = words.codes()
                    held = np.array([term_key(v) in known for v in values], bool)
                    doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
                    hit = set(np.unique(doc[held[codes]]).tolist()) if len(codes) else set()
                yield fn(rows, texts, _spans_of(texts, lambda i: known if i in hit else None))

        return source.mapInArrow(frugal(run), schema)

    key_name, terms_name = fresh("key"), fresh("terms")

    def mentions(batches):
        for _, texts in text_slices(batches, 0):
            words = Words(texts, ALNUM_WORDS)
            codes, values = words.codes()
            keys = np.fromiter(map(term_key, values), np.int64, len(values))
            doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
            pair = np.unique(np.stack([doc, codes], 1), axis=0) if len(codes) else np.zeros((0, 2), np.int64)
            own = np.array([xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in texts.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[pair[:, 0]]), pa.array(keys[pair[:, 1]] if len(pair) else keys[:0])], [key_name, "term"])

    def keyed(batches):
        for rows, texts in text_slices(batches, at):
            key = [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key, pa.int64())], [*rows.schema.names, key_name])

    own = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(frugal(mentions), f"{key_name} long, term long").join(revealing, "term").distinct()
    own = own.groupBy(key_name).agg(F.collect_list("term").alias(terms_name))
    joined = source.mapInArrow(frugal(keyed), T.StructType([*source.schema.fields, T.StructField(key_name, T.LongType())])).join(own, key_name, "left").select(*columns, terms_name)

    def run_joined(batches):
        for rows, texts in text_slices(batches, at):
            held = rows.column(len(columns))
            yield fn(rows.select(list(range(len(columns)))), texts, _spans_of(texts, lambda i: set(held[i].as_py() or ())))

    return joined.mapInArrow(frugal(run_joined), schema)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, alpha: float = 0.98, support: int = 2, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """One row per document: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term.

    Null and empty texts have no spans; very long ones are searched whole, in linear time; rows that repeat are judged
    one by one and null ids stay; of spans that start alike the kinds go in the order email, ip, card, phone, secret,
    term; other columns aren't read; an empty table gives an empty result. Places are code points, ends exclusive.
    """
    revealing = disclosures(docs, text_col, window, alpha, support)
    columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_term"]

    def fn(rows, texts, spans):
        tally = [Counter(k for k, _, _ in own) for own in spans]
        base = [hashlib.sha256(_listed(x for x in own if x[0] in KINDS).encode()).hexdigest() for own in spans]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), *(pa.array([t[k] for t in tally], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array([_listed(own) for own in spans], pa.string()), *(pa.array([t[k] for t in tally], pa.int64()) for k in ("secret", "term"))], names
        )

    kind = columns.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_secret long, n_term long"
    return _applied(columns, "text", revealing, fn, schema, ["id", "text"], broadcast_terms).withColumnRenamed("id", id_col)


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", window: int = 8, alpha: float = 0.98, support: int = 2, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """docs with identifiers and secrets masked and disclosing terms generalised; length_col, if there is one, follows the text.

    No row goes; null and empty texts, repeated rows and all other columns, whatever their names, stay as they are; very
    long texts are masked whole; an empty table gives an empty result.
    """
    revealing = disclosures(docs, text_col, window, alpha, support)
    columns = docs.columns
    at = columns.index(text_col)
    schema = docs.schema

    def fn(rows, texts, spans):
        hit = [i for i, own in enumerate(spans) if own]
        if not hit:
            return rows
        values = rows.column(at).to_pylist()
        for i in hit:
            values[i] = masked(values[i], spans[i])
        arrays = list(rows.columns)
        arrays[at] = pa.array(values, rows.schema.field(at).type)
        if length_col in columns:
            k = columns.index(length_col)
            lengths = arrays[k].to_pylist()
            for i in hit:
                lengths[i] = len(values[i])
            arrays[k] = pa.array(lengths, rows.schema.field(k).type)
        return pa.RecordBatch.from_arrays(arrays, rows.schema.names)

    return _applied(docs, text_col, revealing, fn, schema, columns, broadcast_terms)
