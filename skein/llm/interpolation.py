"""Deleted-interpolation language model: p(w | v) = a_b c(v w) / c(v) + b_b c(w) / N + c_b / (V + 1).

b is the bucket of the context's frequency c(v); the weights of each bucket are learned by expectation-maximisation on
counts from which the predicted occurrence itself is deleted, so every training token is held out from its own estimate.

The corpus is tokenised once into chunks of word numbers, a table in the shared folder. Each chunk sends its distinct
n-grams as sorted 64-bit keys with its training counts to the bucket of their leading bits, packed and compressed; the
bucket adds up all chunks and answers each with the totals. A frequent n-gram is one key per chunk, and there are as
many buckets as the number of tokens asks for. Chunks with their answers are then scored alone, without a join by
document. Expectation-maximisation runs on a histogram over (bucket, log-ratios in steps of 1 / STEPS), whose size is
bounded by its grid whatever the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACE_WORDS, Words, arrow_rows, frugal, frugal_group, materialize, release, text_slices

#: Bytes and rows of text in a chunk.
CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 3000
#: Keys that a bucket should hold of all chunks together.
BUCKET_KEYS = 1 << 20
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ...
BUCKETS = 24
STEPS = 4
#: Log2 ratios are held between this and its negative; unseen ones are apart.
TOP_RATIO = 60
END = np.uint64(xxhash.xxh64_intdigest(b" end"))


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of word pairs."""
    x = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Tokens of some documents, each ended by the end token, and the keys of their n-grams."""

    def __init__(self, row: dict):
        n, v = row["n_tokens"], row["n_values"]
        self.codes = _unpack(row["codes"], n, "<u4").astype(np.int64)
        self.values = _unpack(row["vocabulary"], v, "<u8")
        self.lengths = _unpack(row["lengths"], row["n_docs"], "<u4").astype(np.int64)
        self.held = np.frombuffer(row["held"], np.bool_)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and for each token its key's place."""
        order = np.argsort(self.values)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return self.values[order], place[self.codes]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        tokens = self.values[self.codes]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = END
        return np.unique(_mix(before, tokens), return_inverse=True)


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The corpus as rows of word numbers; held: documents that the model does not learn from."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for rows, texts in text_slices(batches, 1, CHUNK_BYTES):
            words = Words(texts, SPACE_WORDS)
            codes, values = words.codes()
            n = len(texts)
            tokens = np.full(len(codes) + n, len(values), np.uint32)
            tokens[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(words.first))] = codes
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, values), "<u8", len(values))
            yield pa.RecordBatch.from_pylist(
                [{
                    "chunk": number, "ids": rows.column(0).to_pylist(), "n_docs": n, "n_tokens": len(tokens), "n_values": len(values) + 1, "codes": _pack(tokens), "vocabulary": _pack(np.append(hashes, END)),
                    "lengths": _pack((np.diff(words.first) + 1).astype(np.uint32)), "held": np.array(rows.column(2).to_pylist(), np.bool_).tobytes(),
                }],
                pa.schema([("chunk", pa.int64()), ("ids", pa.list_(rows.schema.field(0).type)), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_values", pa.int64()), ("codes", pa.binary()), ("vocabulary", pa.binary()), ("lengths", pa.binary()), ("held", pa.binary())]),
            )
            number += 1

    return source.mapInArrow(frugal(run), f"chunk long, ids array<{kind}>, n_docs long, n_tokens long, n_values long, codes binary, vocabulary binary, lengths binary, held binary")


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def rows_of(batches):
    """Rows as dicts, one at a time: they are wide."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def _ask(bits: int):
    """Chunks -> (n, bucket, chunk, size, keys, counts)."""

    def run(batches):
        for row in rows_of(batches):
            chunk = Chunk(row)
            for order, (keys, place) in ((1, chunk.unigrams()), (2, chunk.bigrams())):
                counts = np.bincount(place, chunk.train, len(keys)).astype(np.uint32)
                bounds = _bounds(keys, bits)
                out = []
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    own = keys[bounds[b] : bounds[b + 1]]
                    out.append((order, b, row["chunk"], len(own), _pack(np.diff(own, prepend=np.uint64(0))), _pack(counts[bounds[b] : bounds[b + 1]])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["n", "bucket", "chunk", "size", "keys", "counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a bucket: for each chunk those of its keys, and as chunk -1 the number of keys with a total and the sum."""
    sizes = table.column("size").to_pylist()
    keys = np.concatenate([np.cumsum(_unpack(k, n, "<u8")) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
    counts = np.concatenate([_unpack(c, n, "<u4") for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
    _, place = np.unique(keys, return_inverse=True)
    totals = np.bincount(place, counts).astype(np.uint64)
    ends = np.cumsum(sizes)
    answers = [_pack(totals[place[e - n : e]]) for n, e in zip(sizes, ends.tolist(), strict=True)]
    n, bucket = table.column("n")[0].as_py(), table.column("bucket")[0].as_py()
    rows = len(sizes) + 1
    return pa.table({
        "n": pa.array([n] * rows, pa.int32()), "bucket": pa.array([bucket] * rows, pa.int32()), "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()), "size": pa.array([*sizes, 0], pa.int64()),
        "totals": pa.array([*answers, b""], pa.binary()), "distinct": pa.array([0] * len(sizes) + [int((totals > 0).sum())], pa.int64()), "tokens": pa.array([0] * len(sizes) + [int(totals.sum())], pa.int64()),
    })


def _with_totals(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, and for each of its tokens c(v w), c(v), c(w)."""
    chunk = Chunk(row)
    found: dict[int, list] = {1: [], 2: []}
    for a in sorted(row["answers"], key=lambda a: a["bucket"]):
        found[a["n"]].append(_unpack(a["totals"], a["size"], "<u8"))
    keys, place = chunk.unigrams()
    totals = np.concatenate(found[1]).astype(np.float64)
    word = totals[place]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[chunk.first] = totals[np.searchsorted(keys, END)]
    _, place = chunk.bigrams()
    return chunk, np.concatenate(found[2]).astype(np.float64)[place], before, word


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def expectation_maximisation(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bucket; pair, word, uniform) from a histogram. cells: bucket << 32 | pair level << 16 | word level."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    bucket = cells >> 32
    levels = np.stack([(cells >> 16) & 0xFFFF, cells & 0xFFFF], 1)
    ratios = np.where(levels == 0, 0.0, np.exp2((levels - 1) / STEPS - TOP_RATIO))
    parts = np.concatenate([ratios, np.ones((len(cells), 1))], 1)
    for _ in range(rounds):
        share = weights[bucket] * parts
        share *= (counts / share.sum(1))[:, None]
        for b in np.unique(bucket).tolist():
            mass = share[bucket == b].sum(0)
            weights[b] = (mass + 1e-3) / (mass.sum() + 3e-3)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, train_types.

    Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case and one end for each document; null and empty texts are
    the end alone. held_out: crc32 of the id as text leaves 2 when divided by 7; the model learns from the others, a null
    id among them. base_score: add-one unigram log10 probability; score: that of the model. Repeated rows count and are
    scored one by one; other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = materialize(chunks(docs, id_col, text_col), "chunks", CHUNK_ROWS)
    n = table.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, 2 * n / BUCKET_KEYS))))
    asked = table.mapInArrow(frugal(_ask(bits)), "n int, bucket int, chunk long, size long, keys binary, counts binary")
    kind = "n int, bucket int, chunk long, size long, totals binary, distinct long, tokens long"
    answers = materialize(asked.groupBy("n", "bucket").applyInArrow(frugal_group(_answer), kind), "answers", 2)
    types, tokens = (x or 0 for x in answers.where("n = 1 and chunk = -1").agg(F.sum("distinct"), F.sum("tokens")).first())
    own = answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("n", "bucket", "size", "totals")).alias("answers"))
    ready = materialize(table.join(own, "chunk"), "counted")
    release(table)
    release(answers)
    uniform = 1.0 / (types + 1)

    def histogram(batches):
        for row in rows_of(batches):
            chunk, pair, context, word = _with_totals(row)
            own = chunk.train
            pair, context, word = pair[own] - 1, context[own] - 1, word[own] - 1
            levels = []
            for c, of in ((pair, np.maximum(context, 1)), (word, max(tokens - 1, 1))):
                ratio = np.log2(np.maximum(c, 0.5) / of / uniform)
                levels.append(np.where(c > 0, 1 + STEPS * TOP_RATIO + np.clip(np.round(ratio * STEPS), -TOP_RATIO * STEPS, TOP_RATIO * STEPS), 0).astype(np.int64))
            cells, counts = np.unique((_bucket(context) << 32) | (levels[0] << 16) | levels[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], ["cell", "n"])

    with arrow_rows(spark, 1):
        cells = ready.mapInArrow(frugal(histogram), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()  # no more than the grid has
    weights = expectation_maximisation(np.array([c for c, _ in cells], np.int64), np.array([k for _, k in cells], np.float64))

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk, pair, context, word = _with_totals(row)
                w = weights[_bucket(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] * uniform
                base = np.log10((word + 1) / (tokens + types + 1))
                sums = [np.add.reduceat(x, chunk.first) for x in ((word > 0).astype(np.int64), base, np.log10(p))]
                n = len(chunk.lengths)
                yield pa.RecordBatch.from_arrays([ids[k].values, pa.array(chunk.held), pa.array(chunk.lengths), pa.array(sums[0]), pa.array(np.full(n, tokens)), pa.array(sums[1]), pa.array(sums[2]), pa.array(np.full(n, types))], NAMES)

    kind = docs.schema[id_col].dataType.simpleString()
    out = ready.mapInArrow(frugal(run), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, train_types long")
    out = materialize(out, "scores", 1)
    release(ready)
    return out.withColumnRenamed("id", id_col)


NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "train_types"]
