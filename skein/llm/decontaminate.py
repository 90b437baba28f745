"""Benchmark decontamination with suffix arrays of the training text.

Every slice of documents is a shard: its words as numbers, and the array of all their suffixes, sorted by as many words
as a search looks at. Each suffix of a test item is looked up by binary search, a word at a time: the suffixes that
begin with its first words are an interval of the array, and the next word cuts a smaller one out of it. What is left
after `window` words (or all of a shorter item) are the occurrences; each is followed to the end of its longest verbatim
match. A shard needs no other shard, so nothing is shuffled.

The benchmark travels to the executors as one block of at most BLOCK_CHARS characters. A larger one goes block by block
over a written index of the shards, and what the blocks find is joined by row: neither the driver nor a task ever holds
more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import ALNUM_WORDS, Words, frugal, materialize, ragged, release, text_slices
from skein.llm.interpolation import _pack, _unpack, rows_of

BLOCK_CHARS = 16 << 20
#: Bytes of text in a shard.
SHARD_BYTES = 2 << 20


class Block:
    """Test items as word numbers; items whose words are all there are suffixes from each of their words."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS)
        self.codes, self.values = words.codes()
        self.names = [str(i) for i, _ in items]
        n_words = np.diff(words.first)
        self.item = np.repeat(np.arange(len(items)), n_words)
        self.end = np.repeat(words.first[1:], n_words)
        self.start = np.repeat(words.first[:-1], n_words)
        size = np.minimum(n_words, window)[self.item] if len(self.item) else self.item
        at = np.arange(len(self.codes))
        self.at = at[at + size <= self.end]  # where a window starts
        self.size = size[self.at]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> Iterator[Block]:
    """The benchmark row by row, in blocks of at most limit characters, or one item; rows without id or words have no windows."""
    held, chars = [], 0
    for row in benchmark.select(id_col, F.col(text_col).cast("string")).where(f"`{id_col}` is not null and `{text_col}` is not null").toLocalIterator():
        if held and chars + len(row[1]) > limit:
            yield Block(held, window)
            held, chars = [], 0
        held.append((row[0], row[1]))
        chars += len(row[1])
    if held:
        yield Block(held, window)


def suffix_array(codes: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, each up to its end, sorted by their first `depth` words at least. codes: from 1."""
    rank, size = codes.astype(np.int64), 1
    while size < depth and len(rank):
        at = np.arange(len(rank)) + size
        after = np.where(at < end, rank[np.minimum(at, len(rank) - 1)], 0)
        values, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        rank = rank + 1
        if len(values) == len(rank):
            break
        size *= 2
    return np.argsort(rank, kind="stable")


class Shard:
    """Words of some texts and the array of their suffixes."""

    def __init__(self, codes: np.ndarray, values: list[bytes], first: np.ndarray, array: np.ndarray):
        self.codes, self.values, self.first, self.array = codes, values, first, array
        self.n_words = np.diff(first)
        self.end = np.repeat(first[1:], self.n_words)

    @classmethod
    def of(cls, texts: pa.Array, depth: int) -> Shard:
        words = Words(texts, ALNUM_WORDS)
        codes, values = words.codes()
        end = np.repeat(words.first[1:], np.diff(words.first))
        return cls(codes + 1, values, words.first, suffix_array(codes + 1, end, depth))

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
        """Where word belongs among the words at `depth` of the suffixes lo to hi (0: the text ends before)."""
        last = len(self.codes) - 1
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            open_ = lo < hi
            mid = np.minimum((lo + hi) // 2, last)
            at = self.array[mid] + depth
            there = np.where(at < self.end[self.array[mid]], self.codes[np.minimum(at, last)], 0)
            down = (there <= word) if right else (there < word)
            lo, hi = np.where(open_ & down, mid + 1, lo), np.where(open_ & ~down, mid, hi)
        return lo

    def occurrences(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(place here, place in the block) for each occurrence of each window of the block."""
        place = {v: k for k, v in enumerate(self.values, 1)}
        own = np.array([place.get(v, 0) for v in block.values], np.int64)
        test = own[block.codes] if len(block.codes) else block.codes
        counts = np.bincount(self.codes, minlength=len(self.values) + 1)
        starts = np.cumsum(counts) - counts
        at, size = block.at, block.size
        known = test[at] > 0
        at, size = at[known], size[known]
        lo, hi = starts[test[at]], starts[test[at]] + counts[test[at]]
        here, there = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        depth = 1
        while len(at):
            done = size == depth
            if done.any():
                n = hi[done] - lo[done]
                here.append(self.array[ragged(lo[done], n)])
                there.append(np.repeat(at[done], n))
            at, size, lo, hi = (x[~done] for x in (at, size, lo, hi))
            word = test[at + depth]
            lo, hi = self._bisect(lo, hi, depth, word, False), self._bisect(lo, hi, depth, word, True)
            left = (lo < hi) & (word > 0)
            at, size, lo, hi = (x[left] for x in (at, size, lo, hi))
            depth += 1
        return np.concatenate(here), np.concatenate(there)

    def search(self, block: Block) -> dict[int, tuple[list[tuple[int, int]], set[str], int, int]]:
        """For each text with an occurrence: (start, end) of the longest matches, the items, and the longest one's words and place."""
        here, there = self.occurrences(block)
        if not len(here):
            return {}
        own = {v: k for k, v in enumerate(self.values, 1)}
        test = np.array([own.get(v, 0) for v in block.values], np.int64)[block.codes]
        size = np.zeros(len(block.codes), np.int64)
        size[block.at] = block.size
        # Occurrences that follow each other on one diagonal are one longer match.
        order = np.lexsort((here, here - there))
        here, there = here[order], there[order]
        first = np.flatnonzero(np.r_[True, (np.diff(here) != 1) | (np.diff(there) != 1) | (block.item[there[1:]] != block.item[there[:-1]])])
        here, there = here[first], there[first]
        length = size[there]
        open_ = np.arange(len(here))
        while len(open_):  # each is followed until the words differ
            a, b = here[open_] + length[open_], there[open_] + length[open_]
            more = (a < self.end[here[open_]]) & (b < block.end[there[open_]])
            more[more] = self.codes[a[more]] == test[b[more]]
            open_ = open_[more]
            length[open_] += 1
        doc = np.searchsorted(self.first, here, "right") - 1
        out: dict[int, list] = {}
        for d, a, n, i in zip(doc.tolist(), (here - self.first[doc]).tolist(), length.tolist(), block.item[there].tolist(), strict=True):
            held = out.setdefault(d, [[], set(), 0, -1])
            held[0].append((a, a + n))
            held[1].add(block.names[i])
            if n > held[2] or n == held[2] and a < held[3]:
                held[2:] = n, a
        return {d: tuple(held) for d, held in out.items()}


def _union(spans: list[tuple[int, int]]) -> int:
    """How many places the spans cover."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


KINDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "longest_run": pa.int64(), "longest_run_at": pa.int64()}
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_run long, longest_run_at long"
NOTHING = ([], set(), 0, -1)


def _rows(n_words: list[int], found: list[tuple]) -> list[pa.Array]:
    hits = [_union(spans) for spans, _, _, _ in found]
    named = [sorted(items) for _, items, _, _ in found]
    columns = [n_words, hits, [len(x) for x in named], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], [h > 0 for h in hits], [f[2] for f in found], [f[3] for f in found]]
    return [pa.array(c, t) for c, t in zip(columns, KINDS.values(), strict=True)]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 16) -> DataFrame:
    """The shards as a table written to the shared folder: shard, ids, n_words, codes, vocabulary, suffixes; for lookup().

    Null and empty texts have no words; a very long text is a shard of its own; other columns aren't read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for rows, texts in text_slices(batches, 1, SHARD_BYTES):
            shard = Shard.of(texts, depth)
            columns = [[number], [rows.column(0).to_pylist()], [shard.n_words.tolist()], [_pack(shard.codes.astype("<u4"))], [shard.values], [_pack(shard.array.astype("<u4"))]]
            types = [pa.int64(), pa.list_(rows.schema.field(0).type), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "ids", "n_words", "codes", "vocabulary", "suffixes"])
            number += 1

    shards = source.mapInArrow(frugal(run), f"shard long, ids array<{kind}>, n_words array<long>, codes binary, vocabulary array<binary>, suffixes binary")
    return materialize(shards, "shards")


def _shard_of(row: dict) -> Shard:
    first = np.r_[0, np.cumsum(np.array(row["n_words"], np.int64))]
    n = int(first[-1])
    return Shard(_unpack(row["codes"], n, "<u4").astype(np.int64), [bytes(v) for v in row["vocabulary"]], first, _unpack(row["suffixes"], n, "<u4").astype(np.int64))


def lookup(table: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """What scan() returns, from a table of index() and a benchmark of any size, block by block; the ids are in column id."""
    spark, parts = table.sparkSession, []
    schema = "shard long, place int, spans array<struct<a:long,b:long>>, items array<string>, longest long, longest_at long"
    pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for block in blocks(benchmark, item_col, item_text, window, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for row in rows_of(batches):
                found = _shard_of(row).search(sent.value)
                if found:
                    spans = [[{"a": a, "b": b} for a, b in s] for s, _, _, _ in found.values()]
                    columns = [[row["shard"]] * len(found), list(found), spans, [sorted(i) for _, i, _, _ in found.values()], [f[2] for f in found.values()], [f[3] for f in found.values()]]
                    types = [pa.int64(), pa.int32(), pairs, pa.list_(pa.string()), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "place", "spans", "items", "longest", "longest_at"])

        parts.append(materialize(table.mapInArrow(frugal(run), schema), "matches", 2))
        sent.unpersist()
    base = table.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("place", "d")).select("shard", "place", F.col("d.ids").alias("id"), F.col("d.n_words").alias("n_words"))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for more in parts[1:]:
        found = found.unionByName(more)
    best = F.max(F.struct("longest", (-F.col("longest_at")).alias("at")))
    found = found.groupBy("shard", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), best.alias("best"))

    def finish(batches):
        for batch in batches:
            rows = batch.to_pylist()
            hits = [([(p["a"], p["b"]) for p in r["spans"]], set(r["items"]), r["best"]["longest"], -r["best"]["at"]) if r["spans"] is not None else NOTHING for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), *_rows([r["n_words"] for r in rows], hits)], ["id", *KINDS])

    kind = table.schema["ids"].dataType.elementType.simpleString()
    return base.join(found, ["shard", "place"], "left").mapInArrow(frugal(finish), f"id {kind}, {RESULT}")


def _small(benchmark: DataFrame, item_text: str, block_chars: int) -> bool:
    return (benchmark.agg(F.sum(F.length(F.col(item_text).cast("string")))).first()[0] or 0) <= block_chars


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: its words, those inside an occurrence of a window of a test item, and the items that occur.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are
    `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in lower case (A-Z). longest_run: words of the longest verbatim match with an
    item; longest_run_at: its first word (-1: none; of equal ones the first). Null and empty texts have no
    words; very long ones are read whole, as a shard of their own; rows that repeat are judged one by one; items with
    null id or text don't count, items that repeat count once by id. An empty benchmark hits nothing, an empty table
    gives an empty result. Other columns aren't read.
    """
    if not _small(benchmark, item_text, block_chars):
        table = index(docs, id_col, text_col, max(16, window))
        out = materialize(lookup(table, benchmark, item_col, item_text, window, block_chars), "scanned")
        release(table)
        return out.withColumnRenamed("id", id_col)
    spark: SparkSession = docs.sparkSession
    sent = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, item_col, item_text, window, block_chars)]  # one at most
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for rows, texts in text_slices(batches, 1, SHARD_BYTES):
            shard = Shard.of(texts, window)
            found = shard.search(sent[0].value) if sent else {}
            yield pa.RecordBatch.from_arrays([rows.column(0), *_rows(shard.n_words.tolist(), [found.get(d, NOTHING) for d in range(len(texts))])], ["id", *KINDS])

    out = source.mapInArrow(frugal(run), f"id {source.schema['id'].dataType.simpleString()}, {RESULT}")
    return out.withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows whose text has an occurrence of a window; null and empty texts stay.

    Repeated rows are judged one by one, very long texts whole; all columns stay, whatever their names; an empty table
    stays empty. Without a shuffle; a benchmark of more than block_chars goes over the rows block by block.
    """
    at, spark = docs.columns.index(text_col), docs.sparkSession
    small, before = _small(benchmark, item_text, block_chars), None
    for block in blocks(benchmark, item_col, item_text, window, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for rows, texts in text_slices(batches, at, SHARD_BYTES):
                found = Shard.of(texts, window).search(sent.value)
                yield rows.filter(pa.array([d not in found for d in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(frugal(run), docs.schema)
        if not small:  # one block after the other
            docs = materialize(docs, "clean")
            sent.unpersist()
            if before is not None:
                release(before)
            before = docs
    return docs
