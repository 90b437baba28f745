"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code of the fingerprint space: the direct sum of two binary Golay codes (23 bits,
covering radius 3) and a Hamming code (15 bits, radius 1). Two fingerprints x, y at distance t or less have a midpoint
m with d(x, m), d(y, m) <= ceil(t / 2); the anchor that covers m is within radius + ceil(t / 2) of both. So every
fingerprint goes to all anchors within that distance (16 on average for t = 2; the plain bound radius + t would send it
to 150) and any pair within t meets at an anchor.

Distinct fingerprints only are replicated. At an anchor with few fingerprints all pairs are compared. An anchor of more
than `bucket` fingerprints isn't compared: its fingerprints go to the trivial code whose words are all 64-bit values,
with radius 0: those that share a point at distance t / 2 are within t of each other by the triangle inequality, so a
star per point links them exactly, without pairs. Both ways lose no link.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACE_WORDS, Words, fresh, frugal, materialize, text_slices
from skein.llm.components import connected_components

#: (length, generator polynomial of the cyclic code, covering radius); all three are perfect.
CODES = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1))


def fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text over its word shingles, repeats included."""
    words = Words(texts, SPACE_WORDS)
    n_words = np.diff(words.first)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n_words)
    if not len(some):
        return out
    raw, starts, ends = words.joined()
    counts = np.maximum(n_words[some] - shingle + 1, 1)
    bounds = np.r_[0, np.cumsum(counts)]
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words.first[some], counts)
    last = np.minimum(first + shingle, np.repeat(words.first[some + 1], counts)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], seed) for s, e in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), "<u8", len(first))
    step = 1 << 18  # shingles whose bits are spread out at once
    sums = np.zeros((len(some), 64), np.int64)
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = int(np.searchsorted(bounds, at, "right")) - 1
        hi = int(np.searchsorted(bounds, at + len(bits), "left"))
        sums[lo:hi] += np.add.reduceat(bits, np.maximum(bounds[lo:hi] - at, 0), axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, fp long"

    def run(batches):
        for rows, texts in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints(texts, shingle).view(np.int64))], ["id", "fp"])

    return source.mapInArrow(frugal(run), schema)


@lru_cache(maxsize=None)
def _patterns(length: int, generator: int, radius: int, excess: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The syndrome of each bit; for 0, 1, ... excess the error patterns of weight radius + that (0: at most radius) by syndrome, as starts and patterns."""
    degree = generator.bit_length() - 1
    syndromes, x = [], 1
    for _ in range(length):
        syndromes.append(x)
        x <<= 1
        if x >> degree:
            x ^= generator
    out = []
    for extra in range(excess + 1):
        by: list[list[int]] = [[] for _ in range(1 << degree)]
        for weight in range(radius + 1) if extra == 0 else [radius + extra]:
            for bits in combinations(range(length), weight):
                s = 0
                for b in bits:
                    s ^= syndromes[b]
                by[s].append(sum(1 << b for b in bits))
        starts = np.cumsum([0, *map(len, by)])
        out.append((starts, np.array([x for xs in by for x in xs], np.uint64)))
    return np.array(syndromes, np.int64), out


def anchors(fps: np.ndarray, threshold: int, codes=CODES) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within reach of each fingerprint."""
    reach = (threshold + 1) // 2
    rows, words, used = np.arange(len(fps)), np.zeros(len(fps), np.uint64), np.zeros(len(fps), np.int64)
    shift = 0
    for length, generator, radius in codes:
        bits, by_excess = _patterns(length, generator, radius, reach)
        part = (fps >> np.uint64(shift)) & np.uint64((1 << length) - 1)
        syndrome = np.zeros(len(fps), np.int64)
        for b in range(length):
            syndrome ^= np.where((part >> np.uint64(b)) & np.uint64(1), bits[b], 0)
        found = []
        for extra, (starts, patterns) in enumerate(by_excess):
            ok = np.flatnonzero(used + extra <= reach)
            s = syndrome[rows[ok]]
            counts = starts[s + 1] - starts[s]
            which = np.repeat(ok, counts)
            at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[s], counts)
            word = part[rows[which]] ^ patterns[at]
            found.append((rows[which], words[which] | (word << np.uint64(shift)), used[which] + extra))
        rows, words, used = (np.concatenate(x) for x in zip(*found, strict=True))
        shift += length
    return rows, words


def _pairs(batches, threshold: int):
    """Links among the fingerprints of each anchor."""
    for batch in batches:
        lists = batch.column(0)
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy())
        left, right = [], []
        for size in np.unique(sizes).tolist():
            if size < 2:
                continue
            starts = (lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0])[sizes == size]
            block = values[starts[:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            a, b = block[:, i].ravel(), block[:, j].ravel()
            near = np.bitwise_count(a ^ b) <= threshold
            left.append(a[near])
            right.append(b[near])
        a = np.concatenate(left) if left else np.zeros(0, np.uint64)
        b = np.concatenate(right) if right else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def fingerprint_links(fps: DataFrame, threshold: int = 2, bucket: int = 16) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) at distance threshold or less; their transitive closure is exact."""
    if threshold % 2:
        raise ValueError("the threshold must be even")

    def replicate(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 1 << 15):
                part = values[at : at + (1 << 15)]
                rows, words = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(part[rows].view(np.int64)), pa.array(words.view(np.int64))], ["fp", "anchor"])

    sent = fps.select("fp").mapInArrow(frugal(replicate), "fp long, anchor long")
    shared = materialize(sent.groupBy("anchor").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "anchors")
    two = shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    more = sent.join(shared.where("n > 2").select("anchor", "n"), "anchor")
    few = more.where(f"n <= {bucket}").groupBy("anchor").agg(F.collect_list("fp").alias("fps")).select("fps")
    few = few.mapInArrow(frugal(lambda batches: _pairs(batches, threshold)), "a long, b long")
    hot = more.where(f"n > {bucket}").select("fp").distinct()
    points = F.array(F.lit(0).cast("long"))
    for weight in range(1, threshold // 2 + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(64), weight)]
        points = F.concat(points, F.lit(np.array(masks, np.uint64).view(np.int64).tolist()))
    hot = hot.withColumn("mask", F.explode(points)).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    least = hot.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    star = hot.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return two.unionByName(few).unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3, bucket: int = 16) -> DataFrame:
    """One row per document: id_col, fingerprint (16 lower-case hex digits), component_id (smallest reachable id).

    Null and empty texts have fingerprint zero and link like any other; very long ones are read whole, as one slice. Repeated rows stay; a null id takes part with
    its fingerprint but is never a component's id where another is known. Other columns aren't read. An empty table
    gives an empty result.
    """
    table = materialize(fingerprint_table(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(table.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    comps = connected_components(fingerprint_links(distinct, threshold, bucket), "a", "b")
    known = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = known.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return table.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """docs with one document of each group of near-duplicates: that of the smallest id.

    Of rows that share that id one stays. Rows with a null id have no identity and stay, whatever their text; null,
    empty and very long texts are as in near_duplicates(). Other columns stay, whatever their names; an empty table
    stays empty.
    """
    own = fresh("id")
    found = near_duplicates(docs, id_col, text_col, threshold).select(F.col(id_col).alias(own), "component_id")
    found = materialize(found.groupBy(own, "component_id").agg(F.count("*").alias("n")), "keep")
    mine, named = F.col(id_col) == F.col(own), F.col(own).isNotNull()
    # The kept ids grow with the documents: always a sort-merge join, not a broadcast that only small inputs would get.
    first = found.where(F.col(own) == F.col("component_id")).select(own).distinct().hint("merge")
    kept = docs.join(first, mine, "left_semi")
    repeated = found.where(named).groupBy(own).agg(F.sum("n").alias("n")).where("n > 1").select(own)
    if repeated.head(1):
        once = kept.join(repeated, mine, "left_anti")
        kept = once.unionByName(kept.join(repeated, mine, "left_semi").dropDuplicates([id_col]))
    if found.where(~named).head(1):
        kept = kept.unionByName(docs.where(F.col(id_col).isNull()))
    return kept
