"""Repeated passages: paragraph MinHash banding, with exact units for passages that stand amid paragraphs.

Texts repeat inside longer lines, so paragraphs are cut by content: a place whose five-word shingle hashes lower than
all others within BORDER places on either side ends one paragraph and starts the next, alike in every document that has
the words around it. Bands have one row each: two paragraphs of Jaccard similarity s share one of b bands with
probability 1 - (1 - s)^b, 0.998 at 0.8 with four. All distinct paragraphs of a band key are compared by exact Jaccard
over shingles; hot keys are cut into tiles, and only edges that span the near classes leave a task. Connected components
of the links are the groups; the first document by id keeps its wording.

A passage that is cut elsewhere in each document has no paragraph of its own. So there are units: `words` words each,
from the places that winnowing chooses, the least shingle of every `window` in a row. Two documents that share a run of
words + window - 1 words (30) choose a unit of it alike, so none is missed. Units are equal or nothing. Each match is
then extended word by word (by 16-bit hashes) against the first document that has the unit (that one against the last).

The corpus is tokenised once into chunks of word numbers. A chunk sends its distinct keys, sorted and packed, to the
bucket of their leading bits, which answers which unit keys two documents have and which band keys two different
paragraphs have. Only those go on, as rows; a passage that a third of all documents share is one key per chunk until the
end, and then rows of single documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import frugal, frugal_group, materialize, ragged, release
from skein.llm.components import connected_components
from skein.llm.interpolation import CHUNK_ROWS, Chunk, _bounds, _pack, _unpack, chunks, rows_of

BUCKET_KEYS = 1 << 20
BORDER = 30
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNIT, NEAR = 1, 2
#: Chunk rows are wide.
FEW = 2


def _scramble(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * MULTIPLIER
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, size: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each size values in a row."""
    have = 1
    while 2 * have <= size:
        x = least(x[:-have], x[have:])
        have *= 2
    rest = size - have
    return least(x[: len(x) - rest], x[rest:]) if rest else x


class Passages:
    """The paragraphs and units of a chunk; places are words of the chunk, `first` those where its documents start."""

    def __init__(self, row: dict, words: int, shingle: int, bands: int, window: int):
        chunk = Chunk(row)
        own = np.ones(len(chunk.codes), bool)
        own[chunk.first + chunk.lengths - 1] = False  # the end tokens
        self.tokens = tokens = chunk.values[chunk.codes[own]]
        self.first = np.r_[0, np.cumsum(chunk.lengths - 1)]
        self.words, self.shingle, self.window = words, shingle, window
        n = len(tokens)
        self.rolled = rolled = np.zeros(max(n - shingle + 1, 0), np.uint64)
        for k in range(shingle if len(rolled) else 0):
            rolled *= MULTIPLIER
            rolled += tokens[k : n - shingle + 1 + k]
        doc_end = np.repeat(self.first[1:], np.diff(self.first))
        mixed = _scramble(rolled, 60)
        self._cut_units(mixed, doc_end)
        self._cut_paragraphs(mixed, doc_end, bands)

    def _cut_units(self, mixed: np.ndarray, doc_end: np.ndarray) -> None:
        words, shingle, window, n = self.words, self.shingle, self.window, len(self.tokens)
        chosen = np.zeros(n, bool)
        if len(mixed) >= window:
            least = _slide(mixed, window, np.minimum)
            at = np.arange(len(least))
            least[at + window + shingle - 1 > doc_end[: len(least)]] = 0
            padded = np.r_[np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]
            chosen[: len(mixed)] = (mixed == _slide(padded, window, np.maximum)) & (mixed > 0)
        at = np.flatnonzero(chosen)
        self.unit = at = at[at + words <= doc_end[at]]
        steps = [*range(0, words - shingle, shingle), words - shingle]
        self.unit_key = np.zeros(len(at), np.uint64)
        for k in steps:
            self.unit_key = _scramble(self.unit_key ^ self.rolled[at + k] if len(at) else self.unit_key, 52)
        self.unit_doc = np.searchsorted(self.first, at, "right") - 1

    def _cut_paragraphs(self, mixed: np.ndarray, doc_end: np.ndarray, bands: int) -> None:
        n, span = len(self.tokens), 2 * BORDER + 1
        cut = np.zeros(n + 1, bool)
        if len(mixed) >= span:
            side = _slide(mixed, BORDER, np.minimum)
            at = np.arange(BORDER, len(mixed) - BORDER)
            low = (mixed[at] < side[at - BORDER]) & (mixed[at] <= side[at + 1])
            low &= at + BORDER + self.shingle <= doc_end[at]
            low &= np.searchsorted(self.first, at - BORDER, "right") == np.searchsorted(self.first, at, "right")
            cut[at[low]] = True
        cut[self.first] = True
        start = np.flatnonzero(cut[:-1])
        end = np.r_[start[1:], n]
        ok = end - start >= max(self.words, self.shingle)
        self.start, self.end = start[ok], end[ok]
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        pairs = np.stack([self.start, self.end - self.shingle + 1], 1).ravel()
        self.keys = np.zeros((bands, len(self.start)), np.uint64)
        self.content = np.zeros(len(self.start), np.uint64)
        if len(pairs):
            for b in range(bands):
                self.keys[b] = _scramble(np.minimum.reduceat(np.append(_scramble(self.rolled, b + 1), np.uint64(2**64 - 1)), pairs)[::2], 100 + b)
            # Two independent sums over the shingles: as these overlap, equal bags of them are equal paragraphs but for rare rotations, whose similarity is 1 all the same.
            one, two = (np.add.reduceat(np.append(_scramble(self.rolled, salt), np.uint64(0)), pairs)[::2] for salt in (50, 51))
            self.content = _scramble(one, 52) ^ two

    def unit_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct unit keys, each unit's place among them, and which keys two documents have."""
        values, place = np.unique(self.unit_key, return_inverse=True)
        least, most = np.full(len(values), len(self.first)), np.full(len(values), -1)
        np.minimum.at(least, place, self.unit_doc)
        np.maximum.at(most, place, self.unit_doc)
        return values, place, least < most

    def band_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (key, content) pairs by key, and the place of each band of each paragraph (band after band)."""
        keys, content = self.keys.ravel(), np.tile(self.content, len(self.keys))
        order = np.lexsort((content, keys))
        k, c = keys[order], content[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return k[new], c[new], place

    def around(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """16-bit hashes of the window - 1 words before (nearest first) and after each unit; 0 beyond the document."""
        short = np.maximum((self.tokens >> np.uint64(48)).astype(np.uint16), 1)
        steps = np.arange(self.window - 1)
        before, after = at[:, None] - 1 - steps, at[:, None] + self.words + steps
        last = max(len(short) - 1, 0)
        left = np.where(before >= self.first[doc][:, None], short[np.maximum(before, 0)], 0)
        right = np.where(after < self.first[doc + 1][:, None], short[np.minimum(after, last)], 0)
        return left.astype("<u2"), right.astype("<u2")


def _ask(make, bits: int):
    """Chunks -> (kind, bucket, chunk, size, keys, more); more: which units two documents have, or the contents of the band keys."""

    def run(batches):
        for row in rows_of(batches):
            found = make(row)
            values, _, several = found.unit_keys()
            keys, contents, _ = found.band_keys()
            out = []
            for kind, sent, more in ((UNIT, values, several.astype(np.uint8)), (NEAR, keys, contents)):
                bounds = _bounds(sent, bits)
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    part = slice(bounds[b], bounds[b + 1])
                    out.append((kind, b, row["chunk"], int(bounds[b + 1] - bounds[b]), _pack(np.diff(sent[part], prepend=np.uint64(0))), _pack(more[part])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["kind", "bucket", "chunk", "size", "keys", "more"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk which of its unit keys two documents have, or which of its band keys two contents, anywhere."""
    sizes, kind = table.column("size").to_pylist(), table.column("kind")[0].as_py()
    keys = np.concatenate([np.cumsum(_unpack(k, n, "<u8"), dtype=np.uint64) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
    more = np.concatenate([_unpack(x, n, "<u1" if kind == UNIT else "<u8") for x, n in zip(table.column("more").to_pylist(), sizes, strict=True)])
    _, place = np.unique(keys, return_inverse=True)
    if kind == UNIT:
        shared = np.bincount(place, more + 1.0)[place] > 1
    else:
        order = np.lexsort((more, place))
        p, c = place[order], more[order]
        new = np.r_[True, (p[1:] != p[:-1]) | (c[1:] != c[:-1])]
        shared = np.bincount(p, new)[place] > 1
    ends = np.cumsum(sizes).tolist()
    answers = [_pack(shared[e - n : e].astype(np.uint8)) for n, e in zip(sizes, ends, strict=True)]
    return pa.table({"kind": table.column("kind"), "bucket": table.column("bucket"), "chunk": table.column("chunk"), "size": table.column("size"), "shared": pa.array(answers, pa.binary())})


COLUMNS = ["kind", "row", "id", "start", "end", "content", "left", "right", "keys", "own"]


def _candidates(make):
    """Chunks with their answers -> rows of the units that two documents have and the paragraphs that may have a near one."""

    def run(batches):
        for batch in batches:
            ids_at = batch.schema.get_field_index("ids")
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = batch.column(ids_at)[k].values
                found = make(row)
                shared = {UNIT: [np.zeros(0, bool)], NEAR: [np.zeros(0, bool)]}
                for a in sorted(row["answers"], key=lambda a: a["bucket"]):
                    shared[a["kind"]].append(_unpack(a["shared"], a["size"], "<u1").astype(bool))
                number = ((row["chunk"] >> 32) << 42) | ((row["chunk"] & 0xFFFFFFFF) << 14)
                _, place, _ = found.unit_keys()
                hit = np.flatnonzero(np.concatenate(shared[UNIT])[place]) if len(place) else place
                if len(hit):
                    yield _unit_rows(found, hit, number, ids)
                keys, _, place = found.band_keys()
                hits = np.concatenate(shared[NEAR])[place].reshape(found.keys.shape) if len(place) else np.zeros(found.keys.shape, bool)
                some = np.flatnonzero(hits.any(0))
                for at in range(0, len(some), 4096):
                    yield _near_rows(found, some[at : at + 4096], hits, number, ids)

    return run


def _unit_rows(found: Passages, hit: np.ndarray, number: int, ids: pa.Array) -> pa.RecordBatch:
    at, doc, content = found.unit[hit], found.unit_doc[hit], found.unit_key[hit].view(np.int64)
    # Equal units of one document that overlap (a word over and over) are one longer match.
    order = np.lexsort((at, content, doc))
    at, doc, content = at[order], doc[order], content[order]
    end = at + found.words
    new = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(content) != 0) | (at[1:] > end[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    left = found.around(at[new], doc[new])[0]
    right = found.around(at[last], doc[new])[1]
    base = found.first[doc[new]]
    wide = 2 * (found.window - 1)
    columns = [
        pa.array(np.full(len(new), UNIT, np.int32)), pa.array(number | doc[new]), ids.take(pa.array(doc[new])), pa.array((at[new] - base).astype(np.int32)), pa.array((end[last] - base).astype(np.int32)), pa.array(content[new]),
        *(pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(new), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()) for x in (left, right)),
        pa.nulls(len(new), pa.list_(pa.int64())), pa.nulls(len(new), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, COLUMNS)


def _near_rows(found: Passages, some: np.ndarray, hits: np.ndarray, number: int, ids: pa.Array) -> pa.RecordBatch:
    hit, doc = hits[:, some], found.doc[some]
    base = found.first[doc]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(hit.sum(0))], pa.int32()), pa.array(found.keys[:, some].view(np.int64).T[hit.T]))
    short = (found.rolled >> np.uint64(32)).astype("<u4")
    own = [np.unique(short[s : e - found.shingle + 1]).tobytes() for s, e in zip(found.start[some].tolist(), found.end[some].tolist(), strict=True)]
    none = pa.nulls(len(some), pa.binary())
    columns = [pa.array(np.full(len(some), NEAR, np.int32)), pa.array(number | doc), ids.take(pa.array(doc)), pa.array((found.start[some] - base).astype(np.int32)), pa.array((found.end[some] - base).astype(np.int32)), pa.array(found.content[some].view(np.int64)), none, none, lists, pa.array(own, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, COLUMNS)


def _spanning(contents: list[int], tiles: list[int], sets: list[bytes], cross: bool, similarity: float) -> list[tuple[int, int]]:
    """Edges that span the components of the near pairs: what is reached need not be compared again. cross: only pairs of two tiles count."""
    tile = np.array(tiles)
    values = [np.frombuffer(x, "<u4") for x in sets]
    size = np.array([len(v) for v in values])
    owner = np.repeat(np.arange(len(values)), size)
    flat = np.unique(np.concatenate(values), return_inverse=True)[1]
    by_value, bounds = owner[np.argsort(flat, kind="stable")], np.r_[0, np.cumsum(np.bincount(flat))]
    starts = np.r_[0, np.cumsum(size)]
    new = np.ones(len(values), bool)
    edges = []
    for root in range(len(values)):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue and new.any():
            at = queue.pop()
            own = flat[starts[at] : starts[at + 1]]
            held = by_value[ragged(bounds[own], bounds[own + 1] - bounds[own])]
            common = np.bincount(held, minlength=len(values))
            near = new & (common >= similarity * (size[at] + size - common))
            if cross:
                near &= tile != tile[at]
            reached = np.flatnonzero(near).tolist()
            new[reached] = False
            queue += reached
            edges += [(contents[at], contents[k]) for k in reached]
    return edges


def _near(similarity: float):
    """Rows sorted by (key, a, b) -> spanning edges of the near paragraphs of each."""

    def found(rows: list[dict]) -> list[tuple[int, int]]:
        return _spanning([r["content"] for r in rows], [r["tile"] for r in rows], [r["own"] for r in rows], rows[0]["a"] != rows[0]["b"], similarity) if len(rows) > 1 else []

    def run(batches):
        rows, mark = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = row["key"], row["a"], row["b"]
                if now != mark:
                    out += found(rows)
                    rows, mark = [], now
                rows.append(row)
            yield _edges(out)
        yield _edges(found(rows))

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["content", "other"])


def near_links(near: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Links content, other between the near ones of the paragraphs (content, keys, own: 32-bit hashes of their shingles)."""
    keyed = materialize(near.select("content", F.explode("keys").alias("key")).distinct(), "keyed")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("long").alias("g"))
    # More than `tile` paragraphs of a key are dealt to tiles, and every two tiles meet.
    dealt = keyed.join(sizes, "key").withColumn("tile", F.expr("pmod(xxhash64(content, key), g)")).withColumn("with", F.explode(F.expr("sequence(0L, g - 1)")))
    sets = near.select("content", "own").dropDuplicates(["content"])
    dealt = dealt.select("key", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "content", "tile").join(sets, "content")
    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    links = materialize(dealt.mapInArrow(frugal(_near(similarity)), "content long, other long").distinct(), "links", 1024)
    release(keyed)
    return links


def _extend(batches):
    """Rows (row, id, start, end, left, right, other_left, other_right, component_id, extra) -> with start and end moved outwards over equal words."""
    for batch in batches:
        n = len(batch)
        moved = []
        for one, other in (("left", "other_left"), ("right", "other_right")):
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), "<u2").reshape(n, -1) for c in (one, other))
            moved.append(np.cumprod((a == b) & (a > 0), axis=1).sum(1) if a.shape[1] else np.zeros(n, np.int64))
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        start, end = get("start").to_numpy() - moved[0], get("end").to_numpy() + moved[1]
        yield pa.RecordBatch.from_arrays([get("row"), get("id"), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), get("component_id"), get("extra")], ["row", "id", "start", "end", "component_id", "extra"])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 20, least_words: int = 30, shingle: int = 5, similarity: float = 0.8, bands: int = 4, tile: int = 512) -> DataFrame:
    """One row per document with repeated passages: id_col, component_id, n_repeated, n_removed, spans, removed, kept.

    A passage is repeated if two rows have least_words of its words in a row alike (A-Z in lower case), or paragraphs
    with a Jaccard similarity of `similarity` over `shingle`-word shingles. spans: start:end word places, comma-joined,
    of the maximal repeated runs of at least least_words words; removed: those parts whose group has an earlier document
    (by id, null last; of repeated ids the first row); its first one keeps them. component_id: smallest id in a group of
    passages this row takes part in; kept: nothing is removed here. Where a run goes on in another document than the
    first, its end may be up to least_words - words words short.
    Null and empty texts and those of under `words` words have no passages; very long ones are read whole, a chunk of
    their own. Rows that repeat are copies of each other; a null id stays null. Other columns aren't read; an empty
    table gives an empty result.
    """
    window = least_words - words + 1
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    table = materialize(chunks(source, "id", "text"), "chunks", CHUNK_ROWS)
    n = (table.agg(F.sum("n_tokens")).first()[0] or 0) * 2 / (window + 1)
    bits = max(4, math.ceil(math.log2(max(1, n / BUCKET_KEYS))))

    def make(row: dict) -> Passages:
        return Passages(row, words, shingle, bands, window)

    asked = table.mapInArrow(frugal(_ask(make, bits)), "kind int, bucket int, chunk long, size long, keys binary, more binary")
    answers = materialize(asked.groupBy("kind", "bucket").applyInArrow(frugal_group(_answer), "kind int, bucket int, chunk long, size long, shared binary"), "answers", FEW)
    own = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "size", "shared")).alias("answers"))
    schema = f"kind int, row long, id {kind}, start int, end int, content long, left binary, right binary, keys array<long>, own binary"
    found = materialize(table.join(own, "chunk").mapInArrow(frugal(_candidates(make)), schema), "candidates", FEW)
    release(table, answers)

    units = found.where(f"kind = {UNIT}").select("row", "id", "start", "end", "content", "left", "right")
    mark = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start", "left", "right")
    classes = units.groupBy("content").agg(F.min(mark).alias("f"), F.max(mark).alias("l")).where("f.row <> l.row")
    # The first document of a class is held against the last one, all others against the first.
    met = units.join(classes, "content").withColumn("o", F.expr("if(row = f.row, l, f)"))
    met = met.select("row", "id", "start", "end", "left", "right", F.col("o.left").alias("other_left"), F.col("o.right").alias("other_right"), F.col("f.id").alias("component_id"), F.expr("row <> f.row").alias("extra"))
    members = met.mapInArrow(frugal(_extend), f"row long, id {kind}, start int, end int, component_id {kind}, extra boolean")

    near = found.where(f"kind = {NEAR}")
    links = near_links(near.select("content", "keys", "own"), similarity, tile)
    comps = materialize(connected_components(links, "content", "other"), "components")
    rows = near.select("row", "id", "start", "end", "content").join(comps.withColumnRenamed("node", "content"), "content").drop("content")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    whole = rows.groupBy("component").agg(first.alias("f"), F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("component", "f")
    members = members.unionByName(rows.join(whole, "component").select("row", "id", "start", "end", F.col("f.id").alias("component_id"), F.expr("row <> f.row").alias("extra")))
    per_row = members.groupBy("row").agg(F.first("id").alias("id"), F.min("component_id").alias("component_id"), F.collect_list(F.struct("start", "end", "extra")).alias("parts"))

    def merge(batches):
        for batch in batches:
            out = []
            for row_id, comp, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "component_id", "parts")), strict=True):
                runs = [r for r in _merged([(p["start"], p["end"]) for p in parts]) if r[1] - r[0] >= least_words]
                gone = [(max(a, c), min(b, d)) for a, b in _merged([(p["start"], p["end"]) for p in parts if p["extra"]]) for c, d in runs if min(b, d) > max(a, c)]
                if runs:
                    out.append((row_id, comp, sum(b - a for a, b in runs), sum(b - a for a, b in gone), *(",".join(f"{a}:{b}" for a, b in x) for x in (runs, gone)), not gone))
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("id").type, batch.schema.field("component_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names)

    names = ["id", "component_id", "n_repeated", "n_removed", "spans", "removed", "kept"]
    out = per_row.select("id", "component_id", "parts").mapInArrow(frugal(merge), f"id {kind}, component_id {kind}, n_repeated long, n_removed long, spans string, removed string, kept boolean")
    out = materialize(out, "repeated", 1000)
    release(found, links, comps)
    return out.withColumnRenamed("id", id_col)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as sorted runs that neither overlap nor touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
