"""Embedding near-duplicates with randomised-rotation binary codes.

A vector's code is the signs of its randomly rotated coordinates, with the correction factor f = <code, vector> stored.
For a code x and a rotated vector y, <code x, y> / f estimates <x, y> without bias, and the error is below
`sigmas` * sqrt((1 - f^2) / f^2 / (d - 1)) but for a stray case; pairs whose upper bound is under the threshold are done
with, the others are computed exactly in double precision.

Pairs are met by their codes: further rotations give `tables` groups of sign bits, and vectors that agree on a whole
group share a bucket. The number of bits follows the number of vectors and the number of groups the wanted miss rate:
two vectors at the threshold disagree on a bit with probability angle / pi. A pair is handled in the first group it
shares, so nothing is counted twice and no pair leaves its task: what leaves are link counts and spanning edges.
Copies of one vector are one row with a weight. A bucket of more than `tile` vectors is cut into tiles, and pairs of
tiles are dealt over the cluster, so a hot bucket is never one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import frugal, materialize, release
from skein.llm.components import connected_components


def _rotation(rng: np.random.Generator, dim: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Rotations for vectors of one dimension; the same on every machine."""

    def __init__(self, dim: int, tables: int, bits: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        n = -(-tables * bits // dim)
        self.first = _rotation(rng, dim)
        self.planes = np.concatenate([_rotation(rng, dim) for _ in range(n)])[: tables * bits]
        self.tables, self.bits = tables, bits

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vector, table) bucket numbers."""
        signs = (unit @ self.planes.T > 0).reshape(len(unit), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(tables, bits) for n vectors."""
    bits = min(40, max(6, math.ceil(math.log2(max(n, 2))) - 1))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-same)), bits


def _links(unit: np.ndarray, keys: np.ndarray, rot: np.ndarray, table: np.ndarray, cross: np.ndarray | None, threshold: float, sigmas: float) -> np.ndarray:
    """Adjacency (group, s, s) of groups of equal size: linked, and first met in this table. cross: pairs that count here."""
    d = unit.shape[-1]
    codes = np.where(rot > 0, 1.0, -1.0) / math.sqrt(d)
    f = np.einsum("gsd,gsd->gs", codes, rot)
    bound = sigmas * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(d - 1, 1))
    estimate = np.matmul(codes, rot.transpose(0, 2, 1)) / f[..., None]
    open_ = estimate + bound[..., None] >= threshold
    open_ |= open_.transpose(0, 2, 1)
    s = unit.shape[1]
    open_ &= np.triu(np.ones((s, s), bool), 1)
    if cross is not None:
        open_ &= cross
    g, i, j = np.nonzero(open_)
    near = np.einsum("nd,nd->n", unit[g, i], unit[g, j]) >= threshold
    g, i, j = g[near], i[near], j[near]
    before = np.arange(keys.shape[-1]) < table[g][:, None]
    new = ~((keys[g, i] == keys[g, j]) & before).any(1)
    out = np.zeros(open_.shape, bool)
    out[g[new], i[new], j[new]] = True
    return out | out.transpose(0, 2, 1)


def _roots(linked: np.ndarray) -> np.ndarray:
    """(group, s) the smallest place of each local component."""
    s = linked.shape[1]
    label = np.broadcast_to(np.arange(s), linked.shape[:2]).copy()
    while True:
        least = np.where(linked, label[:, None, :], s).min(2)
        new = np.minimum(label, least)
        new = np.take_along_axis(new, new, 1)
        if (new == label).all():
            return label
        label = new


def _bucket_rows(codes_of, wire: str, threshold: float, sigmas: float):
    """Rows sorted by (tbl, key, a, b) -> (rep, links, root) of the pairs met there."""

    def block(tbl, dim, rep, weight, vectors, tile, sizes):
        codes = codes_of(dim)
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        keys, rot = codes.keys(unit), unit @ codes.first.T
        starts = np.cumsum(sizes) - sizes
        for s in np.unique(sizes).tolist():
            if s < 2:
                continue
            own = starts[sizes == s]
            step = max(1, (1 << 20) // (s * s))
            for at in range(0, len(own), step):
                rows = own[at : at + step][:, None] + np.arange(s)
                cross = None
                if (tile[rows] >= 0).any():
                    cross = (tile[rows][:, :, None] != tile[rows][:, None, :]) | (tile[rows][:, :, None] < 0)
                linked = _links(unit[rows], keys[rows], rot[rows], tbl[rows[:, 0]], cross, threshold, sigmas)
                count = linked @ weight[rows][..., None]
                root = np.take_along_axis(rep[rows], _roots(linked), 1)
                hit = linked.any(2)
                yield rep[rows][hit], count[..., 0][hit], root[hit]

    def run(batches):
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                held = batch if held is None else pa.Table.from_batches([*(held.to_batches() if isinstance(held, pa.Table) else [held]), batch])
                held = held if isinstance(held, pa.Table) else pa.Table.from_batches([held])
            if held is None or not held.num_rows:
                continue
            marks = np.stack([held.column(c).to_numpy() for c in ("tbl", "key", "a", "b", "dim")], 1)
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)])
            whole = len(held) if batch is None else int(starts[-1])  # the last group may go on
            if not whole:
                continue
            now, held = held.slice(0, whole), held.slice(whole).combine_chunks()
            starts = starts[starts < whole]
            sizes = np.diff(np.r_[starts, whole])
            dims = now.column("dim").to_numpy()
            tbl, rep, weight, tile = (now.column(c).to_numpy() for c in ("tbl", "rep", "weight", "tile"))
            raw = now.column("vec").to_pylist()
            for dim in np.unique(dims).tolist():
                groups = dims[starts] == dim
                rows = np.repeat(groups, sizes)
                vectors = np.frombuffer(b"".join(v for v, ok in zip(raw, rows.tolist(), strict=True) if ok), wire).reshape(-1, dim).astype(np.float64)
                for r, c, root in block(tbl[rows], dim, rep[rows], weight[rows], vectors, tile[rows], sizes[groups]):
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c.astype(np.int64)), pa.array(root)], ["rep", "links", "root"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, miss: float = 1e-5, sigmas: float = 5.0, tile: int = 512, seed: int = 7) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    n_links: other vectors at cosine `threshold` or more, in double precision; component_id: smallest reachable id;
    kept: it is that id. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different dimensions. Copies, repeated rows among them, count each. A null id gets a null component
    unless it links with known ones. `miss`: chance that a pair exactly at the threshold shares no bucket; it falls
    steeply above. Ties of ids don't arise, the smallest counts. Other columns aren't read; an empty table gives an
    empty result.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    # Vectors travel in the precision they came in; all sums are in double precision.
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    wire, width = ("<f4", 4) if single else ("<f8", 8)
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def clean(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) + 0.0 if v else None
                out.append(x.astype(wire).tobytes() if x is not None and np.isfinite(x).all() and 0 < float(x @ x) < math.inf else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    rows = source.mapInArrow(frugal(clean), f"id {kind}, vec binary")
    rows = materialize(rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.when(F.col("vec").isNotNull(), F.sha1("vec"))), "vectors")
    valid = rows.where("vec is not null")
    whole = valid.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    # A class is known by a number of its own, so ids may repeat or be null.
    classes = materialize(whole.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "least", "weight", "vec", F.expr(f"length(vec) div {width}").cast("long").alias("dim")), "classes")
    n = classes.count()
    tables, bits = plan(n, threshold, miss)
    made: dict[int, Codes] = {}

    def codes_of(dim: int) -> Codes:
        if dim not in made:
            made[dim] = Codes(dim, tables, bits, seed)
        return made[dim]

    def key(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x = np.frombuffer(b"".join(own.column(2).to_pylist()), wire).reshape(-1, dim).astype(np.float64)
                keys = codes_of(dim).keys(x / np.linalg.norm(x, axis=1)[:, None])
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(list(keys), pa.list_(pa.int64()))], ["rep", "dim", "keys"])

    thin = classes.select("rep", "dim", "vec").mapInArrow(frugal(key), "rep long, dim long, keys array<long>").select("rep", "dim", F.posexplode("keys").alias("tbl", "key"))
    thin = materialize(thin.select("rep", "dim", F.col("tbl").cast("long"), "key"), "keys")
    sizes = thin.groupBy("dim", "tbl", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = thin.join(sizes, ["dim", "tbl", "key"])
    # Up to `tile` vectors meet as they are; more are dealt to tiles, and every two tiles meet.
    calm = met.where(f"n <= {tile}").select("rep", "dim", "tbl", "key", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(-1).cast("long").alias("tile"))
    hot = met.where(f"n > {tile}").withColumn("g", F.ceil(F.col("n") / tile).cast("long")).withColumn("tile", F.expr("pmod(xxhash64(rep, 1), g)"))
    hot = hot.withColumn("other", F.explode(F.expr("sequence(0L, g - 1)")))
    hot = hot.select("rep", "dim", "tbl", "key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), F.when(F.col("tile") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("tile")).alias("tile"))
    full = calm.unionByName(hot).join(classes.select("rep", "weight", "vec"), "rep")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * tables // 200_000))
    dealt = full.select("tbl", "key", "a", "b", "dim", "rep", "weight", "tile", "vec").repartition(parts, "tbl", "key", "a", "b", "dim").sortWithinPartitions("tbl", "key", "a", "b", "dim")
    found = materialize(dealt.mapInArrow(frugal(_bucket_rows(codes_of, wire, threshold, sigmas)), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = materialize(connected_components(found, "rep", "root"), "components")
    known = classes.select("rep", "h1", "h2", "least", "weight").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id")
    out = valid.select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "links", "component_id")
    out = out.unionByName(rows.where("vec is null").select("id", F.lit(None).cast("long").alias("links"), F.lit(None).cast(kind).alias("component_id")))
    out = materialize(out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")), "deduplicated")
    release(rows, classes, thin, found, comps)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
