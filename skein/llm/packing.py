"""Best-fit packing of token sequences by hierarchical residual packing.

Every task packs the pieces of its documents by best fit, longest first, `unit_pieces` at a time: a unit. Bins that are
nearly full are final. The others are the items of the next round: the bins of `fan_in` units meet in one task, which
packs them by best fit again, and so on up a tree, to its root.

Best fit leaves at most one bin that is not over half full: of two, the later would have gone into the earlier. Bins
over half full can't be joined to each other, only to one of these small ones, and there are at most as many small
bins as units. Whichever large ones they could go into, as many of the emptiest would do as well. So a task hands on its
small bins and as many of its emptiest others as there are units; what stays behind could not have lowered the number of
sequences, and a task's input is bounded by the number of units, not of documents.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import frugal, frugal_group, materialize, text_slices


class ByteTokenizer:
    """ids of a byte-level BPE file of the tokenizers library.

    tiktoken applies the same ranks and pattern several times faster and without threads; it needs ids in the order of
    the merges, which is checked. Texts that hold a special token go to the library itself.
    """

    #: Fixed value: the splitting pattern of byte-level pre-tokenisers.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids do not follow the merges")
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(sorted({*range(256)} - {*visible}))}
        ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of total tokens: full ones, the first may be shorter."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin and the offset of each item, and what each bin holds."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    held: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they still take
    mask = 0
    values = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = values[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(held), capacity
            held.append(0)
        bins[i], offsets[i] = b, held[b]
        held[b] += size
        left = room - size
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(held, np.int64)


PIECES = "piece int, start long, length long, ids_crc32 long, bin long, at long, held long"
#: A bin's number is task << 40 | unit of the task << 24 | bin of the unit.
TASK, UNIT = 40, 24


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, unit_pieces: int = 1 << 16) -> DataFrame:
    """Round 0: the pieces of each document, the unit's bin and place of each, and what the bin holds."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encoder = ByteTokenizer(tokenizer)
        base = TaskContext.get().partitionId() << TASK
        rows: list[tuple] = []
        ids: list = []

        def flush():
            nonlocal base, rows, ids
            part, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            bins, at, held = best_fit(length, capacity)
            columns = [pa.array(ids, id_type), pa.array(part.astype(np.int32)), *(pa.array(x) for x in (start, length, crc, bins + base, at, held[bins]))]
            base += 1 << UNIT
            rows, ids = [], []
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["id", "piece", "start", "length", "ids_crc32", "bin", "at", "held"]
        id_type = None
        for batch, texts in text_slices(batches, 1):
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), texts.to_pylist(), strict=True):
                own = np.append(encoder.ids(text), np.array([end_id], "<u4"))
                for p, (s, length) in enumerate(cut(len(own), capacity)):
                    rows.append((p, s, length, zlib.crc32(own[s : s + length])))
                    ids.append(doc_id)
                    if len(rows) >= unit_pieces:
                        yield flush()
        if rows:
            yield flush()

    return source.mapInArrow(frugal(run), f"id {kind}, {PIECES}")


def _merge(table: pa.Table, capacity: int, nearly: int, units: int) -> pa.Table:
    """One task of a round: bins as items. Columns: grp, held, members (round-0 bins and their places)."""
    sizes = table.column("held").to_numpy().astype(np.int64)
    members = table.column("members").to_pylist()
    bins, at, held = best_fit(sizes, capacity)
    joined: list[list] = [[] for _ in held]
    for b, shift, own in zip(bins.tolist(), at.tolist(), members, strict=True):
        joined[b].extend({"bin": m["bin"], "base": m["base"] + shift} for m in own)
    open_ = np.flatnonzero(held < nearly)
    open_ = open_[np.argsort(held[open_], kind="stable")[: units + 1]]
    final = np.ones(len(held), bool)
    final[open_] = False
    kind = pa.list_(pa.struct([("bin", pa.int64()), ("base", pa.int64())]))
    groups = table.column("grp").to_pylist()[:1] * len(held)
    return pa.table({"grp": pa.array(groups, pa.int64()), "held": pa.array(held), "members": pa.array(joined, kind), "final": pa.array(final)})


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, nearly: int = 2040, fan_in: int = 8, unit_pieces: int = 1 << 16) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: empty) and then end_id; longer ones than capacity are cut into full pieces
    of which the first may be shorter; a very long text is many pieces, of as many units as it takes. Pieces of one
    sequence follow each other without gaps from offset 0. nearly: a bin that holds this much is final. Pieces of one
    length are taken in their order. Repeated rows are packed one by one, null ids stay null, other columns aren't read;
    an empty table gives an empty result.
    """
    first = materialize(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, unit_pieces), "pieces")
    bins = first.where(f"held < {nearly}").select("bin", "held").distinct()
    task, unit = F.shiftright("bin", TASK), F.shiftright("bin", UNIT).bitwiseAND((1 << TASK - UNIT) - 1)
    top = first.agg(F.max(task), F.max(unit), F.count_distinct(F.shiftright("bin", UNIT))).first()
    deep, units = (top[1] or 0) + 1, top[2]
    emptiest = Window.partitionBy("grp").orderBy("held", "bin")
    open_ = bins.select((task * deep + unit).alias("grp"), "bin", "held").withColumn("n", F.row_number().over(emptiest)).where(F.col("n") <= units + 1)
    open_ = open_.select("grp", "held", F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("members"))
    schema = "grp long, held long, members array<struct<bin:long,base:long>>, final boolean"
    width, done, rounds = (0 if top[0] is None else (top[0] + 1) * deep), [], []
    while width > 1:
        width = -(-width // fan_in)
        keyed = open_.select(F.floor(F.col("grp") / fan_in).cast("long").alias("grp"), "held", "members")
        merged = keyed.groupBy("grp").applyInArrow(frugal_group(lambda t: _merge(t, capacity, nearly, units)), schema)
        rounds.append(materialize(merged, "bins"))
        done.append(rounds[-1].where("final"))
        open_ = rounds[-1].where("not final").select("grp", "held", "members")
    done.append(open_.withColumn("final", F.lit(True)))
    all_bins = done[0]
    for more in done[1:]:
        all_bins = all_bins.unionByName(more)
    placed = all_bins.select(F.col("members")[0]["bin"].alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.base").alias("base"))
    return first.join(placed, "bin", "left").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.coalesce("base", F.lit(0)) + F.col("at")).cast("long").alias("offset"),
    )
