"""What the corpus operators share: word splitting on Arrow buffers, tables in the shared folder, names."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker turns into arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows of text that the JVM sends a Python worker at once in materialize().
TEXT_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's own, else (one machine, as in tests) a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Plans made inside send at most that many rows in an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch(keep):
    """Tables that materialize() makes inside are deleted at the end, but for those that keep() lists then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        made, kept = _SCOPES.pop(), {t._skein_path for t in keep()}
        release(*(t for t in made if t._skein_path not in kept))


def materialize(df: DataFrame, name: str, rows: int = TEXT_ROWS) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors. rows: see arrow_rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    for scope in _SCOPES:
        scope.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._skein_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"skein_{uuid.uuid4().hex[:12]}_{name}"


def _trim(start: bool) -> None:
    """Large arrays get pages of their own, and what is free goes back to the system, as workers idle beside each other."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        if start:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            return
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: memory stays with the worker
        pass


def frugal(fn):
    """A function over record batches that leaves its worker small."""

    def run(batches):
        _trim(True)
        try:
            yield from fn(batches)
        finally:
            _trim(False)

    return run


def frugal_group(fn):
    """The same for a function of one group's table."""

    def run(table):
        _trim(True)
        out = fn(table)
        _trim(False)
        return out

    return run


def text_slices(batches, column: int, limit: int = SLICE_BYTES):
    """Record batches cut so that the text column of each has at most limit bytes, or one row; null texts are empty."""
    for batch in batches:
        texts = batch.column(column)
        if texts.null_count:
            texts = texts.fill_null("")
        if texts.type != pa.string():
            texts = texts.cast(pa.string())
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, "right")) - 1)
            yield batch.slice(at, stop - at), texts.slice(at, stop - at)
            at = stop


def byte_tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and the bytes with A-Z in lower case."""
    is_sep = np.zeros(256, bool)
    is_sep[list(separators)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return is_sep, lower


#: Words are `[^\x20\x09-\x0D]+`.
SPACE_WORDS = byte_tables(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z is in lower case.
ALNUM_WORDS = byte_tables(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Words:
    """The words of a text array.

    data: bytes of all texts, A-Z in lower case; start, end: of each word in data; first: for each text its first
    word, with the number of words at the end.
    """

    def __init__(self, texts: pa.Array, tables: tuple[np.ndarray, np.ndarray]):
        is_sep, lower = tables
        n = len(texts)
        if n == 0:
            self.data, self.start, self.end, self.first = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
            self.mask = np.zeros(0, bool)
            self.offsets = np.zeros(1, np.int64)
            return
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets = offsets - offsets[0]
        self.data = lower[raw]
        self.mask = mask = ~is_sep[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(raw), bool)
        after = np.empty(len(raw), bool)
        if len(raw):
            before[0], before[1:] = False, mask[:-1]
            after[-1], after[:-1] = False, mask[1:]
        self.start = np.flatnonzero(mask & (~before | edge[:-1]))
        self.end = np.flatnonzero(mask & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def array(self) -> pa.Array:
        """The words as an Arrow binary array."""
        ends = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.end - self.start, out=ends[1:])
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.data[self.mask]))])

    def codes(self) -> tuple[np.ndarray, list[bytes]]:
        """For each word the index of its value, and the distinct values."""
        if not len(self):
            return np.zeros(0, np.int64), []
        found = self.array().dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by single spaces, and where each starts and ends there."""
        lens = self.end - self.start
        ends = np.cumsum(lens + 1) - 1
        starts = ends - lens
        out = np.full(int(ends[-1]) if len(self) else 0, 32, np.uint8)
        out[np.arange(int(lens.sum())) + np.repeat(np.arange(len(self)), lens)] = self.data[self.mask]
        return out.tobytes(), starts, ends


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same for the others."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(np.asarray(starts, np.int64), counts)
