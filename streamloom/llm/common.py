"""Shared helpers: where to cut lineage, and vectorised word hashing over Arrow text."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..core import delete_at_end, shared_dir

#: ASCII white space that separates words: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text hashed at once by a Python worker; longer documents are taken alone.
SLICE_BYTES = 1 << 19


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs at most the tasks that read the files.
    Parquet is used rather than checkpoint(), which computes its input twice.  The files go when the
    application ends, or with forget().
    """
    path = f"{shared_dir(df.sparkSession)}/streamloom/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    delete_at_end(df.sparkSession, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.streamloom_path = path
    return back


def saved(df: DataFrame, name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """written() of df, or of df.mapInArrow(run, schema), by the Python workers if the shared folder is of files.

    For each task's file and folder there, Spark's writer launches chmod.  Until such a process has its own
    program it holds all of the executor's memory a second time, to all that measure it.  Tasks write to a
    hidden folder; the driver gets their files' names and moves those in place, so attempts that failed or
    came second leave nothing that is read.

    A Python function at the end of df would be a second worker for each task, and workers stay for all later
    tasks of the application: give it as run, or put a shuffle between.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/streamloom/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if where.getScheme() != "file":
        return written(df.mapInArrow(run, schema) if run else df, name)
    folder = where.getPath()
    os.makedirs(f"{folder}/_temporary")
    delete_at_end(spark, path)

    def save(batches):
        import pyarrow.parquet as pq

        file, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", None
        for batch in run(batches) if run else batches:
            if len(batch):
                out = out or pq.ParquetWriter(f"{folder}/_temporary/{file}", batch.schema, compression="zstd")
                out.write_batch(batch)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [file]})
        give_back()

    for row in df.mapInArrow(save, "file string").collect():
        os.rename(f"{folder}/_temporary/{row.file}", f"{folder}/{row.file}")
    back = spark.read.schema(schema or df.schema).parquet(path)
    back.streamloom_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from written() or saved() that nothing reads any more.

    The shuffle files of the jobs that made them go with the driver's next collection of garbage, which is
    asked for here: else they stay until its heap happens to be full.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.streamloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        spark._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system, Arrow's and where it can the C library's: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_text(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (first, last) of values with at most limit bytes together; a longer value stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words of many texts at once, by NumPy over their bytes.

    A word is a run of bytes other than SPACES; A-Z count as a-z.  A byte's random code is weighted by
    the power of an odd number at its place; differences of the prefix sums, moved back to place 0, are
    the words' polynomial hashes modulo 2**64.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, lower: bool = True, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        codes = rng.integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            codes[65:91] = codes[97:123]
        codes[list(SPACES)] = 0
        self.codes = codes
        self.solid = np.ones(256, bool)
        self.solid[list(SPACES)] = False
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        self.up, self.down = powers(self.BASE, n), powers(pow(self.BASE, -1, 2**64), n)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, word starts, word ends (bytes), and the n + 1 bounds of each text's words."""
        if len(data) > 2 * SLICE_BYTES and len(offsets) == 2:
            return self._long(data)
        return self._some(data, offsets)

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of one long text, in parts that end between words; a word longer than a part makes it longer."""
        out, at = [], 0
        while at < len(data):
            size = SLICE_BYTES
            while at + size < len(data):
                blank = np.flatnonzero(~self.solid[data[at + size // 2 : at + size]])
                if len(blank):
                    size = size // 2 + int(blank[-1]) + 1
                    break
                size *= 2
            part = data[at : at + size]
            hashes, starts, ends, _ = self._some(part, np.array([0, len(part)]))
            out.append((hashes, starts + at, ends + at))
            at += len(part)
        hashes, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
        return hashes, starts, ends, np.array([0, len(hashes)])

    def _some(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        if n >= len(self.up):
            self._powers(max(n + 1, 2 * len(self.up)))
        solid = self.solid[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.down[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.up[starts])
        return hashes, starts, ends, np.searchsorted(starts, offsets)


#: Fixed odd factors for the words of a shingle, by place.
_PLACE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**62, 16, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words within each text, and the n + 1 bounds of each text's runs.

    A text with some words but fewer than size has one run, of all its words (and their number).
    """
    counts = np.diff(bounds)
    n = len(words)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        whole += words[i : i + len(whole)] * _PLACE[i]
    whole = mix(whole)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(runs)))
    first = np.repeat(bounds[:-1], runs) + np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], runs)
    out = np.empty(out_bounds[-1], np.uint64)
    ok = np.repeat(counts >= size, runs)
    out[ok] = whole[first[ok]]
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        few = words[bounds[t] : bounds[t + 1]]
        out[out_bounds[t]] = mix(np.array([(few * _PLACE[: len(few)]).sum(dtype=np.uint64) + np.uint64(len(few))], np.uint64))[0]
    return out, out_bounds


def distinct_by(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values sorted and made distinct within each range of bounds, and the new bounds."""
    out, ends = [], [0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        v = np.unique(values[a:b])
        out.append(v)
        ends.append(ends[-1] + len(v))
    return (np.concatenate(out) if out else values[:0]), np.asarray(ends, np.int64)


def with_text(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing text column is an error that Spark reports."""
    return docs.select(*(F.col(f"`{n}`") for n in names))
