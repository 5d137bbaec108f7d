"""Helpers shared by the operators: rows, samples, Arrow text batches, hashes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, approx_bytes, materialize, row_bytes, scratch_path

CHUNK_BYTES = 512 << 10        # bytes of text that one numpy step holds

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


BATCH_BYTES = 8 << 20          # of an Arrow batch that goes to a Python worker


def bound_batches(spark) -> None:
    """Arrow batches of at most ``BATCH_BYTES``: a worker holds a batch, what it makes
    of it and the copies between them at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


PART_BYTES = 8 << 20           # of a written table's partitions, where they are smaller


def compact(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written to the checkpoint folder, in no more partitions than its measured
    bytes are worth, and these bytes.  Many small partitions would make every later
    shuffle write as many small files."""
    m = materialize(df)
    size = approx_bytes(m)
    return m.coalesce(size // PART_BYTES + 1), size


def bounded(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` written to the checkpoint folder, and whether its measured size allows
    a broadcast."""
    m, size = compact(df)
    return m, size <= limit_bytes


def weighed(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """As ``compact``, in one job: bytes, rows and ``sums`` are observed as the rows are
    written.  For loops, where every job's plan and threads stay with the driver for
    a while."""
    seen = Observation()
    m = materialize(df.observe(seen, F.sum(row_bytes(df)).alias("bytes"), F.count("*").alias("rows"),
                               *[c.alias(k) for k, c in sums.items()]))
    got = {k: v or 0 for k, v in seen.get.items()}
    return m.coalesce(got["bytes"] // PART_BYTES + 1), got


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again; for
    tables too large for a row-wise checkpoint.  The files go when Spark ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from: an id, and not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def sample_rows(keys: DataFrame, strata: list[str], order: list[Column], rows: int) -> DataFrame:
    """At most ``rows`` rows of each stratum, the first by ``order``.

    ``keys`` is a thin table (no texts).  The rank filter is a window group
    limit, so each partition sends at most ``rows`` rows of a stratum.
    """
    w = Window.partitionBy(*strata).orderBy(*order)
    return keys.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rows).drop("_rn")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, 2 * len(_pow))
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _pow = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)], dtype=np.uint64)
        _inv = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, back)], dtype=np.uint64)
    return _pow, _inv


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are disjoint and ascending.

    A polynomial over the bytes from prefix sums, taken span by span in slices
    of about ``CHUNK_BYTES`` so that memory stays bounded for long texts.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK_BYTES, "right")))
        part = data[lo:ends[j - 1]]
        pw, iv = _powers(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * pw[:len(part)], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * iv[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Texts:
    """Some whole texts of an Arrow batch as one byte array.

    ``data`` holds the UTF-8 bytes, ``offsets`` the documents' bounds; nulls are
    empty.  ``words()`` gives start, end and document of every word.
    """

    def __init__(self, arr: pa.Array):
        self.n = len(arr)
        self.offsets = np.frombuffer(arr.buffers()[1], np.int64 if pa.types.is_large_string(arr.type) else np.int32,
                                     count=self.n + 1, offset=arr.offset * (8 if pa.types.is_large_string(arr.type) else 4)
                                     ).astype(np.int64) if self.n else np.zeros(1, np.int64)
        buf = arr.buffers()[2]
        lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(buf, np.uint8)[lo:hi] if buf is not None and hi > lo else np.zeros(0, np.uint8)
        self.offsets -= lo

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag of every byte, by document."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]

    def words(self, sep: np.ndarray = WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes not in ``sep``, never across documents."""
        if not len(self.data):
            z = np.zeros(0, np.int64)
            return z, z, z
        gap = sep[self.data]
        first = np.zeros(len(gap), bool)
        first[self.offsets[:-1][self.offsets[:-1] < len(gap)]] = True
        before = np.empty(len(gap), bool)
        before[0], before[1:] = True, gap[:-1]
        starts = np.flatnonzero(~gap & (before | first))
        after = np.empty(len(gap), bool)
        after[-1], after[:-1] = True, gap[1:] | first[1:]
        ends = np.flatnonzero(~gap & after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1


@functools.lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):          # a C library without it
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system.  A worker that keeps what a batch needed at
    its peak would hold it through every later stage, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of whole texts, of about ``limit`` bytes each; nulls become empty."""
    arr = arr.fill_null("")
    sizes = np.asarray(pa.compute.binary_length(arr)).astype(np.int64)
    ends = np.cumsum(sizes)
    i, done = 0, 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield arr.slice(i, j - i)
        done, i = int(ends[j - 1]), j
    if len(arr):
        give_back()


def by_chunk(arr: pa.Array, fn, kind: pa.DataType, limit: int = CHUNK_BYTES) -> pa.Array:
    """``fn`` over whole-text slices of an Arrow batch, put together again."""
    parts = [fn(x) for x in chunks(arr, limit)]
    return pa.concat_arrays([p.cast(kind) if p.type != kind else p for p in parts]) if parts else pa.array([], kind)
