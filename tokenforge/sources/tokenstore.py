"""Indexed token store and fixed-record token files as Spark data sources
(S10-S13, Y19-Y20).

``tokenstore`` reads and writes shards of two files:

    .idx = header (magic, version u64 = 1, dtype code u8, items u64, documents u64)
           | sizes i32[items] | byte pointers i64[items] | document starts i64[documents]
    .bin = the tokens of all items back to back

Reading: one Spark partition per range of items of a shard.  A task reads the part of
the index that describes its items and their bytes, nothing else.  Writing: every task
writes a shard of its own under a name that holds the write's unique id, so nothing that
is there is ever written over.  The driver publishes a write with one new manifest,
which lists all shards that make up the store from then on: those of before and the new
ones (append), or the new ones alone (overwrite; the replaced files are then removed).
Files of failed attempts or of a write that never committed are in no manifest and
aren't read.  A directory without a manifest, as other tools write it, is read whole.

``tokenrecords`` reads flat token files as fixed-length records: raw uint16
(``dtype=uint16``) or ``.npy`` arrays, with partitions aligned to records; a last,
shorter record is kept.

Paths are local paths or URIs of any file system that Arrow opens (``file``, ``hdfs``,
``s3``, ``gs``, ..); every executor must reach them.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

# The index magic, its version and the dtype codes of the store.
MAGIC = b"MMIDIDX\x00\x00"
VERSION = 1
CODES = {1: "uint8", 2: "int8", 3: "int16", 4: "int32", 5: "int64", 6: "float64", 7: "float64", 8: "uint16"}

HEADER = np.dtype([("magic", "V9"), ("version", "<u8"), ("code", "u1"), ("items", "<u8"), ("documents", "<u8")])
MANIFEST = "_manifest-"
OWN_SHARD = re.compile(r"shard-[0-9a-f]{12}-\d{5,}-\d+")      # not committed while no manifest names it
BATCH = 1024                  # items per Arrow batch from the token store reader
MAX_BATCH_TOKENS = 1 << 24    # and at most this many tokens, but for a longer item


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


def _array(f: pa.NativeFile, dtype, offset: int, count: int) -> np.ndarray:
    dtype = np.dtype(dtype)
    data = f.read_at(count * dtype.itemsize, offset)
    if len(data) < count * dtype.itemsize:
        raise ValueError("the file is shorter than its index says")
    return np.frombuffer(data, dtype)


class Index(NamedTuple):
    """Items ``lo`` to ``hi`` of a shard: what the index says of them."""
    dtype: np.dtype
    items: int
    sizes: np.ndarray
    pointers: np.ndarray
    doc_idx: np.ndarray


def index_bytes(dtype, sizes: np.ndarray, documents: np.ndarray) -> bytes:
    """The ``.idx`` file of items of these sizes; an item begins where the one before ends."""
    name = np.dtype(dtype).name
    code = next((k for k, v in CODES.items() if v == name), None)
    if code is None:
        raise ValueError(f"the store has no code for {name}")
    head = np.zeros(1, HEADER)
    head["magic"], head["version"], head["code"] = np.void(MAGIC), VERSION, code
    head["items"], head["documents"] = len(sizes), len(documents)
    ends = np.cumsum(sizes, dtype=np.int64) * np.dtype(dtype).itemsize
    begins = np.r_[np.int64(0), ends[:-1]] if len(sizes) else ends
    return b"".join([head.tobytes(), np.asarray(sizes, "<i4").tobytes(), begins.astype("<i8").tobytes(),
                     np.asarray(documents, "<i8").tobytes()])


def read_index(path: str, lo: int = 0, hi: int | None = None, documents: bool = True) -> Index:
    """The index of a shard, or of its items ``lo`` to ``hi`` by range reads."""
    fs, at = locate(path)
    with fs.open_input_file(at) as f:
        raw = f.read_at(HEADER.itemsize, 0)
        if raw[:len(MAGIC)] != MAGIC or len(raw) < HEADER.itemsize:
            raise ValueError(f"{path}: not an indexed token store index")
        head = np.frombuffer(raw, HEADER)[0]
        if head["version"] != VERSION:
            raise ValueError(f"{path}: unsupported version {head['version']}")
        n, n_docs = int(head["items"]), int(head["documents"])
        hi = n if hi is None else hi
        sizes_at, pointers_at, docs_at = np.cumsum([HEADER.itemsize, 4 * n, 8 * n]).tolist()
        return Index(np.dtype(CODES[int(head["code"])]), n, _array(f, "<i4", sizes_at + 4 * lo, hi - lo),
                     _array(f, "<i8", pointers_at + 8 * lo, hi - lo),
                     _array(f, "<i8", docs_at, n_docs if documents else 0))


# ------------------------------------------------------------------ manifests
def _manifests(fs: pafs.FileSystem, at: str) -> list[tuple[int, str]]:
    """(number, path) of a store's manifests, the latest last."""
    files = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    found = [f for f in files if f.base_name.startswith(MANIFEST) and f.base_name[len(MANIFEST):].isdigit()]
    return sorted((int(f.base_name[len(MANIFEST):]), f.path) for f in found)


def _load(fs: pafs.FileSystem, path: str) -> list[dict]:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read().decode())["shards"]


def shards(path: str) -> list[dict]:
    """The shards of a store, ``{"shard": name, "items": n}``, in the order they were added."""
    fs, at = locate(path)
    info = fs.get_file_info(at)
    if info.type != pafs.FileType.Directory:
        return [{"shard": posixpath.basename(at), "items": read_index(path + ".idx", 0, 0, False).items}]
    seen = _manifests(fs, at)
    if seen:
        return _load(fs, seen[-1][1])
    names = sorted(f.base_name[:-4] for f in fs.get_file_info(pafs.FileSelector(at))
                   if f.base_name.endswith(".idx") and not OWN_SHARD.fullmatch(f.base_name[:-4]))
    return [{"shard": x, "items": read_index(f"{path}/{x}.idx", 0, 0, False).items} for x in names]


class _Range(InputPartition):
    def __init__(self, prefix: str, lo: int, hi: int):
        self.prefix, self.lo, self.hi = prefix, lo, hi


class _StoreReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.items_per_partition = int(options.get("itemsPerPartition", 65536))

    def partitions(self):
        fs, at = locate(self.path)
        single = fs.get_file_info(at).type != pafs.FileType.Directory
        parts = [_Range(self.path if single else f"{self.path}/{s['shard']}", lo,
                        min(s["items"], lo + self.items_per_partition))
                 for s in shards(self.path) for lo in range(0, s["items"], self.items_per_partition)]
        return parts or [_Range("", 0, 0)]

    def read(self, partition: _Range):
        """Arrow batches of up to ``BATCH`` items, each one range of the ``.bin`` file."""
        if partition.hi <= partition.lo:
            return
        index = read_index(partition.prefix + ".idx", partition.lo, partition.hi, False)
        shard = posixpath.basename(partition.prefix)
        sizes = index.sizes.astype(np.int64)
        so_far = np.cumsum(sizes)
        fs, at = locate(partition.prefix + ".bin")
        with fs.open_input_file(at) as f:
            a = 0
            while a < len(sizes):
                room = (so_far[a - 1] if a else 0) + MAX_BATCH_TOKENS
                b = max(a + 1, min(len(sizes), a + BATCH, int(np.searchsorted(so_far, room, "right"))))
                bounds = np.r_[0, np.cumsum(sizes[a:b])]
                tokens = _array(f, index.dtype, int(index.pointers[a]), int(bounds[-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * (b - a), pa.string()), pa.array(np.arange(a, b) + partition.lo),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens.astype(np.int64)))],
                    names=["shard", "item", "tokens"])
                a = b


class _Commit(WriterCommitMessage):
    def __init__(self, shard: str, items: int):
        self.shard, self.items = shard, items


class _StoreWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.dtype = np.dtype(options.get("dtype", "int32"))
        self.col = options.get("tokensColumn", "tokens")
        self.overwrite = overwrite
        self.write_id = uuid.uuid4().hex[:12]

    def write(self, iterator):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        shard = f"shard-{self.write_id}-{ctx.partitionId():05d}-{ctx.taskAttemptId()}"
        fs, at = locate(self.path)
        fs.create_dir(at, recursive=True)
        sizes = []
        with fs.open_output_stream(f"{at}/{shard}.bin") as f:
            for batch in iterator:
                lists = batch.column(batch.schema.get_field_index(self.col)).fill_null([])
                tokens = lists.flatten().to_numpy(zero_copy_only=False)
                kept = tokens.astype(self.dtype)
                if not np.array_equal(kept, tokens):
                    raise ValueError(f"a token doesn't fit into {self.dtype.name}")
                f.write(kept.tobytes())
                sizes.append(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
        with fs.open_output_stream(f"{at}/{shard}.idx") as f:
            f.write(index_bytes(self.dtype, sizes, np.arange(len(sizes) + 1)))
        return _Commit(shard, len(sizes))

    def commit(self, messages):
        fs, at = locate(self.path)
        fs.create_dir(at, recursive=True)
        before = _manifests(fs, at)
        # a store of other tools has no manifest: its shards are listed, so an append keeps them
        held = shards(self.path)
        new = [{"shard": m.shard, "items": m.items} for m in messages if m is not None]
        number = before[-1][0] + 1 if before else 0
        draft = f"{at}/.{MANIFEST}{self.write_id}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"shards": new if self.overwrite else held + new}).encode())
        if fs.get_file_info(f"{at}/{MANIFEST}{number}").type != pafs.FileType.NotFound:
            raise RuntimeError(f"{self.path}: another write was committed at the same time")
        fs.move(draft, f"{at}/{MANIFEST}{number}")
        if self.overwrite:
            self._remove(fs, at, [s["shard"] for s in held])

    def abort(self, messages):
        fs, at = locate(self.path)
        self._remove(fs, at, [m.shard for m in messages if m is not None])

    @staticmethod
    def _remove(fs: pafs.FileSystem, at: str, names: list[str]) -> None:
        for name in names:
            for end in (".idx", ".bin"):
                if fs.get_file_info(f"{at}/{name}{end}").type == pafs.FileType.File:
                    fs.delete_file(f"{at}/{name}{end}")


class TokenStoreSource(DataSource):
    """``spark.read.format("tokenstore").load(dir_or_prefix)`` /
    ``df.write.format("tokenstore").option("dtype", "uint16").mode("append").save(dir)``."""

    @classmethod
    def name(cls):
        return "tokenstore"

    def schema(self):
        return "shard string, item long, tokens array<long>"

    def reader(self, schema):
        return _StoreReader(self.options)

    def writer(self, schema, overwrite):
        return _StoreWriter(self.options, overwrite)


class _RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.length = int(options["recordLength"])
        self.dtype = np.dtype(options.get("dtype", "uint16"))
        self.records_per_partition = int(options.get("recordsPerPartition", 65536))

    def _layout(self) -> tuple[np.dtype, int, int]:
        """(dtype, offset of the first token, tokens)."""
        fs, at = locate(self.path)
        if not self.path.endswith(".npy"):
            return self.dtype, 0, fs.get_file_info(at).size // self.dtype.itemsize
        with fs.open_input_file(at) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, dtype = read(f)
            if fortran and len(shape) > 1:
                raise ValueError(f"{self.path}: tokens aren't in row order")
            return dtype, f.tell(), int(np.prod(shape))

    def partitions(self):
        records = -(-self._layout()[2] // self.length)
        return [_Range(self.path, lo, min(records, lo + self.records_per_partition))
                for lo in range(0, records, self.records_per_partition)] or [_Range(self.path, 0, 0)]

    def read(self, partition: _Range):
        if partition.hi <= partition.lo:
            return
        dtype, first, total = self._layout()
        step = max(1, MAX_BATCH_TOKENS // self.length)
        fs, at = locate(self.path)
        with fs.open_input_file(at) as f:
            for lo in range(partition.lo, partition.hi, step):
                hi = min(partition.hi, lo + step)
                a, b = lo * self.length, min(total, hi * self.length)
                tokens = _array(f, dtype, first + a * dtype.itemsize, b - a)
                bounds = np.minimum(np.arange(hi - lo + 1) * self.length, b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(lo, hi)),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens.astype(np.int64)))],
                    names=["record", "tokens"])


class TokenRecordsSource(DataSource):
    """Fixed-length token records of a raw (e.g. uint16) or ``.npy`` file
    (S10, S11): ``spark.read.format("tokenrecords").option("recordLength", n)``."""

    @classmethod
    def name(cls):
        return "tokenrecords"

    def schema(self):
        return "record long, tokens array<long>"

    def reader(self, schema):
        return _RecordReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenStoreSource)
    spark.dataSource.register(TokenRecordsSource)
