"""Shared helpers of the training-data operators: working folders, Arrow string buffers, hashing, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised kernels; one longer text is handled alone, whole.
PIECE_BYTES = 500_000
#: Growth since the last time at which a worker's allocators are asked to give back what they keep.
KEPT_BYTES = 16_000_000
_resident = 0
_caches: list[Callable] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see, under ``spark.checkpoint.dir``.

    Only where that setting is empty and Spark runs inside one process (tests) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="hexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage so that a lost executor costs little.

    With ``under``, a folder of :func:`shared_folder`, the table lies inside it and goes with it when that is released.
    """
    spark = df.sparkSession
    path = f"{under}/{name}-{uuid.uuid4().hex}" if under else shared_folder(spark, name)
    df.write.parquet(path)
    gc.collect()
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables that no result reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory to the system where the process has grown by ``KEPT_BYTES`` since the last time.

    Workers are used again by later tasks and stages and lie idle meanwhile; NumPy's and Arrow's allocators keep what was freed.
    """
    global _resident
    try:
        with open("/proc/self/statm") as f:
            resident = lambda: f.seek(0) or int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE")
            if resident() <= _resident + KEPT_BYTES:
                return
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            _resident = resident()
    except (OSError, AttributeError):  # another system or C library
        pa.default_memory_pool().release_unused()


def cached(function: Callable) -> Callable:
    """Results of ``function``, large tables, kept in this process for tasks to come; :func:`thrifty` functions that have no use for them let them go."""
    own = functools.lru_cache(maxsize=2)(function)
    _caches.append(own)
    return own


def let_go() -> None:
    """Empties what :func:`cached` holds in this process."""
    global _resident
    if any(c.cache_info().currsize for c in _caches):
        for c in _caches:
            c.cache_clear()
        gc.collect()
        _resident = 0
        give_back()


def thrifty(function: Callable, keep: bool = False) -> Callable:
    """``function`` of batches, of a group or of two groups, for a Python worker that gives back freed memory at its end.

    Unless ``keep`` is set, tables that earlier stages left in the worker are let go before.
    """
    before = (lambda: None) if keep else let_go
    if inspect.isgeneratorfunction(function):

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before()
            yield from function(batches)
            give_back()

        return of_batches
    if len(inspect.signature(function).parameters) == 1:

        def of_group(table: pa.Table) -> pa.Table:
            before()
            out = function(table)
            give_back()
            return out

        return of_group

    def of_two(left: pa.Table, right: pa.Table) -> pa.Table:
        before()
        out = function(left, right)
        give_back()
        return out

    return of_two


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    raw, off = buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """(2, spans): 128 bits of ``raw[start:end]`` for every span, by XXH3 of each distinct text among them. ``inside`` tells the bytes of spans."""
    if not len(start):
        return np.zeros((2, 0), np.uint64)
    off = np.concatenate([[0], np.cumsum(end - start)])
    data = raw[inside]
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    distinct = texts.dictionary_encode()  # compares bytes
    own = b"".join(map(xxhash.xxh3_128_digest, distinct.dictionary.to_pylist()))
    return np.ascontiguousarray(np.frombuffer(own, np.uint64).reshape(-1, 2).T)[:, distinct.indices.to_numpy()]


def components(edges: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Connected components of undirected links (a, b): rows (v, root), root the smallest vertex of v's component.

    Alternates large-star and small-star steps (a logarithmic number of rounds). Every round is pre-aggregated by
    ``min`` and written to the shared folder; only two counters come to the driver. Vertices without links are absent.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, under)
    before = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, under)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root")
    return roots.unionAll(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct().join(roots.select("v"), "v", "left_anti"))
