"""Token ids in a bit-plane file format (operator 1).

A file is a Parquet dataset of blocks. Ids run through all documents of a shard in ascending id order and are cut
into blocks of a fixed number of ids. A block's little-endian ids are transposed into planes (byte k of all ids, or bit k
of all ids), each plane is compressed with zstandard and the planes lie one after another in ``data``. The other columns
are the chunk index: shard, chunk, n_ids, the compressed length of each plane, and the document segments in the block.
Readers of the index never touch ``data``; readers of one block never touch another. Spark's writer commits the files,
so a lost executor leaves no partial block, and any storage that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexloom.llm.common import parallelism
from hexloom.llm.transducer import encoder

_FILE = "shard int, chunk long, n_ids int, bits boolean, planes array<int>, doc_id array<long>, ordinal array<long>, seg_from array<long>, seg_len array<int>, doc_len array<long>, data binary"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of uint32 ids, lowest first; trailing planes without a set bit are left out."""
    ids = ids.astype("<u4")
    top = int(ids.max(initial=0)).bit_length()
    rows = ids.view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(-(-top // 8))]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        ids = np.zeros(n, "<u4")
        for k, p in enumerate(planes):
            ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
        return ids
    rows = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        rows[:, k] = np.frombuffer(p, np.uint8)
    return rows.reshape(-1).view("<u4")


def write_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block: int = 65_536, bits: bool = False, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts, ends each with ``end_id`` and writes the dataset at ``path``.

    A null text is the empty one (its only id is the end id). Null ids come first; repeated ids are ordered by text. An
    empty table writes an empty dataset. Extra columns are not read. The one shuffle is by ranges of ids; a task holds one
    block and one piece of text.
    """
    spark = docs.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = encoder(tokenizer), zstandard.ZstdCompressor(level=level)
        shard = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        segs: list[tuple] = []
        size, chunk, ordinal = 0, 0, 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            planes = [press.compress(p) for p in to_planes(ids, bits)]
            values = [shard, chunk, len(ids), bits, [len(p) for p in planes], *([s[k] for s in segs] for k in range(5)), b"".join(planes)]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in _FILE.split(", ")])

        for batch in batches:
            doc = batch.column(0).to_pylist()
            for a, ids, at in enc.encode(batch.column(1)):
                for k in range(len(at) - 1):
                    one = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype(np.uint32)
                    done = 0
                    while done < len(one):
                        part = one[done : done + block - size]
                        held.append(part)
                        segs.append((doc[a + k], ordinal, done, len(part), len(one)))
                        size, done = size + len(part), done + len(part)
                        if size == block:
                            yield row()
                            held, segs, size, chunk = [], [], 0, chunk + 1
                    ordinal += 1
        if size:
            yield row()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = own.repartitionByRange(parallelism(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    dealt.mapInArrow(blocks, _FILE).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index, without the data."""
    return spark.read.schema(_FILE).parquet(path).drop("data")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Decoded ids of every document segment: (shard, ordinal, doc_id, seg_from, doc_len, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids in _decoded(batches):
            cut = np.cumsum([0, *r["seg_len"]])
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(lists), pa.int32()), *(pa.array(r[c], pa.int64()) for c in ("ordinal", "doc_id", "seg_from", "doc_len")), lists], ["shard", "ordinal", "doc_id", "seg_from", "doc_len", "ids"])

    return spark.read.schema(_FILE).parquet(path).mapInArrow(decode, "shard int, ordinal long, doc_id long, seg_from long, doc_len long, ids array<long>")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            cut = np.cumsum([0, *r["planes"]])
            planes = [open_.decompress(r["data"][a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield r, from_planes(planes, r["n_ids"], r["bits"])


def _times(a: int, b: int) -> int:
    """Product of polynomials modulo the CRC-32 polynomial, bits reversed."""
    p = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            p ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return p


def crc_join(first: int, second: int, n: int) -> int:
    """CRC-32 of two strings joined, from theirs and the length of the second."""
    shift, square, n = 1 << 31, 1 << 30, n * 8
    while n:
        if n & 1:
            shift = _times(shift, square)
        square, n = _times(square, square), n >> 1
    return _times(shift, first) ^ second


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded blocks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids in _decoded(batches):
            data, at, crc = ids.tobytes(), 0, []
            for n in r["seg_len"]:
                crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(crc), pa.int32()), *(pa.array(r[c], pa.int64()) for c in ("ordinal", "doc_id", "seg_from", "seg_len", "doc_len")), pa.array(crc, pa.int64())], ["shard", "ordinal", "doc_id", "seg_from", "seg_len", "doc_len", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(3).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["seg_len"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(_FILE).parquet(path)
    segs = blocks.mapInArrow(sums, "shard int, ordinal long, doc_id long, seg_from long, seg_len long, doc_len long, crc long")
    # one row for each shard: a running total over the shards, then the documents before within the shard
    shards = read_index(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    docs = segs.groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("doc_len").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seg_from", "seg_len", "crc"))).alias("parts"))
    docs = docs.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("ordinal")) - F.col("n_tokens"))
    out = docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "parts")
    return out.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
