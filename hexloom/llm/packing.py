"""Best-fit packing with Martello-Toth dominance reduction (operator 2).

Sequences have a fixed capacity, so an instance is a histogram: at most ``capacity`` lengths with their counts, whatever the
number of documents. The driver reduces and packs that histogram and gets *patterns*: (how many sequences, which
lengths each holds). Every step opens at most three new patterns, so their number is bounded by the capacity, not by the data.
Pieces then find their place alone: the rank of a piece among those of its length (partition offset + rank
inside the partition) points into a pattern. No group of pieces meets in one task; only the histogram comes to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import thrifty, written
from hexloom.llm.transducer import encoder

Pattern = tuple[int, list[tuple[int, int]]]


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixes sequences that provably lose nothing: (patterns, what is left).

    For the largest length j in turn, with room r = capacity - j: nothing fits -> alone; a piece of exactly r -> that
    pair; only one more piece can ever fit -> the largest that does; at most two more fit and no two of them
    beat the largest one piecewise -> that piece, or that piece and the best second one. Each fixed set holds, piece for
    piece, at least what any other feasible set with j does (the dominance criterion), so some optimum contains it.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[Pattern] = []

    def take(items: list[int], n: int) -> None:
        own: dict[int, int] = {}
        for k in items:
            own[k] = own.get(k, 0) + 1
        n = min(n, *(left[k] // c for k, c in own.items()))
        fixed.append((n, sorted(own.items(), reverse=True)))
        for k, c in own.items():
            left[k] -= c * n
            if not left[k]:
                del left[k]

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                own = left[j]
                room = capacity - j
                avail = lambda k, j=j: left.get(k, 0) - (k == j)
                fits = sorted((k for k in left if k <= room and avail(k) > 0), reverse=True)
                if not fits:
                    take([j], own)
                elif fits[0] == room:
                    take([j, room], own)
                else:
                    small: list[int] = []
                    for k in reversed(fits):
                        small += [k] * min(3 - len(small), avail(k))
                        if len(small) >= 3:
                            break
                    best = fits[0]
                    if len(small) < 2 or small[0] + small[1] > room:
                        take([j, best], own)
                    elif len(small) < 3 or sum(small[:3]) > room:
                        pairs = [(a, b) for a in fits for b in fits if b <= a and a + b <= room and (a != b or avail(a) > 1)]
                        second = max((b for a, b in pairs if a == best), default=0)
                        if all(a + b <= best for a, b in pairs):
                            take([j, best], own)
                        elif second and all(b <= second for _, b in pairs):
                            take([j, best, second], own)
                        else:
                            break
                    else:
                        break
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: equal sequences are filled together."""
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}  # room -> (how many, what is in them)
    for k in sorted(counts, reverse=True):
        n = counts[k]
        for room in sorted((r for r in open_ if r >= k)):
            while n and open_.get(room):
                many, has = open_[room].pop()
                each = room // k
                full = min(many, n // each)
                if full:
                    open_.setdefault(room - each * k, []).append((full, (*has, (k, each))))
                    n -= full * each
                    many -= full
                if many and n:  # fewer are left than one sequence takes
                    open_.setdefault(room - n * k, []).append((1, (*has, (k, n))))
                    n, many = 0, many - 1
                if many:
                    open_[room].append((many, has))
        each = capacity // k
        if n // each:
            open_.setdefault(capacity - each * k, []).append((n // each, ((k, each),)))
        if n % each:
            open_.setdefault(capacity - n % each * k, []).append((1, ((k, n % each),)))
    return [(many, list(has)) for groups in open_.values() for many, has in groups]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = dominance_reduction(counts, capacity)
    return fixed + best_fit(left, capacity)


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece, with its partition and its rank among the partition's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            doc = batch.column(0).to_pylist()
            for a, ids, at in enc.encode(batch.column(1)):
                rows: list[tuple] = []
                for k in range(len(at) - 1):
                    one = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4")
                    data, n = one.tobytes(), len(one)
                    start, piece = 0, 0
                    while start < n:
                        end = start + ((n - 1) % capacity + 1 if start == 0 else capacity)  # the first piece may be shorter
                        rows.append((doc[a + k], piece, start, end - start, zlib.crc32(data[4 * start : 4 * end]), seen[end - start]))
                        seen[end - start] += 1
                        start, piece = end, piece + 1
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array([part] * len(rows), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(thrifty(cut, keep=True), "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A null text is the empty one (one piece: the end id). Longer texts are cut whole into pieces of ``capacity`` after a
    first piece of the remainder. Repeated rows and ids, null ids among them, are packed as often as they stand; an
    empty table gives an empty table; other columns are not read. Pieces of one length are alike, so ties have no effect
    on how many sequences there are. Written once, since ranks must not change when an executor is lost.
    """
    cut = written(pieces_of(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    tally = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = tally.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, offset, pieces in each sequence
    rank: dict[int, int] = dict.fromkeys(counts, 0)
    sequence = 0
    for many, has in pack_histogram(counts, capacity):
        offset = 0
        for k, each in has:
            table.append((k, rank[k], sequence, offset, each))
            rank[k] += many * each
            offset += k * each
        sequence += many
    plan = np.array(sorted(table), np.int64).reshape(-1, 5)
    first = np.searchsorted(plan[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                a, b = first[k], first[k + 1]
                at[own] = a + np.searchsorted(plan[a:b, 1], rank[own], "right") - 1
            _, low, sequence, offset, each = plan[at].T
            inside = rank - low
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence + inside // each), pa.array(offset + inside % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(thrifty(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
