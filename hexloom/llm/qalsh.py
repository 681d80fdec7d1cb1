"""Approximate nearest neighbours by collision-counting hashing (operator 10).

Every hash is one projection kept as a sorted array. A query opens a window around its own projection in each array and
widens all windows together (virtual rehashing: a wider window is a coarser hash, without a new index). A vector collides once for
each window it lies in; vectors whose collisions reach a threshold are verified with the exact cosine. The first windows have
the threshold that some vectors reach, whichever that is; the k-th best distance among these bounds the search: windows widen
to where a vector at that distance would collide in ``SHARE`` of the projections with ``SURE`` standard deviations to spare. What
has not come to ``SHARE`` there is not nearer, and the query is done.

Rows are dealt into shards by a hash of id and vector, queries into blocks, and each (shard, block) is one bounded task: the shard's rows
come first and are indexed, then the block's queries stream past. Every row is indexed. Equal vectors of a shard are indexed once, so
one very common vector fills no window. Work grows with queries times rows, as a stated query set against all rows does;
nothing is broadcast. Blocks are large, since sorted arrays take six times the space of their vectors (128 projections of 64
components): they are sorted anew for each block, a small part of its work, and not stored and moved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import parallelism

#: Share of the projections in which a vector must collide, standard deviations to spare, first window and its growth.
SHARE, SURE, FIRST, GROWTH = 0.7, 1.5, 0.8, 1.5
#: Vectors verified at the first windows, for each one wanted.
AHEAD = 8
#: Queries of a block.
BLOCK = 65_536


def directions(dim: int, hashes: int, seed: int) -> np.ndarray:
    """(dim, hashes): random orthonormal bases side by side, scaled so that a projection has the length of its vector."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-hashes // dim))]
    return np.concatenate(bases, axis=1)[:, :hashes] * np.sqrt(dim)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two (which is exact) so that the largest component is about 1, and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])
    return x, np.sqrt(in_order(x * x))


def in_order(x: np.ndarray) -> np.ndarray:
    """Row sums, added from the first component to the last whatever the number of rows: equal rows have equal sums."""
    return np.cumsum(x, axis=1)[:, -1]


def reach(hashes: int) -> float:
    """Half a window, in distances, at which a vector collides in SHARE of the projections with SURE deviations to spare."""
    aim = min(SHARE + SURE * math.sqrt(SHARE * (1 - SHARE) / hashes), 0.999)
    low, high = 0.0, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < aim else (low, mid)
    return high


class CollisionIndex:
    """Sorted projections of unit vectors."""

    def __init__(self, unit: np.ndarray, hashes: int = 128, seed: int = 7) -> None:
        self.n, self.ways = len(unit), directions(unit.shape[1], hashes, seed)
        proj = np.ascontiguousarray((unit @ self.ways).T)
        order = np.argsort(proj, axis=1, kind="stable")
        self.apart = 4 * np.sqrt(unit.shape[1]) + 64  # one sorted array for all: each projection has its own stretch
        self.stretch = self.apart * np.arange(hashes)
        self.sorted = (np.take_along_axis(proj, order, axis=1) + self.stretch[:, None]).reshape(-1)
        self.flat = order.reshape(-1)
        self.need, self.reach = math.ceil(SHARE * hashes), reach(hashes)
        self.widest = 2 * float(np.sqrt(unit.shape[1])) + 1

    def search(self, query: np.ndarray, k: int, verify: Callable[[np.ndarray], float]) -> None:
        """Hands the vectors that come to enough collisions to ``verify`` as windows widen, until the distance that it returns bounds the rest."""
        at = query @ self.ways + self.stretch
        count = np.zeros(self.n, np.int64)
        seen = np.zeros(self.n, bool)
        middle = np.searchsorted(self.sorted, at)
        a, b, width = middle, middle, FIRST
        while True:
            wide = width >= self.widest  # each window holds its whole stretch
            left, right = np.searchsorted(self.sorted, np.concatenate([at - width, at + width])).reshape(2, -1)
            if wide:
                left, right = np.arange(len(at)) * self.n, (np.arange(len(at)) + 1) * self.n
            new = [self.flat[i:j] for i, j in zip(np.concatenate([left, b]).tolist(), np.concatenate([a, right]).tolist(), strict=True) if j > i]
            if new:
                count += np.bincount(np.concatenate(new), minlength=self.n)
            a, b = left, right
            least = self.need
            if not seen.any() and self.n > AHEAD * k:
                least = max(min(least, int(np.partition(count, -AHEAD * k)[-AHEAD * k])), 1)
            found = np.flatnonzero((count >= least) & ~seen)
            seen[found] = True
            kth = verify(found)
            if wide or width >= self.reach * kth:
                return
            width = max(self.reach * kth, width) if np.isfinite(kth) else width * GROWTH


class _Shard:
    """The rows of a shard: distinct vectors, each with its ids in ascending order."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, hashes: int, seed: int) -> None:
        by = np.argsort(ids, kind="stable")
        distinct, which = np.unique(x[by], axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        self.ids, self.copies = ids[by][order], copies[by][order]
        self.start = np.searchsorted(which[order], np.arange(len(distinct) + 1))
        self.x, self.length = scaled(distinct)
        self.index = CollisionIndex(self.x / self.length[:, None], hashes, seed)
        self.verified = 0

    def nearest(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k nearest that were found, none of them ``own``."""
        q, qlen = scaled(q[None])
        vectors, scores = np.zeros(0, np.int64), np.zeros(0)
        bound = -np.inf

        def rows_of(f: int) -> int:
            held = slice(self.start[f], min(self.start[f] + k + 1, self.start[f + 1]))
            return int(self.copies[held][self.ids[held] != own].sum())

        def verify(found: np.ndarray) -> float:
            nonlocal vectors, scores, bound
            self.verified += len(found)
            score = in_order(self.x[found] * q) / (self.length[found] * qlen)
            if bound > -np.inf:
                found, score = found[score >= bound], score[score >= bound]
            vectors, scores = np.concatenate([vectors, found]), np.concatenate([scores, score])
            best = np.argsort(-scores, kind="stable")
            total = 0
            for j in best.tolist():  # the best ones until they have k rows
                total += rows_of(int(vectors[j]))
                if total >= k:
                    bound = scores[j]
                    keep = scores >= bound
                    vectors, scores = vectors[keep], scores[keep]
                    return math.sqrt(max(2 - 2 * float(bound), 0.0))
            return np.inf

        self.index.search(q[0] / qlen[0], k, verify)
        near, score = [], []
        for f, s in zip(vectors.tolist(), scores.tolist(), strict=True):
            held = slice(self.start[f], min(self.start[f] + k + 1, self.start[f + 1]))
            rest = np.repeat(self.ids[held], self.copies[held])
            rest = rest[rest != own][:k]
            near.append(rest)
            score.append(np.full(len(rest), s))
        near, score = np.concatenate([np.zeros(0, np.int64), *near]), np.concatenate([np.zeros(0), *score])
        top = np.lexsort((near, -score))[:k]
        return near[top], score[top]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, hashes: int = 128, shard_rows: int = 8192, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the ``k`` nearest others by cosine.

    Null, empty, zero vectors and those with null or non-finite components take no part, nor do rows without an id.
    Components of any size do: vectors are scaled by powers of two before they are multiplied, and sums run in the order of the
    components, so equal vectors have equal scores wherever they lie. Vectors of another number of components than the query's
    are no candidates. Ties go to the smaller id; repeated rows are candidates each, but never a query's own id; a query id with
    several vectors has its nearest by any of them. Fewer than k candidates give fewer rows; an empty table none. Other columns are not read.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own = own.where(F.coalesce(sound, F.lit(False)))
    own = own.groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")).withColumn("dim", F.size("embedding"))
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, q = own.agg(F.count("*"), F.count_if(asked)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // BLOCK))
    spread = lambda parts, salt: F.pmod(F.xxhash64("vec_id", "embedding", F.lit(salt)), F.lit(parts)).cast("int")
    every_one = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = own.withColumn("shard", spread(shards, 0)).withColumn("block", every_one(blocks)).withColumn("asks", F.lit(0))
    ask = own.where(asked).withColumn("block", spread(blocks, 1)).withColumn("shard", every_one(shards)).withColumn("asks", F.lit(1))
    cols = ["shard", "block", "dim", "asks", "vec_id", "copies", "embedding"]
    both = rows.select(*cols).unionAll(ask.select(*cols)).repartition(min(shards * blocks, 8 * parallelism(vectors.sparkSession)), "shard", "block", "dim").sortWithinPartitions(*cols[:4])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            names = np.stack([np.asarray(batch.column(c)) for c in range(4)]) if batch.num_rows else np.zeros((4, 0), np.int64)
            cut = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if tuple(names[:3, a]) != key:
                    key, held, shard = tuple(names[:3, a]), [], None
                ids, copies, x = np.asarray(batch.column(4))[a:b], np.asarray(batch.column(5))[a:b], _matrix(batch.column(6).slice(a, b - a))
                if not names[3, a]:
                    held.append((ids, copies, x))
                    continue
                if shard is None and held:
                    shard, held = _Shard(*(np.concatenate(c) for c in zip(*held, strict=True)), hashes, seed), []
                if shard is not None:
                    found = [(i, *shard.nearest(int(i), v, k)) for i, v in zip(ids, x, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f[1]) for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
