"""Exact set-similarity join on word shingles by set-relation skipping (operator 9).

1. Documents are dealt into groups by id and text; each group forms every text's set of 128-bit shingle hashes, made from 128-bit
   hashes of whole words (two lanes that share nothing). Exact copies have equal sets, hence equal 128-bit digests, and count once
   from here on. Where fewer bits are used below, a clash only adds a candidate or shifts a frequency.
2. Document frequencies: each group sends its distinct hashes, sorted, delta- and plane-coded, to ranges of hashes, and is
   sent back one frequency class for each. A shingle in a third of all texts costs one entry a group, so no range is
   hot. Beyond ``FAN`` ranges the way has two steps: groups send to ``FAN`` wide ranges, where as many groups are merged with summed
   counts and sent on to the ranges inside, and classes come back by the same steps. So messages stay large and their number
   grows with the groups, not with groups times ranges. Sets are ordered by (class, hash), rare first; shingles found in one set only never join anything, and a set
   whose prefix has no other shingle is done.
3. Prefixes that share a shingle put their sets into one candidate family (min-label links, connected components).
4. In a family, members lie in order of size in the inverted lists; a probe skips the blocks of every list that size bounds
   rule out. Answers of a set are derived from those of a highly similar set that was just answered, by the
   lists of the shingles in which they differ. Sets of one component need no answer from each other, so a family of
   copies takes about as many probes as it has components. Families beyond ``chunk`` members are
   resolved in random chunks twice, then only members outside the largest component are probed against all the rest, in
   blocks. Every link between components is thus looked for exactly; none is sampled.
5. Components of the links give each document the smallest id reachable.

Where the number of links is asked for, no probe is skipped: step 4 becomes one pass in which every distinct set is held against
all of its family, in pairs of blocks beyond ``chunk`` members, and each hit weighs as many documents as have that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import PIECE_BYTES, buffers, components, mix, parallelism, release, shared_folder, span_hashes, thrifty, written

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SALT = mix(np.array(_STEP))
CODE_SHIFT, CODE_BITS = np.uint64(16), 48
#: Ranges to which a group, or as many groups merged, sends its hashes at once.
FAN = 2048
#: Sets with candidates whose families are broadcast (tens of MB); beyond, sets are joined to their families by a shuffle.
BROADCAST_SETS = 500_000


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingle hashes of every text, two rows of 64 bits, in order."""
    n = len(raw)
    if n == 0:
        return np.zeros((2, 0), np.uint64), np.zeros(len(off), np.int64)
    low = _LOWER[raw]
    inside = ~_SEP[low]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    w = span_hashes(low, start, end, inside)
    wb = np.searchsorted(start, off)
    m = w.shape[1]
    shingle = np.zeros((2, max(m - words + 1, 0)), np.uint64)
    for k in range(words):
        shingle += mix(w[:, k : m - words + 1 + k] + _SALT[k % 5] + np.uint64(k))
    shingle = mix(shingle)
    out, bounds = [np.zeros((2, 0), np.uint64)], [0]
    for a, b in zip(wb[:-1].tolist(), wb[1:].tolist(), strict=True):
        if b - a >= words:
            s = _distinct(shingle[:, a : b - words + 1])
        elif b > a:
            s = np.full((2, 1), b - a, np.uint64)
            for k in range(a, b):
                s = mix((s ^ w[:, k : k + 1]) + _SALT[(k - a) % 5])
        else:
            s = out[0]
        out.append(s)
        bounds.append(bounds[-1] + s.shape[1])
    return np.concatenate(out, axis=1), np.array(bounds, np.int64)


def _distinct(s: np.ndarray) -> np.ndarray:
    """Distinct columns in order."""
    s = s[:, np.argsort(s[0])]
    same = s[0, 1:] == s[0, :-1]
    if same.any():
        if (s[1, 1:] != s[1, :-1])[same].any():  # one half alike: the other one decides
            s = s[:, np.lexsort((s[1], s[0]))]
        s = s[:, np.concatenate([[True], (s[:, 1:] != s[:, :-1]).any(axis=0)])]
    return s


def _digests(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits of every set; None for the empty set."""
    n = np.diff(bounds)
    total = np.zeros((2, h.shape[1] + 1), np.uint64)
    for lane in (0, 1):
        np.add.accumulate(mix(h[lane] ^ _STEP[lane]), out=total[lane, 1:])
    d = total[:, bounds[1:]] - total[:, bounds[:-1]]
    d = np.ascontiguousarray(mix(d + n.astype(np.uint64) * _STEP[2]).T)
    data = d.tobytes()
    return [data[16 * k : 16 * k + 16] if n[k] else None for k in range(len(n))]


def numbered(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of all shingles of the sets in a row, equal where all 128 bits are."""
    both = np.concatenate(sets, axis=1)
    _, first, ids = np.unique(both[0], return_index=True, return_inverse=True)
    if (both[1] != both[1][first][ids]).any():
        _, ids = np.unique(both, axis=1, return_inverse=True)
    return ids.reshape(-1)


def _pack(a: np.ndarray) -> bytes:
    """Byte planes under zstandard."""
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=2**31 - 1), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


class _Group:
    """The sets of one group of documents."""

    def __init__(self, table: pa.Table, words: int) -> None:
        self.ids = table.column("doc_id")
        raw, off = buffers(table.column("text"))
        parts, at = [np.zeros((2, 0), np.uint64)], [np.zeros(1, np.int64)]
        n, a = len(off) - 1, 0
        while a < n:  # bounded working arrays
            b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + PIECE_BYTES, "right")) - 1))
            h, bounds = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], words)
            parts.append(h)
            at.append(bounds[1:] + at[-1][-1])
            a = b
        self.h, self.bounds = np.concatenate(parts, axis=1), np.concatenate(at)
        self.digest = _digests(self.h, self.bounds)
        seen: set[bytes] = set()
        self.own = [d is not None and not (d in seen or seen.add(d)) for d in self.digest]
        keep = np.repeat(np.array(self.own, bool), np.diff(self.bounds))
        self.codes, self.count = np.unique(self.h[0, keep] >> CODE_SHIFT, return_counts=True)


def _range_of(codes: np.ndarray, ranges: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """Bounds in sorted codes of each range of equal length, of all hashes or of the ``part``-th of ``parts`` stretches."""
    edges = ((part * ranges + np.arange(1, ranges, dtype=object)) * 2**CODE_BITS // (ranges * parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(codes, edges), [len(codes)]]).astype(np.int64)


def _messages(head: tuple[int, ...], at: np.ndarray, codes: np.ndarray, count: np.ndarray, names: list[str]) -> pa.Table:
    """One row for each range that holds codes: ``head``, the range, codes and counts."""
    rows = [(*head, r, _pack(np.diff(codes[a:b], prepend=np.uint64(0))), _pack(count[a:b].astype(np.uint32))) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
    kinds = [*[pa.int32()] * (len(head) + 1), pa.binary(), pa.binary()]
    return pa.table([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each message, all distinct codes, their summed counts, and the place of each code of all messages among them."""
    codes = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("codes").to_pylist()]
    counts = np.concatenate([_unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
    distinct, back = np.unique(np.concatenate(codes), return_inverse=True)
    return codes, distinct, np.bincount(back, weights=counts).astype(np.int64), back


def _classes_back(table: pa.Table, keys: list[str], codes: list[np.ndarray], cls: np.ndarray) -> pa.Table:
    cut = np.cumsum([0, *map(len, codes)])
    return pa.table([*(table.column(k) for k in keys), pa.array([_pack(cls[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], [*keys, "classes"])


def _in_order(table: pa.Table, by: str) -> np.ndarray:
    parts = sorted(zip(table.column(by).to_pylist(), table.column("classes").to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, np.uint8), *(_unpack(x, np.uint8) for _, x in parts)])


def _frequency_class(df: np.ndarray) -> np.ndarray:
    return np.where(df < 2, 1, np.minimum(255, 2 + np.floor(8 * np.log2(np.maximum(df, 2) / 2)))).astype(np.uint8)


_SETS = "doc_id long, text_hash binary, n int, digest binary, k int, shared binary"


def document_sets(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 4_000_000) -> DataFrame:
    """Steps 1 and 2: one row a document; ``shared`` (ordered hashes known to other sets too) once for each set of a group
    that may link, and k, how many of them are its prefix."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.substring(F.unhex(F.sha2(text_col, 256)), 1, 16).alias("text_hash"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(parallelism(spark), -(-size // group_bytes))
    ranges = max(parallelism(spark), groups // 4)
    own = own.withColumn("gid", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(groups)).cast("int"))

    fan = min(ranges, FAN)
    within = -(-ranges // fan)

    def request(table: pa.Table) -> pa.Table:
        g = _Group(table, words)
        return _messages((table.column("gid")[0].as_py(),), _range_of(g.codes, fan), g.codes, g.count, ["gid", "part", "codes", "counts"])

    def count(table: pa.Table) -> pa.Table:
        codes, _, total, back = _merged(table)
        return _classes_back(table, ["gid", "part"], codes, _frequency_class(total)[back])

    def pass_on(table: pa.Table) -> pa.Table:
        _, distinct, total, _ = _merged(table)
        head = table.column("many")[0].as_py(), table.column("part")[0].as_py()
        return _messages(head, _range_of(distinct, within, head[1], fan), distinct, total, ["many", "part", "sub", "codes", "counts"])

    def count_within(table: pa.Table) -> pa.Table:
        codes, _, total, back = _merged(table)
        return _classes_back(table, ["many", "part", "sub"], codes, _frequency_class(total)[back])

    def pass_back(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, _, _, back = _merged(left)
        return _classes_back(left, ["gid", "part"], codes, _in_order(right, "sub")[back])

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        g = _Group(left, words)
        cls = _in_order(right, "part")
        n, k, shared = np.diff(g.bounds), [], []
        for d, own_set in enumerate(g.own):
            h = g.h[:, g.bounds[d] : g.bounds[d + 1]]
            found = None
            if own_set:
                c = cls[np.searchsorted(g.codes, h[0] >> CODE_SHIFT)]
                prefix = len(c) - -(-percent * len(c) // 100) + 1
                many = c > 1
                left_over = prefix - (len(c) - int(many.sum()))
                if left_over > 0:
                    h, c = h[:, many], c[many]
                    found = left_over, h[:, np.lexsort((h[1], h[0], c))].tobytes()
            k.append(found and found[0])
            shared.append(found and found[1])
        return pa.table([g.ids, left.column("text_hash"), pa.array(n, pa.int32()), pa.array(g.digest, pa.binary()), pa.array(k, pa.int32()), pa.array(shared, pa.binary())], ["doc_id", "text_hash", "n", "digest", "k", "shared"])

    sent = own.groupBy("gid").applyInArrow(thrifty(request), "gid int, part int, codes binary, counts binary")
    if within == 1:
        back = sent.groupBy("part").applyInArrow(thrifty(count), "gid int, part int, classes binary")
    else:
        sent = written(sent.withColumn("many", F.floor(F.col("gid") / fan).cast("int")), "hashes")
        merged = sent.groupBy("many", "part").applyInArrow(thrifty(pass_on), "many int, part int, sub int, codes binary, counts binary")
        within_back = merged.groupBy("part", "sub").applyInArrow(thrifty(count_within), "many int, part int, sub int, classes binary")
        back = sent.groupBy("many", "part").cogroup(within_back.groupBy("many", "part")).applyInArrow(thrifty(pass_back), "gid int, part int, classes binary")
    return own.groupBy("gid").cogroup(back.groupBy("gid")).applyInArrow(thrifty(reply), _SETS)


def _to_sets(family: DataFrame) -> DataFrame:
    """``family``, a written table, as the side of a join with sets: broadcast where its rows, counted, are few, so that sets move once."""
    return F.broadcast(family) if family.count() <= BROADCAST_SETS else family


def _label(digest: str = "digest") -> F.Column:
    """64 bits of a digest: names sets while candidates are looked for, where a clash only adds a probe."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long")


def candidate_families(sets: DataFrame, under: str | None = None) -> DataFrame:
    """Step 3: (v, root) of sets whose prefixes are connected by shared shingles."""
    parts = parallelism(sets.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = [np.frombuffer(s, np.uint64)[:k] for k, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            token = np.concatenate([np.zeros(0, np.uint64), *prefix])
            v = np.repeat(batch.column(0).to_numpy(), [len(p) for p in prefix])
            first, links = _least(token, v)
            token, v = first
            part = mix(token) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(r, token[order[a:b]].tobytes(), v[order[a:b]].tobytes(), links.tobytes() if r == 0 else b"") for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a or r == 0]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "token", "v", "links"])

    def meet(table: pa.Table) -> pa.Table:
        join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
        _, links = _least(join("token", np.uint64), join("v", np.int64))
        links = np.unique(np.concatenate([links, join("links", np.int64).reshape(-1, 2)]), axis=0)
        return pa.table([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    found = sets.where("shared is not null").select(_label().alias("v"), "k", "shared").mapInArrow(thrifty(local), "part int, token binary, v binary, links binary")
    return components(found.groupBy("part").applyInArrow(thrifty(meet), "a long, b long"), "families", under)


def _least(token: np.ndarray, v: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The smallest v of every token, and distinct links (v, that smallest) of the others."""
    if not len(token):
        return (token, v), np.zeros((0, 2), np.int64)
    order = np.lexsort((v, token))
    token, v = token[order], v[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    least = v[new][np.cumsum(new) - 1]
    off = least != v
    links = np.unique(np.stack([v[off], least[off]], axis=1), axis=0) if off.any() else np.zeros((0, 2), np.int64)
    return (token[new], v[new]), links


def resolve(sets: list[np.ndarray], n: np.ndarray, percent: int, label: np.ndarray | None = None, probe: np.ndarray | None = None) -> np.ndarray:
    """Step 4 in memory: component labels of the members; with ``probe``, those members are held against all.

    sets: shared hashes of each member, two rows; n: full sizes; label: components known before.
    """
    m = len(sets)
    by = np.argsort(n, kind="stable")
    n = n[by]
    comp = np.arange(m) if label is None else np.unique(label[by], return_inverse=True)[1]
    todo = np.ones(m, bool) if probe is None else probe[by].copy()
    only = probe is not None
    lens = np.array([sets[i].shape[1] for i in by])
    ids = numbered([sets[i] for i in by])
    at = np.concatenate([[0], np.cumsum(lens)])
    owner = np.repeat(np.arange(m), lens)
    order = np.argsort(ids, kind="stable")  # inverted lists, members in order of size
    lists, bounds = owner[order], np.searchsorted(ids[order], np.arange(ids.max(initial=-1) + 2))
    spot = lists + ids[order] * m  # (shingle, member) in one sorted key: finds a block's ends by bisection

    def tally(keys: np.ndarray, lo: int, hi: int) -> np.ndarray:
        a, b = np.searchsorted(spot, keys * m + lo), np.searchsorted(spot, keys * m + hi)
        size = b - a
        total = int(size.sum())
        take = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)
        return np.bincount(lists[take], minlength=m)

    last: tuple[np.ndarray, np.ndarray, int, int] | None = None
    while True:
        left = np.flatnonzero(todo)
        if not len(left):
            break
        if not only:
            tops = np.bincount(comp[left])
            left = left[comp[left] != tops.argmax()] if len(left) > 1 and tops.max() < len(left) else left[:0]
            if not len(left):
                break
        near = left[comp[left] == comp[last_p]] if last is not None else left[:0]
        p = int(near[0] if len(near) else left[0])
        todo[p] = False
        lo, hi = int(np.searchsorted(n * 100, n[p] * percent)), int(np.searchsorted(n * percent, n[p] * 100, "right"))
        mine = ids[at[p] : at[p + 1]]
        derived = None
        if last is not None and last[2] <= lo and hi <= last[3]:
            gone, new = np.setdiff1d(last[0], mine, assume_unique=True), np.setdiff1d(mine, last[0], assume_unique=True)
            if len(gone) + len(new) < len(mine) // 2:
                derived = last[1] - tally(gone, lo, hi) + tally(new, lo, hi)
                derived[:lo], derived[hi:] = 0, 0
        overlap = tally(mine, lo, hi) if derived is None else derived
        last, last_p = (mine, overlap, lo, hi), p
        linked = np.flatnonzero((100 + percent) * overlap >= percent * (n[p] + n))
        linked = linked[(linked >= lo) & (linked < hi)]
        names = np.unique(np.append(comp[linked], comp[p]))
        if len(names) > 1:
            comp[np.isin(comp, names)] = names[0]
    out = np.empty(m, np.int64)
    out[by] = comp
    return out


def count_links(sets: list[np.ndarray], n: np.ndarray, k: np.ndarray, weight: np.ndarray, percent: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the members and the weight of all others that each links with; if there are two sides, of those on the other one.

    sets: shared hashes of each member, its prefix of k first; n: full sizes.
    """
    m = len(sets)
    by = np.argsort(n, kind="stable")
    n, k, weight, side = n[by], k[by], weight[by], side[by]
    two = side.min() != side.max()
    lens = np.array([sets[i].shape[1] for i in by])
    ids = numbered([sets[i] for i in by])
    at = np.concatenate([[0], np.cumsum(lens)])
    owner = np.repeat(np.arange(m), lens)
    order = np.argsort(ids, kind="stable")  # inverted lists, members in order of size
    lists = owner[order]
    spot = lists + ids[order] * m

    def tally(keys: np.ndarray, lo: int, hi: int) -> np.ndarray:
        a, b = np.searchsorted(spot, keys * m + lo), np.searchsorted(spot, keys * m + hi)
        size = b - a
        take = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(lists[take], minlength=m)

    comp, links = np.arange(m), np.zeros(m, np.int64)
    todo = side == side.min()
    full: tuple[np.ndarray, np.ndarray, int, int] | None = None  # the last answer that holds every member of its sizes
    linked = np.zeros(0, np.int64)
    for _ in range(int(todo.sum())):
        near = linked[todo[linked]]
        p = int(near[overlap[near].argmax()]) if len(near) else int(todo.argmax())
        todo[p] = False
        lo, hi = int(np.searchsorted(n * 100, n[p] * percent)), int(np.searchsorted(n * percent, n[p] * 100, "right"))
        mine = ids[at[p] : at[p + 1]]
        overlap = None
        if full is not None and full[2] <= lo and hi <= full[3]:
            gone, new = np.setdiff1d(full[0], mine, assume_unique=True), np.setdiff1d(mine, full[0], assume_unique=True)
            if len(gone) + len(new) < len(mine) // 2:
                overlap = full[1] - tally(gone, full[2], full[3]) + tally(new, full[2], full[3])
                full = mine, overlap, full[2], full[3]
        if overlap is None:
            found = np.flatnonzero(tally(mine[: k[p]], lo, hi))
            if int(lens[found].sum()) * 4 < len(mine) * (hi - lo):  # few share the prefix: only those are counted
                of = np.repeat(found, lens[found])
                take = np.repeat(at[found] - (np.cumsum(lens[found]) - lens[found]), lens[found]) + np.arange(len(of))
                overlap = np.bincount(of[np.isin(ids[take], mine)], minlength=m)
            else:  # some more sizes, for the answers derived from this one
                wide = int(np.searchsorted(n * 1000, n[p] * percent * 9)), int(np.searchsorted(n * percent * 10, n[p] * 1100, "right"))
                overlap = tally(mine, *wide)
                full = mine, overlap, *wide
        linked = np.arange(lo, hi)[(100 + percent) * overlap[lo:hi] >= percent * (n[p] + n[lo:hi])]
        hit = linked[(side[linked] != side[p]) if two else (linked != p)]
        links[p] += weight[hit].sum()
        if two:
            links[hit] += weight[p]
        names = np.unique(np.append(comp[linked], comp[p]))
        if len(names) > 1:
            comp[np.isin(comp, names)] = names[0]
    labels, counts = np.empty(m, np.int64), np.empty(m, np.int64)
    labels[by], counts[by] = comp, links
    return labels, counts


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches in the order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _links_of(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links of each group of keys, as (member, smallest member of its component)."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, keys):
            rows = {}
            for d, n, s, known, probe in zip(*(table.column(c).to_pylist() for c in ("digest", "n", "shared", "known", "probe")), strict=True):
                rows[d] = n, s, known, probe or (d in rows and rows[d][3])
            if len(rows) < 2:
                continue
            n, shared, known, probe = zip(*rows.values(), strict=True)
            plain = not any(known)
            comp = resolve([np.frombuffer(s, np.uint64).reshape(2, -1) for s in shared], np.array(n, np.int64), percent, None if plain else np.array([k or d for k, d in zip(known, rows, strict=True)]), None if plain else np.array(probe))
            first: dict[int, bytes] = {}
            for d, c in zip(rows, comp, strict=True):
                first[c] = min(d, first.get(c, d))
            pairs = [(d, first[c]) for d, c in zip(rows, comp, strict=True) if first[c] != d]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    dealt = members.repartition(parallelism(members.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "digest", "n", "shared", "known", "probe").mapInArrow(thrifty(links), "a binary, b binary")


def _counted_links(members: DataFrame, percent: int, chunk: int) -> DataFrame:
    """(a, b, n_links): for each member its links with others, and the smallest member of its component, of a family's pair of blocks."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["root", "i", "j"]):
            rows = {r[0]: r[1:] for r in zip(*(table.column(c).to_pylist() for c in ("digest", "n", "shared", "k", "copies", "block")), strict=True)}
            if len(rows) < 2:
                continue
            n, shared, k, copies, block = zip(*rows.values(), strict=True)
            if table.column("i")[0] != table.column("j")[0] and min(block) == max(block):
                continue  # the other block is empty
            comp, count = count_links([np.frombuffer(s, np.uint64).reshape(2, -1) for s in shared], *(np.array(x, np.int64) for x in (n, k, copies)), percent, np.array(block, np.int64))
            first: dict[int, bytes] = {}
            for d, c in zip(rows, comp, strict=True):
                first[c] = min(d, first.get(c, d))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([first[c] for c in comp], pa.binary()), pa.array(count)], ["a", "b", "n_links"])

    blocks = F.ceil(F.col("size") / chunk).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("v", F.lit(5)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    keys = ["root", "i", "j"]
    dealt = dealt.repartition(parallelism(members.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "digest", "n", "shared", "k", "copies", "block").mapInArrow(thrifty(links), "a binary, b binary, n_links long")


def similarity_links(docs: DataFrame, words: int = 5, percent: int = 75, chunk: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, n_links): as :func:`similarity_components`, and with how many other rows each
    row is linked, its exact copies among them; rows without shingles have no links."""
    spark = docs.sparkSession
    under = shared_folder(spark, "similarity")
    sets = written(document_sets(docs, words, percent, id_col, text_col), "sets")
    family = candidate_families(sets, under)
    copies = sets.where("digest is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    copies = written(copies.withColumn("v", _label()), "copies", under)
    sizes = family.groupBy("root").agg(F.count("*").alias("size"))
    family = written(family.join(sizes, "root").where("size > 1").join(copies.drop("least"), "v"), "families", under)
    able = sets.where("shared is not null").select("digest", "n", "shared", "k").join(_to_sets(family), "digest")
    links = written(_counted_links(able, percent, chunk), "links", under)
    counts = links.groupBy(F.col("a").alias("digest")).agg(F.sum("n_links").alias("others"))
    roots = components(links.select("a", "b"), "classes", under).select(F.col("v").alias("digest"), "root")
    classes = copies.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    ends = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(ends, "root").join(counts, "digest", "left")
    classes = written(classes.select("digest", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "classes")
    release(spark, under)
    out = sets.select("doc_id", "text_hash", "n", "digest").join(classes, "digest", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 75, chunk: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`similarity_classes` without class_key."""
    return similarity_classes(docs, words, percent, chunk, id_col, text_col).drop("class_key")


def similarity_classes(docs: DataFrame, words: int = 5, percent: int = 75, chunk: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, class_key) of every row: texts whose shingle sets have a Jaccard likeness of ``percent`` /
    100 or more are linked; component_id is the smallest id reachable.

    Null, empty and blank texts have 0 shingles and link with nothing: component_id is their own id. Texts of fewer
    words than ``words`` are one shingle. Repeated rows give repeated results; a null id takes part and ranks after all
    others (a component of null ids only has a null id). class_key names a component even where ids are null or repeated;
    it is null for rows without shingles. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    under = shared_folder(spark, "similarity")
    sets = written(document_sets(docs, words, percent, id_col, text_col), "sets")
    family = candidate_families(sets, under)
    sizes = family.groupBy("root").agg(F.count("*").alias("size"))
    family = written(family.join(sizes, "root"), "families", under)
    nothing = [F.lit(None).cast("binary").alias("known"), F.lit(False).alias("probe")]
    # one set may come from several groups: equal digests meet under one label
    able = sets.where("shared is not null").select("digest", "n", "shared", _label().alias("v")).join(_to_sets(family), "v")
    deal = lambda salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.ceil(F.col("size") / chunk)).cast("int").alias("chunk")
    links = written(_links_of(able.select("root", "digest", "n", "shared", *nothing, deal(1)), ["root", "chunk"], percent), "links", under)
    large = able.where(F.col("size") > chunk)
    if not family.where(F.col("size") > chunk).isEmpty():
        again = _links_of(large.select("root", "digest", "n", "shared", *nothing, deal(2)), ["root", "chunk"], percent)
        links = written(links.unionAll(again), "links", under)
        known = components(links, "known", under)
        there = written(large.join(known.select(F.col("v").alias("digest"), F.col("root").alias("known")), "digest", "left").withColumn("known", F.coalesce("known", "digest")), "large", under)
        tally = there.select("root", "known", "digest", "size").distinct().groupBy("root", "known").agg(F.count("*").alias("of"), F.max("size").alias("size"))
        top = tally.groupBy("root").agg(F.max_by("known", F.struct("of", "known")).alias("top"), F.sum("of").alias("all"), F.max("of").alias("most"))
        top = written(top.withColumn("strays", F.col("all") - F.col("most")).where("strays > 0"), "strays", under)
        if not top.isEmpty():
            rest = there.join(top, "root").withColumn("blocks", F.ceil(F.col("strays") / chunk).cast("int")).withColumn("chunks", F.ceil(F.col("all") / chunk).cast("int"))
            stray = rest.where("known <> top").withColumn("block", F.pmod(F.xxhash64("v", F.lit(3)), "blocks")).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("probe", F.lit(True))
            every = rest.withColumn("chunk", F.pmod(F.xxhash64("v", F.lit(4)), "chunks").cast("int")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)"))).withColumn("probe", F.lit(False))
            cols = ["root", "block", "chunk", "digest", "n", "shared", "known", "probe"]
            links = written(links.unionAll(_links_of(stray.select(*cols).unionAll(every.select(*cols)), ["root", "block", "chunk"], percent)), "links", under)
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("least")).where("digest is not null")
    roots = components(links, "classes", under).select(F.col("v").alias("digest"), "root")
    classes = classes.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    ends = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(classes.join(ends, "root").select("digest", "component_id", F.col("root").alias("class_key")), "classes")
    release(spark, under)
    out = sets.select("doc_id", "text_hash", "n", "digest").join(classes, "digest", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "class_key")
