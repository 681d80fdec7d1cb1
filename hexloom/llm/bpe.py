"""Byte-pair merges compiled into a deterministic finite-state transducer that emits token counts.

Which token ends at a byte of a pre-token depends on the bytes before it in a bounded way: of the tokens that are a suffix
there, exactly one may stand behind the last token of the rest. Two tokens may stand side by side if none of the merges that
build them is overtaken by a merge across their border; a sequence of tokens is what the merges give if that holds for each pair.
Read as a machine, the vocabulary's trie is a nondeterministic transducer with weights: an item is a trie node, the last
token before the node's text, and how many tokens stand before it. Sets of items are determinised as they are met, so a
state is one such set and a transition has a byte, a state and the number of tokens by which the count grows (it can be zero
or less, where tokens melt into one). States and transitions are interned by their exact contents, in tables of bounded size.

A run is cut into chunks. Each chunk has a state map: entry state -> exit state and emitted count, for every state that the
chunk before can leave it in. Maps compose associatively, so a parallel prefix scan over the chunks gives all counts.
"""

from __future__ import annotations

import bisect

import numpy as np

#: Bytes of a chunk, and bytes before a chunk from which its likeliest entry state is found.
CHUNK, WARM = 256, 32
#: States beyond which the tables are emptied before the next run; and the most bytes that one run takes.
STATES, RUN_BYTES = 400_000, 500_000
START, NONE = 0, -1
_EMPTY = np.int64(-1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where it can be printed, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary's merges: which tokens can come out of them, and which pairs can stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        letters = byte_letters()
        self.pair: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for letter in letters:
            self.made[vocab[letter]] = -1
        for rank, (a, b) in enumerate(merges):
            self.pair[vocab[a], vocab[b]] = rank
        for rank, (a, b) in enumerate(merges):
            x, y, whole = vocab[a], vocab[b], vocab[a + b]
            if x in self.made and y in self.made and whole not in self.made:
                if max(self.made[x], self.made[y]) > rank:
                    raise ValueError("a merge comes before those of its parts")
                if not self._overtaken(x, y, rank):
                    self.left[whole], self.right[whole], self.made[whole] = x, y, rank
        self.text = {vocab[t]: bytes(letters[c] for c in t) for t in vocab if vocab[t] in self.made}
        self.alike = self._classes()

    def _classes(self) -> dict[int, int]:
        """For each token the first one that any token may follow if and only if it may follow this one.

        What may follow depends on the merges that the ends of a token can begin while they stand: the same merges, the same class.
        """
        begins: dict[int, list[int]] = {}
        for (x, _), rank in self.pair.items():
            begins.setdefault(x, []).append(rank)
        for ranks in begins.values():
            ranks.sort()
        first: dict[tuple, int] = {}
        out = {}
        for token in self.made:
            ends, x, until = [], token, 2**31
            while True:
                n = bisect.bisect_left(begins.get(x, ()), until)
                if n:
                    ends.append((x, n))
                if x not in self.right:
                    break
                x, until = self.right[x], self.made[x]
            out[token] = first.setdefault(tuple(ends), token)
        return out

    def _overtaken(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a rank below ``before`` joins the end of a and the start of b while those are being built."""
        x, until_x = a, before
        while True:
            y, until_y = b, before
            while True:
                rank = self.pair.get((x, y))
                # of equal merges the left one is first: one inside a comes before that on the border, one inside b after it
                if rank is not None and rank < before and (x == a or rank < until_x) and (y == b or rank <= until_y):
                    return True
                if y not in self.left:
                    break
                y, until_y = self.left[y], self.made[y]
            if x not in self.right:
                return False
            x, until_x = self.right[x], self.made[x]

    def may_stand(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[a, b] = a == NONE or not self._overtaken(a, b, 2**31)
        return found


class CountTransducer:
    """The determinised transducer; states are rows of tables, 0 is the start."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        child: dict[int, int] = {}  # node * 256 + byte -> node
        token, inner = [NONE], [True]  # of each node: the token that it is, whether it has children
        for own, text in merges.text.items():
            node = 0
            for byte in text:
                at = node << 8 | byte
                if at not in child:
                    child[at] = len(token)
                    token.append(NONE)
                    inner.append(False)
                    inner[node] = True
                node = child[at]
            token[node] = own
        self.child = {at: (node << 8, token[node], inner[node]) for at, node in child.items()}
        self.length = np.zeros(max(merges.text) + 1, np.int64)
        for token, text in merges.text.items():
            self.length[token] = len(text)
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self._tables(16)
        self.used = 0
        self.intern(((0, NONE, 0),))

    def _tables(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next, self.emit, self.ends = np.full(1 << bits, _EMPTY), *(np.zeros(1 << bits, np.int32) for _ in range(3))

    def intern(self, items: tuple) -> int:
        state = self.number.get(items)
        if state is None:
            state = self.number[items] = len(self.states)
            self.states.append(items)
        return state

    def _transition(self, state: int, byte: int) -> tuple[int, int, int]:
        """The state behind a byte, the growth of the count and the token that ends there: items are tried longest first, one fits."""
        found, grown, after = NONE, 0, []
        child, known = self.child.get, self.merges.known.get
        for node, before, count in self.states[state]:  # nodes are kept times 256
            step = child(node | byte)
            if step is not None:
                node, token, inner = step
                if found == NONE and token != NONE:
                    fits = known((before, token))
                    if self.merges.may_stand(before, token) if fits is None else fits:
                        found, grown = token, count + 1
                if inner:
                    after.append((node, before, count))
        if grown:
            after = [(node, before, count - grown) for node, before, count in after]
        after.append((0, self.merges.alike[found], 0))
        return self.intern(tuple(after)), grown, found

    def _slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in the tables, and the indices of keys that have none."""
        slot = ((key.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)
        off = np.flatnonzero(self.keys[slot] != key)
        absent = []
        while len(off):
            free = self.keys[slot[off]] == _EMPTY
            absent.append(off[free])
            off = off[~free]
            slot[off] = (slot[off] + 1) & self.mask
            off = off[self.keys[slot[off]] != key[off]]
        return slot, np.concatenate(absent) if absent else off

    def _put(self, key: np.ndarray, state: np.ndarray, grown: np.ndarray, ends: np.ndarray) -> None:
        while 2 * (self.used + len(key)) > len(self.keys):
            old = self.keys != _EMPTY
            again = self.keys[old], self.next[old], self.emit[old], self.ends[old]
            self._tables(65 - int(self.shift))
            self.used = 0
            self._put(*again)
        self.used += len(key)
        left = np.arange(len(key))
        slot = ((key.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)
        while len(left):
            free = left[self.keys[slot[left]] == _EMPTY]
            self.keys[slot[free]] = key[free]  # of several on one place the last one stays
            won = free[self.keys[slot[free]] == key[free]]
            self.next[slot[won]], self.emit[slot[won]], self.ends[slot[won]] = state[won], grown[won], ends[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Places in the tables of the transitions from each state by each byte; new ones are determinised."""
        key = state * np.int64(256) + byte
        slot, absent = self._slots(key)
        if len(absent):
            new = np.unique(key[absent])
            made = np.array([self._transition(k >> 8, k & 255) for k in new.tolist()], np.int32)
            self._put(new, made[:, 0], made[:, 1], made[:, 2])
            slot, _ = self._slots(key)
        return slot

    def walk(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and emitted counts of the spans of ``raw``, side by side; ``kept`` gets the token that ends at every byte."""
        most = int(size.max(initial=0))
        by = np.argsort((most - size).astype(np.uint16 if most < 2**16 else np.int64), kind="stable")  # a radix sort where numbers are small
        at, state, count = start[by], entry[by].astype(np.int64), np.zeros(len(by), np.int64)
        active = np.searchsorted(-size[by], -np.arange(most), "left").tolist()
        for k, m in enumerate(active):  # the first m spans have a byte k
            place = at[:m] + k
            slot = self.step(state[:m], raw[place])
            state[:m] = self.next[slot]
            count[:m] += self.emit[slot]
            if kept is not None:
                kept[place] = self.ends[slot]
        out = np.empty_like(state), np.empty_like(count)
        out[0][by], out[1][by] = state, count
        return out

    def _through(self, raw: np.ndarray, start: int, size: int, entry: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(starts, sizes, entry states of the chunks, exit state, count) of one long span, by state maps and a prefix scan."""
        first = start + np.arange(0, size, CHUNK)
        sizes = np.minimum(CHUNK, start + size - first)
        guess = np.full(len(first), entry, np.int64)
        warm = np.minimum(WARM, first[1:] - start)
        guess[1:] = self.walk(raw, first[1:] - warm, warm, np.full(len(first) - 1, START))[0]
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in first]
        todo = list(enumerate(guess.tolist()))
        while todo:  # until each chunk's map holds all states that the one before can end in
            chunk, state = np.array(todo, np.int64).T
            ends, grown = self.walk(raw, first[chunk], sizes[chunk], state)
            for (j, s), e, g in zip(todo, ends.tolist(), grown.tolist(), strict=True):
                maps[j][s] = e, g
            todo = sorted({(j + 1, e) for (j, _), e in zip(todo, ends.tolist(), strict=True) if j + 1 < len(maps) and e not in maps[j + 1]})
        width = max(map(len, maps))
        exits, counts = np.zeros((len(maps), width), np.int64), np.zeros((len(maps), width), np.int64)
        order = [{s: k for k, s in enumerate(m)} for m in maps]
        for j, m in enumerate(maps):
            exits[j, : len(m)] = [order[j + 1][e] if j + 1 < len(maps) else e for e, _ in m.values()]
            counts[j, : len(m)] = [g for _, g in m.values()]
        last = list(maps[-1].values())
        exits[-1, : len(last)] = np.arange(len(last))
        gap = 1
        while gap < len(maps):  # row j becomes the map of all chunks up to j
            counts[gap:] = counts[:-gap] + np.take_along_axis(counts[gap:], exits[:-gap], axis=1)
            exits[gap:] = np.take_along_axis(exits[gap:], exits[:-gap], axis=1)
            gap *= 2
        into = [entry, *(list(maps[j])[exits[j - 1, 0]] for j in range(1, len(maps)))]
        return first, sizes, np.array(into, np.int64), last[exits[-1, 0]][0], int(counts[-1, 0])

    def counts(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, ids: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of every span of ``raw`` (ascending, apart), and with ``ids`` the token ids of all spans in a row."""
        count = np.zeros(len(start), np.int64)
        parts: list[np.ndarray] = []
        a = 0
        while a < len(start):  # runs of bounded bytes, between which the tables may be emptied
            b = max(a + 1, int(np.searchsorted(end, start[a] + RUN_BYTES, "right")))
            if len(self.states) > STATES:
                self.forget()
            low = int(start[a])
            tail = np.full(int(end[b - 1]) - low, NONE, np.int32) if ids else None
            s, size = start[a:b], end[a:b] - start[a:b]
            own = raw[low : int(end[b - 1])]
            short = np.flatnonzero(size <= CHUNK)
            count[a + short] = self.walk(own, s[short] - low, size[short], np.full(len(short), START), tail)[1]
            for k in np.flatnonzero(size > CHUNK).tolist():
                at, left, items = int(s[k]) - low, int(size[k]), self.states[START]
                while left:
                    if len(self.states) > STATES:
                        self.forget()
                    n = min(left, RUN_BYTES)
                    first, sizes, into, state, grown = self._through(own, at, n, self.intern(items))
                    if ids:
                        self.walk(own, first, sizes, into, tail)
                    items = self.states[state]
                    count[a + k] += grown
                    at, left = at + n, left - n
            if ids:
                parts.append(self._ids(tail, s - low, s - low + size, count[a:b]))
            a = b
        return count, (np.concatenate([np.zeros(0, np.uint32), *parts]) if ids else None)

    def _ids(self, tail: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ids of the spans, read from their ends: the token that ends at a byte tells where the one before it ends."""
        out = np.zeros(int(count.sum()), np.uint32)
        place = np.cumsum(count) - 1
        at = end - 1
        left = np.arange(len(start))
        for _ in range(64):
            left = left[at[left] >= start[left]]
            if not len(left):
                return out
            token = tail[at[left]]
            out[place[left]] = token
            place[left] -= 1
            at[left] -= self.length[token]
        length = self.length.tolist()
        for k in left[at[left] >= start[left]].tolist():  # long spans: one by one
            low = int(start[k])
            own = tail[low : int(end[k])].tolist()
            spot, p = int(at[k]) - low, int(place[k])
            rest = []
            while spot >= 0:
                rest.append(own[spot])
                spot -= length[own[spot]]
            out[p - len(rest) + 1 : p + 1] = rest[::-1]
        return out
