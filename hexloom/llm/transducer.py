"""Token counts and ids by compiled finite-state transducers (operator 7; also the encoder behind operators 1 and 2).

The pre-tokenizer of byte-level BPE vocabularies is a regular language with two characters of lookahead, so it compiles
to a deterministic transducer of 12 states over 11 character classes. Every transition is annotated with what it emits:
a token start here, one character earlier, both or none. A long buffer is cut into equal chunks. Each chunk's *state
map* (entry state -> exit state) is computed for all chunks side by side; the maps compose associatively, so a parallel
prefix scan gives every chunk's true entry state, and a last pass reads off the emissions. Between two starts lies one
pre-token, at which the second transducer (:mod:`hexloom.llm.bpe`), compiled from the merges, begins anew: its transitions carry
the number of tokens they emit, and the count of a text is the difference of two prefix sums over its pre-tokens.

Character classes beyond ASCII come from the library's own pre-tokenizer, so both always agree. Strings of added tokens part a
text first, as the library has it. Vocabularies that are not byte-level BPE are left to their library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.bpe import NONE, CountTransducer, Merges
from hexloom.llm.common import cached, pieces

LETTER, L_L, L_E, L_RV, L_ONE, NUMBER, OTHER, APOS, SPACE, WHITE, END = range(11)
STATES = (START, IN_L, IN_N, IN_O, APO, APO_RV, APO_L, DONE, W1S, W1W, W2S, W2W) = range(12)
HERE, BACK = 1, 2
CHUNK, WARM = 128, 6


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for every state and class."""
    nxt, out = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    letters = (LETTER, L_L, L_E, L_RV, L_ONE)
    fresh = {**dict.fromkeys(letters, IN_L), NUMBER: IN_N, OTHER: IN_O, APOS: APO, SPACE: W1S, WHITE: W1W, END: START}
    for s in STATES:
        for c in range(11):
            nxt[s, c], out[s, c] = fresh[c], HERE if c != END else 0

    def put(s: int, classes: tuple[int, ...], to: int, emit: int) -> None:
        for c in classes:
            nxt[s, c], out[s, c] = to, emit

    put(IN_L, letters, IN_L, 0)
    put(IN_N, (NUMBER,), IN_N, 0)
    put(IN_O, (OTHER, APOS), IN_O, 0)
    put(APO, (OTHER, APOS), IN_O, 0)
    put(APO, (L_ONE,), DONE, 0)
    put(APO, (L_RV,), APO_RV, 0)
    put(APO, (L_L,), APO_L, 0)
    for s, c in ((APO_RV, L_E), (APO_L, L_L)):  # else the apostrophe stands alone and its letter starts a word
        out[s] |= BACK
        put(s, letters, IN_L, BACK)
        put(s, (c,), DONE, 0)
    for s, emit in ((W1S, 0), (W2S, BACK)):  # the last blank goes with what follows
        put(s, letters, IN_L, emit)
        put(s, (NUMBER,), IN_N, emit)
        put(s, (OTHER, APOS), IN_O, emit)
    out[W2W] |= BACK
    for s in (W1S, W1W, W2S, W2W):
        put(s, (SPACE,), W2S, 0)
        put(s, (WHITE,), W2W, 0)
        put(s, (END,), START, 0)
    return nxt, out


NEXT, EMIT = _compile()
_FLAT_NEXT, _FLAT_EMIT = NEXT.reshape(-1), EMIT.reshape(-1)


def run(classes: np.ndarray) -> np.ndarray:
    """Emissions of the segmenting transducer over a class sequence, by state maps of chunks and a prefix scan."""
    n = len(classes)
    lanes = -(-n // CHUNK)
    grid = np.full(lanes * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)  # step by chunk
    maps = np.tile(np.arange(12, dtype=np.uint8), (lanes, 1))
    for k in range(WARM):
        maps = _FLAT_NEXT[maps * np.uint8(11) + grid[k][:, None]]
    met = (maps == maps[:, :1]).all(axis=1)
    state = maps[:, 0].copy()
    for k in range(WARM, CHUNK):
        state = _FLAT_NEXT[state * np.uint8(11) + grid[k]]
    if not met.all():  # all states were not yet one: go on with every entry state
        rest = np.flatnonzero(~met)
        part = maps[rest]
        for k in range(WARM, CHUNK):
            part = _FLAT_NEXT[part * np.uint8(11) + grid[k][rest][:, None]]
        maps[rest] = part
    maps[met] = state[met][:, None]
    gap = 1
    while gap < lanes:  # maps[i] becomes the map of all chunks up to i
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
        gap *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8) if lanes else np.zeros(0, np.uint8)
    out = np.empty_like(grid)
    for k in range(CHUNK):
        at = state * np.uint8(11) + grid[k]
        out[k] = _FLAT_EMIT[at]
        state = _FLAT_NEXT[at]
    return out.T.reshape(-1)[:n]


class Encoder:
    """Encodes Arrow string columns with a byte-level BPE vocabulary, through the transducers."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        known = json.loads(self.tok.to_str())
        model = known["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = CountTransducer(Merges(model["vocab"], merges))
        added = {t["content"].encode(): t["id"] for t in known["added_tokens"]}
        self.special = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.added = added
        self.of = np.full(0x110000, 255, np.uint8)
        for cp in range(128):
            self.of[cp] = self._class(chr(cp))

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the file holds what the transducers are compiled from: byte-level BPE, its usual pattern, plain added tokens."""
        if not path.endswith(".json"):
            return False
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        model, before = known["model"], known["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        bare = not any(t[k] for t in known["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        return model["type"] == "BPE" and plain and bare and known["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def _class(self, c: str) -> int:
        if c in "'lersvtmd ":
            return {"'": APOS, "l": L_L, "e": L_E, "r": L_RV, "v": L_RV, " ": SPACE}.get(c, L_ONE)
        split = self.tok.pre_tokenizer.pre_tokenize_str
        for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(split(before + c)) == 1:
                return kind
        return WHITE

    def starts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte positions at which pre-tokens of the texts start."""
        n = len(raw)
        lead = (raw & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        b = raw[at].astype(np.int32)
        cp = b.copy()
        wide = np.flatnonzero(b >= 0xC0)
        if len(wide):
            p, w = at[wide], b[wide]
            get = lambda k: raw[np.minimum(p + k, n - 1)].astype(np.int32) & 0x3F
            two, three = ((w & 0x1F) << 6) | get(1), ((w & 0x0F) << 12) | (get(1) << 6) | get(2)
            four = ((w & 0x07) << 18) | (get(1) << 12) | (get(2) << 6) | get(3)
            cp[wide] = np.where(w < 0xE0, two, np.where(w < 0xF0, three, four))
        classes = self.of[cp]
        if (classes == 255).any():
            for c in np.unique(cp[classes == 255]):
                self.of[c] = self._class(chr(c))
            classes = self.of[cp]
        # an end mark after every text
        bounds = np.searchsorted(at, off[1:])
        place = np.arange(len(at)) + np.repeat(np.arange(len(bounds)), np.diff(bounds, prepend=0))
        seq = np.full(len(at) + len(bounds), END, np.uint8)
        seq[place] = classes
        emit = run(seq)
        begin = (emit & HERE) > 0
        begin[:-1] |= (emit[1:] & BACK) > 0
        return at[begin[place]]

    def _plain(self, raw: np.ndarray, off: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens before each text's start and the last one's end, and with ``ids`` all token ids; no strings of added tokens."""
        start = self.starts(raw, off)
        end = np.append(start[1:], len(raw))
        count, all_ids = self.machine.counts(raw, start, end[: len(start)], ids)
        total = np.concatenate([[0], np.cumsum(count)])
        return total[np.searchsorted(start, off)], all_ids

    def _encoded(self, raw: np.ndarray, off: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """As :meth:`_plain`, for any texts: added tokens part them and stand for themselves."""
        data = raw.tobytes() if self.special else b""
        if not self.special or not self.special.search(data):
            return self._plain(raw, off, ids)
        cuts, marks = [0], [NONE]  # ends of segments; the added token that a segment is
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            for m in self.special.finditer(data, a, b):
                cuts += [m.start(), m.end()]
                marks += [NONE, self.added[m.group()]]
            cuts.append(b)
            marks.append(NONE)
        cuts, marks = np.array(cuts, np.int64), np.array(marks, np.int64)
        text = marks[1:] == NONE
        size = np.where(text, np.diff(cuts), 0)
        keep = np.repeat(text, np.diff(cuts))
        at, own = self._plain(raw[keep], np.concatenate([[0], np.cumsum(size)]), ids)
        n = np.where(text, np.diff(at), 1)
        total = np.concatenate([[0], np.cumsum(n)])
        last = np.searchsorted(cuts, off, "right") - 1  # empty segments belong to the text that they end
        if not ids:
            return total[last], None
        out = np.empty(int(total[-1]), np.uint32)
        held = np.repeat(text, n)
        out[held] = own
        out[~held] = marks[1:][~text]
        return total[last], out

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text."""
        return np.concatenate([np.zeros(0, np.int64), *(np.diff(self._encoded(raw, off, False)[0]) for _, _, raw, off in pieces(column))])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of the ids of each text) for runs of texts."""
        for a, _, raw, off in pieces(column):
            at, ids = self._encoded(raw, off, True)
            yield a, ids, at


class Library:
    """The same for other vocabularies, by their own library."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: own.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._ids = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for a, _, raw, off in pieces(column):
            data = raw.tobytes()
            found = self._ids([data[i:j].decode() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            yield a, np.fromiter((t for ids in found for t in ids), np.uint32), np.cumsum([0, *map(len, found)])

    def counts(self, column: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.diff(at) for _, _, at in self.encode(column))])


@cached
def encoder(path: str) -> Encoder | Library:
    """One for each worker process and vocabulary."""
    return Encoder(path) if Encoder.fits(path) else Library(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows pass through, one output row for each
    input row; an empty table gives an empty table; other columns are not read, so clashing names don't matter. A text
    of any length is handled whole. No shuffle: memory is bounded by a piece of text and the transducer's tables.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = enc.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return own.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
