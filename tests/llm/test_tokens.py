import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hexloom.llm import bitplane, bpe, packing, transducer
from hexloom.llm.common import shared_folder
from hexloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tok(vocab):
    return Tokenizer.from_file(vocab)


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


ALPHABET = ["'", "s", "t", "re", "ve", "m", "ll", "d", "l", "r", "v", " ", "  ", "\n", "\t", "\r", "a", "B", "7", "²", "é", "中", "🙂", "!", " ", "　", "<|endoftext|>", "​", "́", "'S", "½", "\x85", "\x1c", "\x00"]


@given(st.lists(st.text(st.one_of(st.sampled_from([c for a in ALPHABET for c in a]), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    enc = transducer.encoder(vocabulary())
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(texts, pa.string())
    assert enc.counts(column).tolist() == [len(w) for w in want]
    assert [ids[at[k] : at[k + 1]].tolist() for _, ids, at in enc.encode(column) for k in range(len(at) - 1)] == want


def test_words_that_defeat_polynomial_hashes(spark, vocab, tok):
    """2048 letters and their complements in Thue-Morse order: equal under any polynomial modulo 2^64, yet not in tokens."""
    odd = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join(pair[b ^ k] for b in odd) for pair in ("eq", "ab", "01", "tn") for k in (0, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    want = [ids_of(tok, t) for t in texts]
    assert {r.doc_id: r.n_tokens for r in transducer.token_counts(df, vocab).collect()} == {k: len(w) for k, w in enumerate(want)}
    path = shared_folder(spark, "planes")
    bitplane.write_planes(df, path, vocab)
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert {r.doc_id: r.ids_crc32 for r in bitplane.read_documents(spark, path).collect()} == {k: crc([*w, 0]) for k, w in enumerate(want)}
    packed = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack_documents(df, vocab, capacity=4096).collect()}
    assert packed == {(k, 0): crc([*w, 2]) for k, w in enumerate(want)}


def test_long_runs_through_state_maps(vocab, tok):
    """Unbroken runs take chunk maps and the prefix scan; periods, noise and tables that are emptied on the way change nothing."""
    rng = random.Random(5)
    texts = ["a" * n for n in (255, 256, 257, 513, 5000)] + ["ab" * 3000 + "a" * 3000, "=-" * 9000, "é" * 4000, "".join(rng.choice("abcdefghij") for _ in range(40_000)), "".join(rng.choice("0123456789") for _ in range(9000)) + " end"]
    enc = transducer.Encoder(vocab)
    column = pa.array(texts)
    want = [ids_of(tok, t) for t in texts]
    for _ in range(2):
        assert enc.counts(column).tolist() == [len(w) for w in want]
        assert [ids[at[k] : at[k + 1]].tolist() for _, ids, at in enc.encode(column) for k in range(len(at) - 1)] == want
        enc.machine.forget()
    raw = np.frombuffer(texts[-2].encode(), np.uint8)
    _, _, into, state, count = enc.machine._through(raw, 0, len(raw), bpe.START)
    exits, counts = enc.machine.walk(raw, np.zeros(1, np.int64), np.array([len(raw)]), np.zeros(1, np.int64))
    assert (state, count) == (exits[0], counts[0]) and into[0] == bpe.START


def test_pairs_that_may_stand(vocab, tok):
    """Random pairs of tokens stand side by side if and only if the library gives them back; all of a class agree."""
    m = transducer.encoder(vocab).machine.merges
    rng = random.Random(2)
    plain = [t for t, b in m.text.items() if b.isalpha()]
    for _ in range(4000):
        a, b = rng.choice(plain), rng.choice(plain)
        assert m.may_stand(a, b) == (ids_of(tok, (m.text[a] + m.text[b]).decode()) == [a, b])
        assert m.may_stand(a, b) == m.may_stand(m.alike[a], b)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_by_their_library(name):
    path = vocabulary(name)
    texts = ["Hello  wörld 12", "", "日本 <|endoftext|>"]
    if name.endswith("json"):
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    enc = transducer.encoder(path)
    assert enc.counts(pa.array(texts)).tolist() == [len(w) for w in want]
    assert [ids[at[k] : at[k + 1]].tolist() for _, ids, at in enc.encode(pa.array(texts)) for k in range(len(at) - 1)] == want


def test_states_agree_with_one_walk():
    rng = np.random.default_rng(0)
    for n in (1, 5, 127, 128, 129, 1000):
        classes = rng.choice(11, n, p=[0.2, 0.05, 0.05, 0.05, 0.05, 0.1, 0.1, 0.15, 0.15, 0.07, 0.03]).astype(np.uint8)
        for fixed in (classes, np.full(n, transducer.WHITE, np.uint8)):
            state, out = transducer.START, []
            for c in fixed:
                out.append(transducer.EMIT[state, c])
                state = transducer.NEXT[state, c]
            assert transducer.run(fixed).tolist() == out


def test_counts_of_odd_rows(odd, odd_rows, none, vocab, tok):
    got = transducer.token_counts(odd, vocab)
    want = [(r[0], len((r[1] or "").encode()), len(ids_of(tok, r[1])), len(ids_of(tok, r[1])) > 512) for r in odd_rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert transducer.token_counts(none, vocab).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.booleans())
def test_planes_round_trip(ids, bits):
    a = np.array(ids, np.uint32)
    assert bitplane.from_planes(bitplane.to_planes(a, bits), len(a), bits).tolist() == ids


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_joined_checksums(a, b):
    assert bitplane.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("bits", [False, True])
def test_bit_planes_of_odd_rows(spark, odd, odd_rows, none, vocab, tok, bits):
    path = shared_folder(spark, "planes")
    bitplane.write_planes(odd, path, vocab, block=1000, bits=bits)
    got = bitplane.read_documents(spark, path).collect()
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    want = Counter((r[0], len(x), crc(x)) for r in odd_rows for x in [[*ids_of(tok, r[1]), 0]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *[r.n_tokens for r in by_start[:-1]]]).tolist()
    keys = [(r.doc_id is not None, r.doc_id) for r in by_start]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] or 0))
    segments = bitplane.read_segments(spark, path).where("doc_id = 10").orderBy("shard", "ordinal", "seg_from").collect()
    assert [i for s in segments for i in s.ids] == [*ids_of(tok, odd_rows[10][1]), 0]
    assert "data" not in bitplane.read_index(spark, path).columns
    empty = shared_folder(spark, "planes")
    bitplane.write_planes(none, empty, vocab)
    assert bitplane.read_documents(spark, empty).count() == 0


def optimum(items, capacity):
    best = [len(items) + 1]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= items[k]}):
            rest = list(bins)
            rest.remove(room)
            go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0] if items else 0


def test_dominance_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(250):
        capacity = rng.choice([10, 20, 30])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        fixed, left = packing.dominance_reduction(dict(counts), capacity)
        used = Counter(left)
        for many, has in fixed:
            assert many > 0 and sum(k * n for k, n in has) <= capacity
            for k, n in has:
                used[k] += many * n
        assert used == counts
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(m for m, _ in fixed) + optimum(rest, capacity) == optimum(sorted(counts.elements(), reverse=True), capacity)


def test_patterns_stay_few():
    rng = np.random.default_rng(0)
    counts = {k: int(n) for k, n in enumerate(rng.integers(0, 10**9, 1025)) if k and n}
    patterns = packing.pack_histogram(counts, 1024)
    assert len(patterns) < 6 * 1024
    total = sum(k * n for k, n in counts.items())
    assert sum(m for m, _ in patterns) <= 1.01 * -(-total // 1024)


def check_packing(pieces, want, capacity):
    sequences: dict[int, list] = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    return len(sequences)


def test_packing_of_odd_rows(odd, odd_rows, none, vocab, tok):
    want = Counter()
    for r in odd_rows:
        ids = [*ids_of(tok, r[1]), 2]
        at, piece = 0, 0
        while at < len(ids):
            end = at + ((len(ids) - 1) % 64 + 1 if at == 0 else 64)
            part = ids[at:end]
            want[(r[0], piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
            at, piece = end, piece + 1
    pieces = packing.pack_documents(odd, vocab, capacity=64).collect()
    n = check_packing(pieces, want, 64)
    assert n <= 1 + -(-sum(r.length for r in pieces) // 64) * 1.01
    assert packing.pack_documents(none, vocab).count() == 0
