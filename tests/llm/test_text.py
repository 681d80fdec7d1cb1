import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hexloom.llm import chat, jaccard, langid, license, poisson, queries, winnow


# --- chat ---------------------------------------------------------------------------------------------------------
def chat_digest(turns):
    turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
    loss = "".join(t for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


ODD_TURNS = [
    (1, 0, "system", "be <|im_start|> kind"), *[(1, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "word " * (i % 40)) for i in range(1, 300)],
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (2, None, "user", "no turn"), (2, 3, None, "no role"),
    (3, 0, "assistant", "<\\|im_end|>\n<|im_end|>\n</s>[INST] ok [/INST] <\\\\s> $1 \\"), (3, 5, "us<|im_end|>er", "x\n\ny"), (4, 0, "system", "s" * 9000), (4, 1, "assistant", "y" * 200_000), (4, 2, "user", "🙂" * 500),
    (None, 0, "user", "a"), (None, 1, "assistant", "b"),
]


def test_chat_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ODD_TURNS], "conv_id long, turn long, role string, text string, window int, span string")
    w = chat.windows(df, budget=800, history=240).cache()
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(w).collect()}
    convs = defaultdict(list)
    for c, t, r, x in ODD_TURNS:
        convs[c].append((t, r or "", x or ""))
    assert got == {c: chat_digest(t) for c, t in convs.items()}
    first = w.where("conv_id = 1").orderBy("window").collect()
    assert len(first) > 5 and all(r.text.startswith("<|im_start|>system\n") for r in first)
    assert any(not t.fresh and t.idx > 0 for t in first[1].turns)
    assert all(len(r.text.encode()) <= 800 for r in first)
    none = df.limit(0)
    assert chat.windows(none).count() == 0 and chat.read_back(chat.windows(none)).count() == 0


def test_windows_keep_to_the_budget(spark):
    """But for a window of one long turn and the system turn; a system turn beyond a quarter of the budget is not repeated."""
    rng = np.random.default_rng(8)
    rows = [(1, 0, "system", "s" * 20_000), (2, 0, "system", "be kind"), (3, 0, "system", "x" * 960)]
    rows += [(c, k, ("user", "assistant")[k % 2], "é" * int(rng.choice([0, 3, 40, 200, 900, 2500], p=[0.1, 0.3, 0.3, 0.2, 0.07, 0.03]))) for c in (1, 2, 3) for k in range(1, 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(df).cache()
    for r in w.collect():
        system = r.text.startswith("<|im_start|>system")
        assert len(r.text.encode()) <= 4096 or len(r.turns) <= 1 + system
        assert system == (r.conv_id > 1 or any(t.idx == 0 for t in r.turns))
    assert w.agg(F.sum(F.octet_length("text"))).first()[0] < 3 * sum(len(x[3].encode()) + 40 for x in rows)
    given = df.withColumn("n", F.length("text") + 8)
    for r in chat.windows(given, budget=2000, history=400, tokens="n").collect():
        texts = [p.split("\n", 1)[1][: -len(chat.CLOSE)] for p in r.text.split(chat.OPEN)[1:]]
        assert sum(len(t) + 8 for t in texts) <= 2000 or len(texts) <= 2


def test_one_conversation_of_many_turns(spark):
    df = spark.range(60_000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
    got = chat.read_back(chat.windows(df)).collect()
    assert [tuple(r)[1:5] for r in got] == [chat_digest([(k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(60_000)])]


def test_chat_query(spark, data):
    got = {r.conv_id: tuple(r)[1:5] for r in queries.QUERIES["op3_chat_windows"](spark, data).collect()}
    said = "</s>[INST] ok [/INST]"
    convs = defaultdict(list, {-1: [(0, "user", said), (1, "assistant", said)]})
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    assert got == {c: chat_digest(t) for c, t in convs.items()}


def test_escape_round_trip(spark):
    texts = ["<|im_start|>", "<\\|im_start|>", "<\\\\|im_end|>", "[INST]", "[\\/INST]", "<s><s>", "<<SYS>>", "plain", "\\<|im_end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u for r in rows) and not any("<|im_" in r.e for r in rows)


# --- mixing -------------------------------------------------------------------------------------------------------
def test_poisson_of_odd_rows(odd, odd_rows, none):
    got = poisson.replicate(odd, temper=0.3)
    assert poisson.replicate(none).count() == 0
    rows = got.collect()
    size = defaultdict(int)
    for r in odd_rows:
        size[r[3]] += len(r[1] or "")
    weights = {s: n**0.3 for s, n in size.items()}
    for r in rows:
        rate = weights[r.source] / sum(weights.values()) * sum(size.values()) / size[r.source]
        assert r.rate == pytest.approx(rate)

    def draw(doc, text, rate):
        parts = max(1, math.ceil(rate / 32))
        total = 0
        for k in range(1, parts + 1):
            u = int(hashlib.md5(f"mix:{'null:' + hashlib.md5((text or '').encode()).hexdigest() if doc is None else doc}:{k}".encode()).hexdigest()[:13], 16) / 2**52
            mean, p, c, n = rate / parts, math.exp(-rate / parts), math.exp(-rate / parts), 0
            while c <= u:
                n += 1
                p *= mean / n
                c += p
            total += n
        return total

    want = Counter()
    for r in odd_rows:
        rate = weights[r[3]] / sum(weights.values()) * sum(size.values()) / size[r[3]]
        for k in range(draw(r[0], r[1], rate)):
            want[(r[0], r[1], k + 1)] += 1
    assert Counter((r.doc_id, r.text, r.copy) for r in rows) == want
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)


def test_poisson_passes_any_column(spark):
    names = ["_many", "_source", "of", "parts", "below", "doc", "copy", "rate", "mix_key", "size", "w"]
    df = spark.createDataFrame([(i, "x" * i, "s", *range(len(names))) for i in range(1, 30)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = poisson.replicate(df, targets={"s": 1.0}).collect()
    assert got and all([r[n] for n in names[:6] + names[9:]] == [0, 1, 2, 3, 4, 5, 9, 10] for r in got)


def test_rows_without_an_id_draw_for_themselves(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") + 10_000).cast("string")).alias("text"), F.lit("s").alias("source"))
    assert poisson.replicate(df, targets={"s": 1.0}).count() == pytest.approx(4000, rel=0.1)


def test_poisson_meets_its_mean(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    n = {r[0]: r[1] for r in poisson.replicate(docs, targets={"a": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(10_000, rel=0.05) and n["b"] == pytest.approx(10_000, rel=0.05)
    only = poisson.replicate(docs, targets={"a": 1.0})
    assert only.where("source = 'b'").count() == 0 and only.count() == pytest.approx(20_000, rel=0.05)


# --- fingerprints ---------------------------------------------------------------------------------------------------
def test_winnowing_keeps_what_it_promises(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    for _ in range(3):
        a, b, common = (list(rng.choice(words, n)) for n in (60, 50, 8))
        texts = [" ".join(a[:30] + common + a[30:]), " ".join(b[:10] + common + b[10:])]
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(winnow.hashes_of(winnow.winnow(F.col("t"))).alias("h")).collect()
        assert set(rows[0].h) & set(rows[1].h)


def test_winnowing_ties_go_right(spark):
    got = spark.createDataFrame([("a a a a a a a a a a a a",)], "t string").select(winnow.as_text(winnow.winnow(F.col("t"))).alias("f")).first().f
    assert [int(x.split("@")[1]) for x in got.split()] == [5, 6, 7, 8, 9]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def xx(text, seed=42):
    return signed(xxhash.xxh64(text.encode(), seed=seed % 2**64).intdigest())


def winnowed(hashes, w):
    """(hash, position) of the smallest of every window, the rightmost of equal ones."""
    kept = []
    for i in range(max(len(hashes) - w, 0) + 1):
        best = min(range(i, min(i + w, len(hashes))), key=lambda j: (hashes[j], -j))
        if (hashes[best], best) not in kept:
            kept.append((hashes[best], best))
    return kept


def print_by_force(text, k=3, w=6):
    words = [x for x in re.split("[ \t-\r]+", text) if x]
    words = [y for x in words for y in (x if len(x) > winnow.LONG else [x])]
    h = [xx(x) % winnow.PRIME for x in words]
    if not h:
        return [], []

    def poly(xs, plus=0, start=None):
        acc = xs[0] if start is None else start
        for x in xs[1 if start is None else 0 :]:
            acc = (acc * winnow.BASE + x + plus) % winnow.PRIME
        return acc

    grams = [poly(h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [poly(h, 1, 0)]
    marks = []
    for least, size, width in winnow.SHORT if len(text) < winnow.SHORT[0][0] else []:
        if len(text) < least:
            seed = signed(xxhash.xxh64(struct.pack("<i", size), seed=42).intdigest())
            marks += winnowed([xx(text[i : i + size], seed) % winnow.PRIME for i in range(max(len(text) - size, 0) + 1)], width)
    return winnowed(grams, w), marks


def prints_by_force(rows):
    """All columns of the fingerprints of (id, text) rows."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -xx(r[1])))
    want = Counter()
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    shown = lambda p: " ".join([f"{h:x}@{i}" for h, i in p[0]] + [f"{h:x}@c{i}" for h, i in p[1]])
    memo = {}
    made = lambda t: memo.setdefault(t, None) or memo.__setitem__(t, print_by_force(t)) or memo[t]
    of = lambda p: {h for part in p for h, _ in part}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        a, b, c = made(t), made(edited), made(nxt)
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), round(like(of(a), of(b)), 9), round(like(of(a), of(c)), 9))] += 1
    return want


def rounded(r):
    return (*tuple(r)[:5], round(r[5], 9), round(r[6], 9))


def test_fingerprints_by_force(spark, data):
    """The whole table; rows without an id and rows of one id, which fill several ranges."""
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert Counter(map(rounded, winnow.fingerprints(df).collect())) == prints_by_force([tuple(r) for r in df.collect()])
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i * i} " * (i % 5)) for i in range(300)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(rounded, winnow.fingerprints(many).collect())) == prints_by_force(rows)
    parts = winnow.in_ranges(many).where("not guest").groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    assert parts.agg(F.max("n")).first()[0] < 60


def test_fingerprints_of_odd_rows(odd, odd_rows, none):
    assert winnow.fingerprints(none).count() == 0
    got = winnow.fingerprints(odd).collect()
    assert Counter(map(rounded, got)) == prints_by_force([(r[0], r[1]) for r in odd_rows])
    prints = defaultdict(set)
    text_of = defaultdict(set)
    for r in odd_rows:
        text_of[r[0]].add(r[1] or "")
    for r in got:
        if len(text_of[r.doc_id]) == 1:
            prints[next(iter(text_of[r.doc_id]))].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}


def test_short_and_unbroken_texts_are_like_their_edit(spark):
    """Two thirds of each text stay in its edit: of few words, of few blanks, and of none."""
    rng = np.random.default_rng(4)
    cjk = lambda n: "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 9000, n))
    prose = [" ".join("".join(chr(97 + int(x)) for x in rng.integers(0, 26, rng.integers(1, 12))) for _ in range(n)) for n in [*range(1, 31), 60, 90, 200]]
    texts = [t for t in prose if len(t) > 1] + [cjk(n) for n in (2, 3, 9, 23, 24, 36, 37, 300, 399, 400, 6000)] + ["".join(f"{x:02x}" for x in rng.integers(0, 256, 700)), "。 ".join(cjk(80) for _ in range(9)), "ab cd", "a b"]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in winnow.fingerprints(df).collect()}
    assert [t for i, t in enumerate(texts) if not got[i].near_edited > 0] == []
    assert all(len(got[i].fingerprint.split()) > 100 for i, t in enumerate(texts) if len(t) == 6000)


# --- languages ----------------------------------------------------------------------------------------------------
def test_languages(spark, none, odd, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert langid.identify(none).count() == 0
    rows = langid.identify(odd).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (0, 1, 2, 12))


def grams_by_force(text):
    """The n-grams of a text in plain Python: ASCII folded, runs of marks and digits one gap."""
    low = bytearray()
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b
        gap = (b < 65 and b != 39) or 91 <= b <= 96 or 123 <= b <= 127
        if not (gap and low[-1:] == b" "):
            low.append(32 if gap else b)
    return [bytes(low[i : i + n]) for n in langid.ORDERS for i in range(len(low) - n + 1)]


def test_masks_and_counts_by_force(spark):
    """A filter fitted on plain sets: every share is the plain one but for false positives, and these are no more than it says."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = docs.collect()
    model = langid.fit(docs, per_language=10**6)
    sets = defaultdict(Counter)
    for r in rows:
        sets[r.lang].update(set(grams_by_force(r.text)))
    of = Counter(r.lang for r in rows)
    sets = {lang: {g for g, n in c.items() if n >= max(2, of[lang] * 0.02)} for lang, c in sets.items()}
    assert model.languages == sorted(sets)
    texts = [r.text for r in rows[:60]] + ["A", "", "x1y 2", "l'été", "qq zz"]
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    shares = model.shares(raw, off)
    hits = {lang: 0 for lang in sets}
    strange = dict(hits)
    for k, t in enumerate(texts):
        grams = grams_by_force(t)
        for j, lang in enumerate(model.languages):
            true = sum(g in sets[lang] for g in grams)
            # undo the correction: the masks' own count, never below the true one
            count = shares[k, j] * (1 - model.false[j]) * max(len(grams), 1) + model.false[j] * len(grams)
            if shares[k, j] > 0:
                assert round(count) >= true and abs(count - round(count)) < 1e-6
                strange[lang] += round(count) - true
                hits[lang] += len(grams) - true
    assert all(strange[x] <= 3 * model.false[j] * hits[x] + 10 for j, x in enumerate(model.languages))


def test_filter_masks_hold_more_than_64_languages():
    names = [f"l{i:03}" for i in range(130)]
    grams = {n: np.arange(50, dtype=np.uint64) + np.uint64(1000 * i) for i, n in enumerate(names)}
    f = langid.LanguageFilter(names, grams)
    assert f.rows.shape[1] == 3
    for j in (0, 64, 129):
        at = f._places(grams[names[j]])
        bits = f.rows[at[0], j // 64] & f.rows[at[1], j // 64] & f.rows[at[2], j // 64]
        assert (bits >> np.uint64(j % 64) & np.uint64(1)).all()


# --- licences -----------------------------------------------------------------------------------------------------
def test_license_inheritance(spark):
    files = [("LICENSE", "Released under the MIT License."), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/x.txt", "nothing"), ("a/y.txt", None), ("a/z.txt", "This work is licensed under the GNU General Public License, version 3.\nmore"), ("q/w.txt", "this line on copyright says nothing")]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.own_license, r.license, r.from_path) for r in license.inherit(df.select("path", license.text_key().alias("text_key")), license.scan(df)).collect()}
    assert got["a/b/c/x.txt"] == (None, "Apache-2.0", "a/b") and got["a/y.txt"] == (None, "GPL-3.0", "a")
    assert got["q/w.txt"] == (None, "MIT", "") and got["a/z.txt"] == ("GPL-3.0", "GPL-3.0", "a/z.txt")


def test_license_statements(spark):
    """SPDX identifiers, statements inside longer lines and across line ends, licence texts, and licences that are not known."""
    prose = "as everyone who was there on that long and rainy day in the old town by the sea will surely remember"
    bsd = license._BSD
    texts = {
        "# SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: apache-2.0 */": "Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later\nint x;": "GPL-3.0",
        "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) */": "GPL-2.0", "SPDX-License-Identifier: Zlib": "Zlib",
        f"{prose} Released under the MIT License. {prose}": "MIT", f"{prose} Licensed under the Apache License, Version 2.0. {prose}": "Apache-2.0",
        f"{prose}\n * Licensed under the Apache\n * License, Version\n * 2.0.\n{prose}": "Apache-2.0", "This work is licensed under the GNU Lesser\nGeneral Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "Released under the ISC License.": "ISC",
        license.MORE[1][3]: "AGPL-3.0", "Copyright X\n\n" + "\n".join(bsd.split(": ")): "BSD-2-Clause", bsd + license.MORE[7][3][len(bsd) :]: "BSD-3-Clause", license.MORE[18][3]: "ISC",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.": "BSD-3-Clause", license._CC.format("Attribution-ShareAlike"): "CC-BY-SA-4.0",
        license.MORE[29][3]: "0BSD", license.MORE[30][3]: "BSD-4-Clause", license.MORE[31][3]: "BSL-1.0", license.MORE[36][3]: "PostgreSQL", license.MORE[37][3]: "Zlib", license.MORE[26][3]: "MIT", license.MORE[32][3]: "CC0-1.0",
        "Released under the Foo License.": None, "Licensed under the Apache License, Version 1.1.": None, f"your license to drive is lost {prose}": None, "This work is licensed under the GNU General Public License, version 1.": None,
    }
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    got = {r.path: r.own_license for r in license.scan(df).collect()}
    assert {t: got.get(str(k)) for k, t in enumerate(texts)} == texts


def test_texts_of_one_path_keep_their_own_licence(spark):
    """Null and repeated ids; a wrapped header that no single line states; each text has its own result, as by brute force."""
    import duckdb

    mozilla = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"
    texts = [(None, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (None, "no statement here"), (7, mozilla), (7, "SPDX-License-Identifier: (ISC OR Foo-1.0) WITH x"), (7, None), (3, "Apache\n2"), (60, "permission is granted\nas is"), (60, "mit mit license mit")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, license.scan_documents(df).collect()), key=repr)
    of = {(g[0], g[2]) for g in got}
    assert {(None, "MIT"), (None, "CC-BY-NC-4.0"), (None, None), (7, "MPL-2.0"), (7, "Foo-1.0"), (7, None)} <= of
    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(license.SQL.replace("doc_id // 1000", "doc_id::BIGINT // 1000").replace("doc_id // 50", "doc_id::BIGINT // 50").replace("coalesce(doc_id::VARCHAR", "coalesce(doc_id::BIGINT::VARCHAR")).fetchall()
    none = lambda rows: sorted((tuple(None if x != x else x for x in r) for r in rows), key=repr)
    assert [(None if r[0] is None else int(r[0]), *r[1:]) for r in none(want)] == got or none([(None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in want]) == got


def test_licenses_of_odd_rows(odd, odd_rows, none):
    assert license.scan_documents(odd).count() == len(odd_rows)
    assert license.scan_documents(none).count() == 0


# --- near duplicates ------------------------------------------------------------------------------------------------
def classes_by_force(rows, words=5):
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    up[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)] = min(doc, least.get(top(k), doc))
    return Counter((doc, len(sets[k]), least.get(top(k)) if sets[k] else doc) for k, (doc, _) in enumerate(rows))


def test_jaccard_of_odd_rows(odd, odd_rows, none):
    got = jaccard.similarity_components(odd).drop("text_hash")
    assert Counter(map(tuple, got.collect())) == classes_by_force([(r[0], r[1]) for r in odd_rows])
    assert jaccard.similarity_components(none).count() == 0


@pytest.mark.parametrize("chunk", [4096, 6])
def test_jaccard_of_families(spark, chunk):
    """Copies, chains of near copies, passages that many share; small chunks take the way of large families."""
    rng = np.random.default_rng(chunk)
    words = np.array([f"w{i}" for i in range(2000)])
    base = rng.choice(words, 60)
    rows, doc = [], 0
    for group in range(4):
        one = rng.choice(words, 80)
        for _ in range(15):
            copy = one.copy()
            copy[rng.integers(0, 80, rng.integers(0, 3))] = rng.choice(words)
            one = copy if rng.random() < 0.5 else one
            rows.append((doc, " ".join(copy)))
            doc += 1
        rows += [(doc + k, rows[-1][1]) for k in range(3)]
        doc += 3
    for _ in range(25):
        rows.append((doc, " ".join([*rng.choice(words, 20), *base, *rng.choice(words, int(rng.integers(0, 60)))])))
        doc += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, jaccard.similarity_components(df, chunk=chunk).drop("text_hash").collect())) == classes_by_force(rows)


def test_shingles_are_told_apart_by_all_bits(spark):
    """A word of 2048 letters and its complement in the order that defeats polynomials modulo powers of two; halves of hashes that clash."""
    odd = [bin(i).count("1") & 1 for i in range(2048)]
    words = ["".join(pair[b ^ k] for b in odd) for pair in ("eq", "ab", "01") for k in (0, 1)]
    rows = [(i, w) for i, w in enumerate([*words, words[0], *(f"{w} and four words more" for w in words)])]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()
    assert Counter(map(tuple, got)) == classes_by_force(rows)
    one = np.array([[5, 5, 5, 9], [1, 2, 1, 1]], np.uint64)
    assert jaccard._distinct(one).T.tolist() == [[5, 1], [5, 2], [9, 1]]
    ids = jaccard.numbered([one[:, :2], one[:, 2:]]).tolist()
    assert ids[0] == ids[2] and len(set(ids)) == 3


def test_frequencies_by_two_steps(spark, monkeypatch):
    """Wide ranges first: the sets, their order and their prefixes are those of one step."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lambda: sorted((r.doc_id, r.n, r.digest, r.k, r.shared) for r in jaccard.document_sets(df, 5, 75, group_bytes=20_000).collect())
    want = rows()
    monkeypatch.setattr(jaccard, "FAN", 4)
    assert rows() == want and any(r[3] for r in want)


def test_resolve_is_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(rng.choice(pool[:40] if rng.random() < 0.5 else pool[30:], rng.integers(1, 25))) for _ in range(20)]
        n = np.array([len(s) + int(rng.integers(0, 2)) for s in sets])
        got = jaccard.resolve([np.stack([s, s % np.uint64(7)]) for s in sets], n, 75)
        up = list(range(20))
        for a in range(20):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 75 * (n[a] + n[b] - i) and up[a] != up[b]:
                    old, new = max(up[a], up[b]), min(up[a], up[b])
                    up = [new if x == old else x for x in up]
        assert len(set(zip(got, up, strict=True))) == len(set(up)) == len(set(got))


@pytest.mark.parametrize("chunk", [4096, 6])
def test_jaccard_counts_every_link(spark, chunk, monkeypatch):
    """Near copies and exact ones in one family, null and repeated ids; small chunks take the way of large families and no broadcast."""
    monkeypatch.setattr(jaccard, "BROADCAST_SETS", 10**6 if chunk > 6 else 0)
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(900)])
    texts = [None, "", "two words", "Two  words"]
    for _ in range(3):
        base = rng.choice(words, 70)
        passage = rng.choice(words, 25)
        for _ in range(14):
            copy = base.copy()
            copy[rng.integers(0, 70, rng.integers(0, 4))] = rng.choice(words)
            texts += [" ".join(copy)] * int(rng.integers(1, 4))
            texts.append(" ".join([*rng.choice(words, 15), *passage, *rng.choice(words, int(rng.integers(0, 9)))]))
    rows = [(None if i % 19 == 0 else i - i % 2 if i % 17 == 0 else i, t) for i, t in enumerate(texts)]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    want = Counter()
    for a, (doc, _) in enumerate(rows):
        both = [len(sets[a] & s) for s in sets]
        want[(doc, len(sets[a]), sum(b != a and 100 * both[b] >= 75 * (len(sets[a]) + len(s) - both[b]) for b, s in enumerate(sets) if sets[a] and s))] += 1
    got = jaccard.similarity_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), chunk=chunk).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == want
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes_by_force(rows)
