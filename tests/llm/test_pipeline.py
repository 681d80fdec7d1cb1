import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F
from test_text import classes_by_force
from test_tokens import check_packing
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from hexloom.llm import langid, packing, queries


def test_all_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mix", "pack"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = entry.queries()[name](spark, data)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    key = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    other = [tuple(r[want.columns.index(x)] for x in cols) for r in want.fetchall()]
    assert key(tuple(r[x] for x in cols) for r in got.collect()) == key(other)


def classes_of(rows):
    """The component of every id, where ids are distinct."""
    return {doc: component for doc, _, component in classes_by_force(rows)}


def mixed_by_force(rows, temper=0.5):
    """Each row as often as its source's rate and the number hashed from its id (or its text) say."""
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text or "")
    weight = {s: n**temper for s, n in size.items()}
    out = []
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * sum(size.values()) / size[r.source] if size[r.source] and sum(weight.values()) else 1.0
        parts, many = max(1, math.ceil(rate / 32)), 0
        name = "null:" + hashlib.md5((r.text or "").encode()).hexdigest() if r.doc_id is None else r.doc_id
        for k in range(1, parts + 1):
            u = int(hashlib.md5(f"mix:{name}:{k}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            n = 0
            while c <= u:
                n += 1
                p *= rate / parts / n
                c += p
            many += n
        out += [tuple(r)] * many
    return out


def pieces_by_force(vocab, rows, capacity=1024):
    tok, want = Tokenizer.from_file(vocab), Counter()
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        at, piece = 0, 0
        while at < len(ids):
            end = at + ((len(ids) - 1) % capacity + 1 if at == 0 else capacity)
            part = ids[at:end]
            want[(doc, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
            at, piece = end, piece + 1
    return want


def test_run_by_force(spark, data, vocab):
    """The pipeline over a whole table against its stages in plain Python; languages by the fitted model alone decide what is dropped."""
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    kept = [r for r in docs if r.text and re.search(r"[^\W\d_]", r.text)]
    classes = classes_of([(r.doc_id, r.text) for r in kept])
    first = {}
    for r in kept:
        first[classes[r.doc_id]] = min(r.doc_id, first.get(classes[r.doc_id], r.doc_id))
    left = [r for r in kept if first[classes[r.doc_id]] == r.doc_id]
    mixed = mixed_by_force(left)
    assert check_packing(corpus_pipeline.run(spark, data).collect(), pieces_by_force(vocab, [(r[0], r[1]) for r in mixed]), 1024)


def test_stages_on_odd_rows(spark, odd, none, tmp_path, vocab):
    for start in (odd, none):
        docs = start.select(*corpus_pipeline.COLUMNS)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if k < 3:
                assert out.columns == corpus_pipeline.COLUMNS
            path = str(tmp_path / f"{k}-{start is odd}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if start is odd and k == 0:
                assert docs.where("doc_id in (0, 1, 2, 12)").count() == 0
            if start is odd and k == 1:
                assert docs.groupBy("doc_id", "text").count().where("count > 1").count() == 0
                assert docs.where("doc_id = 3").count() == 2 and docs.where("doc_id is null").count() == 1
                assert docs.where("doc_id in (5, 7, 11)").count() == 0
            if k == 2:
                assert Counter(map(tuple, docs.collect())) == Counter(mixed_by_force(before))
            if k == 3:
                check_packing(docs.collect(), pieces_by_force(vocab, [(r.doc_id, r.text) for r in before]), 1024)
            before = docs.collect()


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    total = out.agg(F.sum("length"), F.count_distinct("sequence_id"), F.max(F.col("offset") + F.col("length"))).first()
    assert total[2] <= 1024 and total[1] <= -(-total[0] // 1024) * 1.05 + 1


def test_one_of_each_group_stays(spark):
    """Also where ids are null or repeated; a group of its own without words stays."""
    said = [" ".join(f"{x}{k}" for k in range(40)) for x in "abcd"]
    rows = [(None, said[0]), (None, said[0] + " end"), (1, said[1]), (1, said[1] + " end"), (None, said[2]), (7, said[2] + " end"), (9, said[2]), (3, said[3]), (3, said[3]), (4, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(("null" if r.doc_id is None else str(r.doc_id)) for r in got) == ["1", "3", "4", "4", "5", "7", "null"]


def test_workers_let_tables_go(spark, data):
    """Python workers, used again by later stages, don't hold the tokenizer's tables any more once a stage has no use for them."""
    held = lambda: sum(p.memory_info().rss for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline()))
    docs = spark.read.parquet(f"{data}/documents.parquet").coalesce(1)
    model = langid.LanguageFilter(["a"], {"a": np.arange(1000, dtype=np.uint64)})

    def sizes():
        for _ in range(16):  # every idle worker has its turn
            langid.predict(docs, model, ["doc_id", "text"]).write.format("noop").mode("overwrite").save()
        return held()

    before = sizes()
    packing.pieces_of(docs, queries.vocabulary(), 2, 1024).write.format("noop").mode("overwrite").save()
    assert sizes() - before < 30e6
