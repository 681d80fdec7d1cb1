"""Language identification by language-bitmask n-gram filters (operator 6).

For each language the n-grams found in a small share of its documents, and in two at least, form a set. All sets lie in one bit-sliced Bloom filter: row r
of the filter is a bitmask of languages, and the AND of an n-gram's rows is the set of all languages that contain it, in one
lookup whatever the number of languages. A text's mask bits are counted by language; each count is corrected for
the filter's false positives (c - f n) / (1 - f) and divided by the share that texts of that language have in training; the
largest decides.

The filter is fitted on a bounded sample: ``per_language`` labelled documents of each language, chosen by a hash of the id,
whole texts, and all n-grams that a share ``common`` of them have (two at least). The filter is sized from their number; as the sample is bounded, what
reaches each task does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import mix, parallelism, pieces, release, shared_folder, thrifty, written

ORDERS = (2, 3, 4)
HASHES = 3
#: Ids and languages of the sample are broadcast up to so many rows (a few MB).
BROADCAST_ROWS = 100_000
#: Parts that the sample is first taken from; the last choice reads at most so many samples of a language.
SAMPLE_PARTS = 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[k for k in range(65) if k != 39]] = 32  # digits and marks part words
_FOLD[[*range(91, 97), *range(123, 128)]] = 32


def gram_hashes(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each, hash) of the byte n-grams of each order inside texts, case folded; runs of marks count as one gap."""
    low = _FOLD[raw]
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    gap = low == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1] | (doc[1:] != doc[:-1])
    low, doc = low[keep].astype(np.uint64), doc[keep]
    for n in ORDERS:
        if len(low) < n:
            continue
        h = np.zeros(len(low) - n + 1, np.uint64)
        for k in range(n):
            h = (h << np.uint64(8)) | low[k : len(low) - n + 1 + k]
        same = doc[n - 1 :] == doc[: len(doc) - n + 1]
        yield doc[n - 1 :][same], h[same] | np.uint64(n << 40)


class LanguageFilter:
    """Bit-sliced Bloom filter of n-gram sets; masks of 64 languages a word."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]) -> None:
        self.languages = languages
        n = max([1, *map(len, grams.values())])
        self.size = 1 << max(10, int(n * 16).bit_length())
        self.rows = np.zeros((self.size, -(-max(len(languages), 1) // 64)), np.uint64)
        for j, lang in enumerate(languages):
            for at in self._places(grams[lang]):
                np.bitwise_or.at(self.rows[:, j // 64], at, np.uint64(1 << (j % 64)))
        fill = np.array([float((self.rows[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)).mean()) for j in range(len(languages))])
        self.false = fill**HASHES
        self.usual = np.ones(len(languages))

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        a = mix(h)
        b = (a >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(k) * b) & np.uint64(self.size - 1)).astype(np.int64) for k in range(HASHES)]

    def shares(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages): corrected share of each text's n-grams that each language contains."""
        docs, langs = len(off) - 1, len(self.languages)
        count, total = np.zeros((docs, langs)), np.zeros(docs)
        for doc, h in gram_hashes(raw, off):
            at = self._places(h)
            mask = self.rows[at[0]]
            for other in at[1:]:
                mask &= self.rows[other]
            total += np.bincount(doc, minlength=docs)
            for j in range(langs):
                hit = (mask[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)).astype(bool)
                count[:, j] += np.bincount(doc[hit], minlength=docs)
        share = (count - self.false * total[:, None]) / (1 - np.minimum(self.false, 0.99)) / np.maximum(total, 1)[:, None]
        return np.clip(share, 0, None)


def fit(labelled: DataFrame, per_language: int = 300, common: float = 0.02) -> LanguageFilter:
    """The filter of ``labelled`` (id, text, lang): a bounded sample of each language by the hash of the id."""
    order = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
    named = labelled.where("lang is not null and doc_id is not null and text is not null")
    # first among the tasks of a part, then among the parts: what meets in one task for a language doesn't grow with the data
    chosen = named.select("doc_id", "lang", (F.spark_partition_id() % SAMPLE_PARTS).alias("part"))
    for keys in (["part"], []):
        chosen = chosen.withColumn("k", order(*keys)).where(F.col("k") <= per_language).drop("k")
    chosen = chosen.select("doc_id", "lang")
    folder = shared_folder(labelled.sparkSession, "fit")
    chosen = written(chosen, "chosen", folder)
    small = chosen.count() <= BROADCAST_ROWS  # else, with very many languages, Spark joins by a shuffle
    sample = named.select("doc_id", "lang", "text").join(F.broadcast(chosen) if small else chosen, ["doc_id", "lang"], "left_semi")
    sample = written(sample.repartition(parallelism(labelled.sparkSession)), "sample", folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, b, raw, off in pieces(batch.column(1)):
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                for doc, h in gram_hashes(raw, off):
                    once = np.unique((doc.astype(np.uint64) << np.uint64(43)) | h)  # a text counts once for each n-gram
                    lang, gram = code[(once >> np.uint64(43)).astype(np.int64)].astype(np.uint64), once & np.uint64((1 << 43) - 1)
                    both, n = np.unique((lang << np.uint64(43)) | gram, return_counts=True)
                    lang, gram = both >> np.uint64(43), both & np.uint64((1 << 43) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(names[lang.astype(int)].tolist(), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    found = sample.select("lang", "text").mapInArrow(thrifty(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    fitted = sample.groupBy("lang").agg(F.count("*").alias("of"))
    table = found.join(fitted, "lang").where(F.col("n") >= F.greatest(F.lit(2), F.col("of") * common)).select("lang", "gram").toPandas()  # bounded by the sample
    languages = sorted(table["lang"].unique())
    model = LanguageFilter(languages, {x: table.loc[table["lang"] == x, "gram"].to_numpy().astype(np.uint64) for x in languages})

    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, raw, off in pieces(batch.column(1)):
                share = model.shares(raw, off)
                own = [float(share[k, languages.index(langs[a + k])]) for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(langs[a:b], pa.string()), pa.array(own, pa.float64())], ["lang", "share"])

    means = {r[0]: r[1] for r in sample.select("lang", "text").mapInArrow(thrifty(usual), "lang string, share double").groupBy("lang").agg(F.expr("percentile_approx(share, 0.5)")).collect()}
    release(labelled.sparkSession, folder)
    model.usual = np.array([max(means.get(x) or 1.0, 1e-6) for x in languages])
    return model


def predict(docs: DataFrame, model: LanguageFilter, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` with lang_pred and score of every whole text.

    ``und`` with score 0 where the text is null or has no letter (and where nothing was learned). Equal shares go to the
    first language by name. Score: the winner's part of all languages' shares (1 / languages if no n-gram is known).
    """
    own = docs.select(*columns, F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    fields = [f for f in own.schema.fields if f.name in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            letters = batch.column(len(columns) + 1).to_numpy(zero_copy_only=False)
            for a, b, raw, off in pieces(batch.column(len(columns))):
                if model.languages:
                    share = model.shares(raw, off) / model.usual
                    total = share.sum(axis=1)
                    best = share.argmax(axis=1)
                    s = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1e-300), 1 / len(model.languages))
                else:
                    best, s = np.full(b - a, -1), np.zeros(b - a)
                best, s = np.where(letters[a:b], best, -1), np.where(letters[a:b], s, 0.0)
                own = (batch.column(k).slice(a, b - a) for k in range(len(columns)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(names[best].tolist(), pa.string()), pa.array(s, pa.float64())], [*columns, "lang_pred", "score"])

    return own.mapInArrow(thrifty(say), schema)


def _third(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from labelled rows whose crc32(doc_id) mod 4 is not 2.

    A null id is not held out and not learned from; repeated rows give repeated results; an empty table gives an empty
    table. Every text is read whole, whatever its length. Other columns are not read, so their names don't matter. ``keep``: columns to carry instead of doc_id and held_out.
    """
    model = fit(docs.where(_third() != 2).select("doc_id", "text", "lang"))
    own = docs if keep else docs.select("doc_id", "text", F.coalesce(_third() == 2, F.lit(False)).alias("held_out"))
    return predict(own, model, keep or ["doc_id", "held_out"])
