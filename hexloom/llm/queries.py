"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.llm import bitplane, chat, jaccard, langid, license, packing, poisson, qalsh, transducer, winnow
from hexloom.llm.common import shared_folder


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; it is installed on every machine and not part of this repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "planes")
    bitplane.write_planes(table(spark, sf_dir, "documents"), path, vocabulary())
    return bitplane.read_documents(spark, path)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(probe)))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson.replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "copy", F.round("rate", 9).alias("rate"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op6_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_documents(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_links(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qalsh.nearest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bit_planes, op2_best_fit_packing, op3_chat_windows, op4_poisson_mix, op5_winnowing, op6_language_filter, op7_token_counts, op8_license_scan, op9_jaccard_join, op10_collision_neighbours, pipeline)
}

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i : i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, coalesce(l.n_links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) l ON l.a = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op4_poisson_mix": poisson.SQL.format(columns="doc_id, text, lang, source, n_chars, copy, round(rate, 9) AS rate"),
    "op8_license_scan": license.SQL,
    "op9_jaccard_join": _JACCARD_SQL,
}
