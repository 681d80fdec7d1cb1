"""A corpus from raw documents to packed sequences: language ID, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.llm import jaccard, langid, packing, poisson
from hexloom.llm.common import written
from hexloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language (no text or no letter); lang becomes the predicted one.

    Null and empty texts go; texts of any length are read whole; null ids and sources, ties and repeated rows pass as they are;
    an empty table stays empty. Only the five columns of ``documents`` are read, so further ones and their names don't matter.
    """
    said = langid.identify(docs, COLUMNS)
    return said.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id; documents without words stay.

    Rows are told apart by id and text. In a group a null id ranks after all others, and of several texts of one id
    the one with the smallest hash stays. Repeated rows of what stays are one document. Null, empty and blank texts link with
    nothing and stay; texts of any length are held whole; an empty table stays empty; further columns are not read.
    """
    found = jaccard.similarity_classes(docs)
    alone = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("text_hash"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy(F.coalesce("class_key", alone.cast("binary")).alias("key")).agg(F.min(rank).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.substring(F.unhex(F.sha2("text", 256)), 1, 16).eqNullSafe(F.col("_hash"))
    return docs.select(*COLUMNS).join(first, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come to their target weights, shuffled.

    A null source is one of its own; rows of one id draw alike, rows without an id by their text; repeated rows draw each for itself;
    null and empty texts have no weight and keep their rate; an empty table stays empty; further columns are dropped at the end.
    """
    return poisson.replicate(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens.

    Null and empty texts are one piece, their end mark; longer ones are cut, none is dropped; repeated rows and null ids are packed as
    often as they stand; pieces of one length are alike, so ties don't matter; an empty table gives no pieces; further columns are not read.
    """
    return packing.pack_documents(docs, vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Tokenizers and a fitted model stand in the way of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
