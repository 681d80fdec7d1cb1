import pytest
from pyspark.sql import functions as F

from hexloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gid int, part int, rank long, k int, window int, shared binary"


@pytest.fixture(scope="session")
def vocab():
    return vocabulary()


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, tied and repeated rows, special strings."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [None, "", "   \n\t", "one", "one two three four", "one two three four", "a b c d e f g h i j", "A b c d e f g h i j", "don't 's <|endoftext|> [INST] ok", "é" * 700, long_text, long_text + " tail", "12 34 !?", "日本語 テキスト", "x" * 5000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, 7), (None, None, None, None, None), rows[6], rows[6], (3, "another text of id three", "en", "s1", 9)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, b"x") for r in odd_rows], SCHEMA)
    return docs.repartition(4, F.col("n_chars")).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
