import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties and repeated rows, a very long word and a very long text.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (None, "one two three", None, "a", None),
    (5, "x" * 50_000, "en", "b", 50_000), (6, "alpha beta gamma delta " * 3000, "de", "b", 69_000), (7, "He " * 400, "en", "b", 1200), (8, "ab " * 399 + "ab", "en", "b", 1199),
    (9, "Ünïcödé ÀÉ straße 日本語 😀 text", "fr", "c", 28), (10, "#$%& | <tag> *** 1234", "xx", "c", 21), (None, None, None, None, None), (11, "\n\n\n", "en", "c", 3),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with extra columns of names that operators use inside or add."""
    names = ("n_words", "n_lines", "n_dropped", "n_removed", "ids", "n_tokens", "size", "shard", "slot", "key", "doc", "t", "u", "rank", "score", "lead", "pos", "words", "language", "__text", "salt", "anchor", "node", "family", "epoch", "block", "taken", "h", "lost", "g", "d")
    return odd.select("*", *[F.lit("own").alias(c) for c in names])
