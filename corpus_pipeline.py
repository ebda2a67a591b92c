"""A corpus pipeline over ``documents``: language ID, line dedup, near-duplicate removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolake.llm import bpe, jaccard, language, line_dedup, mixing
from tempolake.llm.shared import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told by text, declaration and host; ``lang`` becomes that language."""
    model = language.train(docs, "doc_id", "text", "lang")
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source"), suffix=language.suffix_of(F.col("source")))
    kept = found.filter("accepted").withColumn("lang", F.col("language"))
    return kept.select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents share from all but the last of them."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the smallest doc_id stays."""
    found = jaccard.jaccard_components(docs, n=5, num=80, den=100)
    others = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(others.hint("shuffle_hash"), docs["doc_id"] == F.col("gone"), "left_anti")
    return left.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: a row for each pass over a document that takes words of it."""
    mixed = mixing.mixed_documents(docs, mixing.mix(docs))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix (little-endian unsigned 32-bit), and whether they decode to its text."""
    import public_tokenizers

    # the text's digest goes along instead of the text, which would come back from Python beside the decoded bytes
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    coded = bpe.encode(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded", keep_text=False)
    exact = F.sha2("decoded", 256) == F.col("text_sha256")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", exact.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: SQL expresses neither the language model nor the components, draws and merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/stage-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
