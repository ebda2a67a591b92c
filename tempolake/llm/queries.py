"""The queries of this package, by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, language, line_dedup, mixing, oracle, quality_gam, quality_rules, sharding, substring, topk
from .shared import table


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
        decoded="decoded", keep_text=False,
    )
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", "n_blocks", "first_shard")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    found = topk.exact_top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = language.train(docs, "doc_id", "text", "lang")
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source"), suffix=language.suffix_of(F.col("source")), keep_text=False)
    return found.select("doc_id", F.col("lang").alias("declared"), "language", F.round("posterior", 6).alias("posterior"), F.col("accepted").alias("kept"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID of raw web pages: the text model of documents, the markup's lang attribute, and the address."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-zA-Z]+)""", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("url", r"(?i)^[a-z]+://([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select("page_id", bare.alias("text"), declared.alias("declared"), host.alias("host"))
    found = language.identify(
        rows, language.train(docs, "doc_id", "text", "lang"), declared=F.col("declared"), host=F.col("host"), suffix=language.suffix_of(F.col("host")), keep_text=False
    )
    return found.select("page_id", "declared", "host", "language", F.round("posterior", 6).alias("posterior"), F.col("accepted").alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_gam, op3_mixing, op4_language_id, op5_sharding, op6_line_dedup, op7_exact_top_k, op8_byte_bpe, op9_ngram_jaccard, op10_quality_rules, page_language)}


def oracle_sql() -> dict[str, str]:
    """The other queries draw, learn or encode; they are tested against brute force instead."""
    return {"op1_substring_dedup": oracle.OP1, "op6_line_dedup": oracle.OP6, "op7_exact_top_k": oracle.OP7, "op9_ngram_jaccard": oracle.OP9, "op10_quality_rules": oracle.OP10}
