"""A corpus pipeline: language, near-duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""
from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import backtrack_bpe, language_id, secret_scan, simhash, template_leaks
from quiremill.llm.common import table
from quiremill.session import scratch_path

LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with some certainty, go. Learned from the labelled rows."""
    return language_id.keep_known(docs, language_id.train(docs), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, size=5, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, units or names, go."""
    return template_leaks.remove(docs, template_leaks.leaks(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; all documents stay."""
    return secret_scan.redact(docs, secret_scan.scan(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of the text decoded from them."""
    keep = ("doc_id", "lang", "source", "n_chars")
    found = backtrack_bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), keep)
    return found.select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("bpe_encoding", encode_tokens),
]

ORACLE_SQL = None       # fitted models and an exact tokenizer have no SQL form; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
