"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.bpe import encode_texts
from tabwright.llm.crf import UNKNOWN, fit_language_model, language_of
from tabwright.llm.golay import one_of_each
from tabwright.llm.secrets import redacted
from tabwright.llm.text import kept_column
from tabwright.llm.wumanber import benchmark_spans
from tabwright.session import scratch_path

#: mean posterior below which no language is taken to be recognised
LEAST_LANGUAGE_SCORE = 0.35


def kept_columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[kept_column(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: no text, no letter, or no language ahead of the others.

    The model learns from the ``lang`` column of the documents given. Of languages
    with equal shares the first by name counts.
    """
    model = fit_language_model(docs)
    found = language_of(docs, model, *docs.columns)
    return kept_columns(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id.

    Fingerprints of three-word shingles link at two or fewer differing bits.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark; null and empty texts hold none, repeated rows go or stay together."""
    found = benchmark_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), *docs.columns)
    return kept_columns(found.where(F.size("spans") == 0), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; every document stays. ``n_chars`` follows the text."""
    clean = redacted(docs)
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): token ids, and whether they decode to the text.

    A row per document, repeated ones included; a null text is empty and has no ids.
    """
    return encode_texts(docs).select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: learned labels, fingerprint components and token merges are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
