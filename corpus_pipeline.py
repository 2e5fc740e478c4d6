"""A training corpus from `documents` in five stages, each of which works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import byte_bpe, decontaminate, jaccard_join, langid, secrets, storage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay; the model learns from the labelled documents outside the held-out quarter."""
    model = langid.fit(docs.where(langid.is_training("doc_id")), "text", "lang")
    found = langid.identify(docs, "doc_id", "text", model, carry=True)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 5-word shingles at 80 % connect, the document with the smallest id stays; op3 has sizes of its own."""
    return jaccard_join.representatives(docs, "doc_id", "text", size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each character of a secret becomes an asterisk."""
    found = secrets.find_secrets(docs, "doc_id", "text", mask=True)
    return found.select(*(F.col("masked").alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as counts and digests, and the digest of the decoded bytes."""
    return byte_bpe.encode(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("token_ids", token_ids),
]

#: SQL expresses neither the mixture model nor the merges; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = storage.written(docs, name)
    return docs
