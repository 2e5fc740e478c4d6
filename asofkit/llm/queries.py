"""The registered queries of this package: each reads its whole table and applies one operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_merge, byte_bpe, curriculum, decontaminate, jaccard_join, langid, matroska, pivot_clusters, ranked_search, recompression, secrets, storage, token_counts, twins, zip_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = matroska.store_media(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return matroska.media_report(media, "doc_id", "media", "n_bytes")


def op2_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_shingles", "component_id")


def op4_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.is_training("doc_id")), "text", "lang")
    found = langid.identify(docs, "doc_id", "text", model)
    return found.select("doc_id", (~langid.is_training("doc_id")).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.shared_folder(spark, "archives")
    pages = _table(spark, sf_dir, "pages")
    zip_warc.build_archives(pages, "page_id", "url", "html").write.parquet(folder)
    return zip_warc.read_archives(spark.read.parquet(folder), id_kind=dict(pages.dtypes)["page_id"]).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.RULES if r.base]
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), "doc_id", "text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


def op11_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def op12_document_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.clustered(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_matroska, op2_bwt_merge, op3_jaccard_join, op4_phrase_index, op5_language_mixture, op6_byte_bpe, op7_recompression, op8_zip_warc, op9_trigram_secrets, op10_token_counts, op11_curriculum, op12_document_trie, op13_pivot_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op9_trigram_secrets": twins.SECRETS, "op2_bwt_merge": twins.BWT_MERGE, "op8_zip_warc": twins.ZIP_WARC, "op3_jaccard_join": twins.JACCARD_JOIN, "op4_phrase_index": twins.PHRASE_INDEX, "op7_recompression": twins.RECOMPRESSION, "op11_curriculum": twins.CURRICULUM, "op12_document_trie": twins.DOCUMENT_TRIE, "op13_pivot_clusters": twins.PIVOT_CLUSTERS}
