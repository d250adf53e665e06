"""The registered queries of the corpus operators: thin digests of their results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpath.context import checkpoint_dir
from clickpath.llm import (bpe_codec, fingerprints, hard_negatives, importance_resampling, language_id, license_scan, line_dedup,
                           minhash_dedup, source_mix, substring_dedup, token_counts, topk_search, warc)
from clickpath.llm.common import table
from clickpath.llm.sql import ORACLE_SQL  # noqa: F401

OVER_LIMIT_TOKENS = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT_TOKENS)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_likeness(fingerprints.with_next_edit(table(spark, sf_dir, "documents")),
                                      {"near_edited": ("fp", "edited_fp"), "near_next": ("fp", "next_fp")})
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprints.as_text(F.col("fp")).alias("fingerprint"),
                       fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    trees = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"), "page_id", line_dedup.host_of(F.col("url")),
                                       line_dedup.page_text(F.col("html")))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe_codec.round_trip(table(spark, sf_dir, "documents"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *bpe_codec.digests(F.col("ids"), F.col("text")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex[:12]}"
    warc.archive(table(spark, sf_dir, "pages"), path, "page_id", F.col("url"), F.col("html"))
    return warc.read_pages(spark, path, "page_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_license_scan, op3_fingerprints, op4_near_duplicates, op5_substring_dedup, op6_topk_search,
    op7_language_id, op8_line_dedup, op9_bpe_codec, op10_source_mix, op11_warc, op12_importance_resampling, op13_hard_negatives)}
