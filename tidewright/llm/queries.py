"""The operators as queries over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import additive_model, byte_bpe, embedding_dedup, histogram_sort, jaccard_join, masked_lm, packing, periodic_runs, pii, quality_rules, suffix_dedup, svd_whitening, url_templates
from tidewright.llm.common import load
from tidewright.llm.oracle import ORACLE_SQL


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(load(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("stratum")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(load(spark, sf_dir, "documents"))


def url_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page's url ends in the number of the document it shows; bad is low quality or toxic."""
    number = F.regexp_extract(url_templates.path(), r"/([0-9]{1,18})[^/]*/?$", 1)
    shown = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    bad = labels.select("doc_id", ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return shown.filter("doc_id is not null").join(bad, "doc_id").select("page_id", "bad")


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.filter_urls(pages, url_labels(pages, load(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort.place(load(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    crc = F.crc32(F.coalesce("row.text", F.lit("")))
    return placed.select("row.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_model.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(load(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(load(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(load(spark, sf_dir, "documents"))


def op13_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svd_whitening.digests(load(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_masked_lm, op2_quality_rules, op3_jaccard_join, op4_url_templates, op5_byte_bpe, op6_histogram_sort, op7_additive_model, op8_harmonic_packing, op9_embedding_dedup, op10_pii, op11_periodic_runs, op12_suffix_dedup, op13_svd_whitening)}

__all__ = ["ORACLE_SQL", "QUERIES"]
