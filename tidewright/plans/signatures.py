"""Fingerprint and MinHash queries over the whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import signatures as S
from tidewright.operators.dedup import fingerprints, near_pairs
from tidewright.operators.graph import shared_table
from tidewright.plans.registry import query, table


@query()
def x18_identity_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.identity_prints(table(spark, sf_dir, "documents"))


@query()
def x21_simhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band keys of every document's SimHash."""
    return fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "print", S.print_bands(F.col("print")).alias("bands"))


@query()
def x22_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.signatures(table(spark, sf_dir, "documents"))


@query()
def x24_minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.signatures(table(spark, sf_dir, "documents")).select("doc_id", S.signature_bands().alias("bands"))


@query()
def x23_estimated_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated similarity of every document with the first document of each of its bands, where they differ.

    Equal signatures are one row before the bands meet, and each meets only its
    band's first, so a large family gives one pair a member and band, not all pairs.
    """
    signed = shared_table(S.signatures(table(spark, sf_dir, "documents")), "signatures")
    classes = shared_table(signed.filter(F.size("signature") > 0).groupBy("signature").agg(F.min("doc_id").alias("doc_id")), "classes")
    banded = shared_table(classes.select("doc_id", F.explode(S.signature_bands()).alias("band")), "bands")
    first = banded.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = banded.join(first, "band").filter("doc_id != first").select("first", "doc_id").distinct()
    left = classes.select(F.col("doc_id").alias("first"), F.col("signature").alias("a"))
    right = classes.select("doc_id", F.col("signature").alias("b"))
    return pairs.join(left, "first").join(right, "doc_id").select("first", "doc_id", F.round(S.agreement(F.col("a"), F.col("b")), 6).alias("similarity"))


@query()
def x20_near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different SimHashes of documents within three bits, through four bands; 0 never matches."""
    return near_pairs(fingerprints(table(spark, sf_dir, "documents")).filter("print != 0").select("print").distinct())
