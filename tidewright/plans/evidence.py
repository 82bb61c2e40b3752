"""Names compared, keyword phrases, near-duplicates in rank order and evidence packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.names import normalize_name
from tidewright.operators import context, phrases
from tidewright.operators.dedup import fingerprints
from tidewright.operators.graph import shared_table
from tidewright.operators.ranking import top_per_group
from tidewright.operators.similarity import name_similarity, token_coverage
from tidewright.plans.registry import query, table

STOPS = "a an and are as at be but by das der die for from il in is it la le les of on or that the this to und was with".split()
POOL, BUDGET = 150, 400


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name beside the name of its type: one row a different pair."""
    part = table(spark, sf_dir, "part")
    return part.select(normalize_name(F.col("p_name"), ["inc", "ltd"]).alias("a"), normalize_name(F.concat_ws(" ", "p_type", "p_name"), ["inc", "ltd"]).alias("b")).distinct()


@query()
def x30_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("a", "b", F.round(name_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query()
def x31_token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("a", "b", F.round(token_coverage(F.col("a"), F.col("b")), 6).alias("coverage"))


def all_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.candidate_phrases(table(spark, sf_dir, "documents"), STOPS)


@query()
def x33_candidate_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_phrases(spark, sf_dir).select("doc_id", "at", "surface", F.size("words").alias("n_words"))


@query()
def x34_phrase_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.word_scores(all_phrases(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query()
def x32_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.keywords(phrases.scored_phrases(table(spark, sf_dir, "documents"), STOPS))


@query()
def w08_rank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents of every language and source as pools; near copies count for the first of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.crc32(F.concat_ws("/", "lang", "source").cast("binary")).alias("query_id"))
    pool = shared_table(top_per_group(docs, ["query_id"], [F.desc("n_chars"), F.col("doc_id")], POOL, "rank"), "pool")
    prints = fingerprints(table(spark, sf_dir, "documents").join(pool.select("doc_id").distinct(), "doc_id", "left_semi"))
    known = pool.join(prints, "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "rank", F.nullif(F.col("print"), F.lit(0)).alias("print"))
    return context.collapse_near_duplicates(known)


@query()
def t07_evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as passages and their lines as facts, fitted to a budget; one order of each priority first."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("query_id"), F.col("o_orderkey").cast("long").alias("id"), F.crc32(F.col("o_orderpriority").cast("binary")).alias("signal"), F.col("o_totalprice").alias("score"), F.lit(40).cast("long").alias("cost"))
    lines = table(spark, sf_dir, "lineitem").join(orders.select("query_id", F.col("id").alias("l_orderkey")), "l_orderkey")
    facts = lines.select("query_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_discount").alias("score"), (F.col("l_linestatus") == "O").alias("current"), F.col("l_quantity").cast("long").alias("cost"))
    passages = top_per_group(orders, ["query_id"], [F.desc("score"), F.col("id")], POOL).drop("rn")
    return context.pack_evidence(passages, top_per_group(facts, ["query_id"], [F.desc("score"), F.desc("current"), F.col("id")], POOL).drop("rn"), BUDGET)
