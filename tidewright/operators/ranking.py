"""Ranking: fusion, top per group, retrieval metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fusion constant and weights per backend.
FUSION_K = 60
FUSION_WEIGHTS = {"keyword": 1.0, "vector": 1.0, "graph": 0.8}


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of every group with their rank; Spark drops later rows before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= n).withColumn(name, F.col(name).cast("long"))


def least_values(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, values): the ``n`` least different values of every key in order; only so many of a key ever meet in one row."""
    few = top_per_group(rows.select(key, value).distinct(), [key], [F.asc_nulls_last(value)], n)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def reciprocal_rank_fusion(ranked: DataFrame, query: Sequence[str] = (), k: int = FUSION_K) -> DataFrame:
    """Fused score of (backend, chunk_id, rank): sum of weight / (k + rank); also number of backends and best rank."""
    weight = F.lit(1.0)
    for backend, w in FUSION_WEIGHTS.items():
        weight = F.when(F.col("backend") == backend, w).otherwise(weight)
    return ranked.groupBy(*query, "chunk_id").agg(F.sum(weight / (k + F.col("rank"))).alias("score"), F.countDistinct("backend").alias("backends"), F.min("rank").alias("best_rank"))


def retrieval_metrics(runs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Metrics per query and k from (query_id, rank, grade) with every judged document, rank null if not returned.

    A document is relevant from grade 1 on.  Recall, average precision and nDCG
    are 1, 0 and 1 where nothing is relevant.
    """
    return counted_metrics(runs.filter("rank is not null"), runs.groupBy("query_id", "grade").agg(F.count("*").alias("n")), ks)


def counted_metrics(returned: DataFrame, grades: DataFrame, ks: Sequence[int]) -> DataFrame:
    """:func:`retrieval_metrics` of the returned documents (query_id, rank, grade) and how many were judged (query_id, grade, n).

    What was not returned counts by its grade alone, so it need not come as rows.
    """
    gain = F.pow(F.lit(2.0), F.least(F.greatest("grade", F.lit(0)), F.lit(3))) - 1
    rel = (F.col("grade") >= 1).cast("int")
    by_rank, by_grade = Window.partitionBy("query_id").orderBy("rank"), Window.partitionBy("query_id").orderBy(F.desc("grade"))
    # The ideal order has the grades one behind the other; only its first places are made.
    before = grades.select("query_id", "grade", "n", (F.sum("n").over(by_grade) - F.col("n")).alias("before")).filter(F.col("before") < max(ks))
    places = before.select("query_id", gain.alias("gain"), F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(max(ks)).cast("long")))).alias("place"))
    # Sums up to each k at once: one row a query, whatever the number of ks.
    upto = lambda place, value: F.array(*[F.sum(F.when(F.col(place) <= k, value).otherwise(0.0)) for k in ks])
    best = places.groupBy("query_id").agg(upto("place", F.col("gain") / F.log2(F.col("place") + 1)).alias("best"))
    rows = returned.withColumn("rel", rel).withColumn("gain", gain).withColumn("hits", F.sum("rel").over(by_rank))
    ap = F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0))
    found = rows.groupBy("query_id").agg(upto("rank", F.col("rel")).alias("found"), upto("rank", F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), ap.alias("ap"))
    totals = grades.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("grade") >= 1, F.col("n"))), F.lit(0)).alias("total"))
    each = totals.join(found, "query_id", "left").join(best, "query_id", "left").withColumn("at", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(ks)])))
    at = lambda c: F.coalesce(F.get(c, F.col("at.i")), F.lit(0.0)).alias(c)
    out = each.select("query_id", F.col("at.k").alias("k"), "total", "first", F.coalesce("ap", F.lit(0.0)).alias("ap"), at("found"), at("dcg"), at("best"))
    total, found, best = F.col("total"), F.col("found"), F.col("best")
    out = out.select("query_id", "k", (found / F.col("k")).alias("precision"), F.when(total > 0, found / total).otherwise(1.0).alias("recall"), F.when(found > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.when(total > 0, F.col("ap") / total).otherwise(0.0).alias("average_precision"), F.when(best > 0, F.col("dcg") / best).otherwise(1.0).alias("ndcg"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
