"""Keyed merges of a stored table with a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_nodes(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, first_seen, last_seen, source_count): earliest, latest and summed over both."""
    b = batch.select("id", *[F.col(c).alias(f"_{c}") for c in ("first_seen", "last_seen", "source_count")])
    both = stored.join(b, "id", "full_outer")
    count = F.coalesce("source_count", F.lit(0)) + F.coalesce("_source_count", F.lit(0))
    return both.select("id", F.least("first_seen", "_first_seen").alias("first_seen"), F.greatest("last_seen", "_last_seen").alias("last_seen"), count.alias("source_count"))


def upsert_guarded(stored: DataFrame, batch: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Rows of both, per key the one of the highest version; at a tie the batch's wins."""
    both = stored.withColumn("_from", F.lit(0)).unionByName(batch.withColumn("_from", F.lit(1)))
    order = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_from"))
    return both.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_from")


def upsert_last(stored: DataFrame, batch: DataFrame, key: str, fixed: Sequence[str]) -> DataFrame:
    """Rows of both by key: the batch's values, but stored values of ``fixed`` columns stay."""
    renamed = batch.select(*[F.col(c).alias(c if c == key else f"_{c}") for c in batch.columns])
    both = stored.join(renamed, key, "full_outer")
    pick = lambda c: F.coalesce(c, f"_{c}") if c in fixed else F.coalesce(f"_{c}", c)
    return both.select(key, *[pick(c).alias(c) for c in stored.columns if c != key])


def delete_keys(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def edge_key(kind: Column, src: Column, dst: Column, valid_from: Column, evidence: Column, symmetric: Sequence[str] = ()) -> Column:
    """32 hex digits of an edge's kind, ends, start and evidence; edges of the ``symmetric`` kinds have one direction, the smaller id first."""
    turned = kind.isin(*symmetric) & (dst < src) if symmetric else F.lit(False)
    start = F.concat(F.date_format(valid_from, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return F.substring(F.sha2(F.concat_ws("\x1f", kind, F.when(turned, dst).otherwise(src), F.when(turned, src).otherwise(dst), start, F.coalesce(evidence, F.lit(""))), 256), 1, 32)


def upsert_edges(stored: DataFrame, batch: DataFrame, batch_id: str) -> DataFrame:
    """(edge_key, evidence_count, confidence, valid_from, observed_at, last_batch_id) after one batch.

    ``batch``: edge_key, new_evidence, confidence, valid_from, observed_at.  Its
    evidence adds up, but not on edges that were last written by this very batch;
    its confidence and observation win; an edge's start stays.
    """
    one = batch.groupBy("edge_key").agg(F.sum("new_evidence").alias("_new"), F.max_by("confidence", "observed_at").alias("_confidence"), F.min("valid_from").alias("_from"), F.max("observed_at").alias("_seen"))
    both = stored.join(one, "edge_key", "full_outer")
    again = F.coalesce(F.col("last_batch_id") == batch_id, F.lit(False))
    count = F.coalesce("evidence_count", F.lit(0)) + F.when(again, 0).otherwise(F.coalesce("_new", F.lit(0)))
    written = F.when(F.col("_seen").isNotNull(), F.lit(batch_id)).otherwise(F.col("last_batch_id"))
    return both.select("edge_key", count.cast("long").alias("evidence_count"), F.coalesce("_confidence", "confidence").alias("confidence"), F.coalesce("valid_from", "_from").alias("valid_from"), F.coalesce("_seen", "observed_at").alias("observed_at"), written.alias("last_batch_id"))
