"""Bitemporal facts: merging, closing, lateness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Half-open intervals of a key that touch or overlap, merged; an absent end stays open."""
    far = F.expr("timestamp_ntz'9999-12-31'")
    order = Window.partitionBy(*key).orderBy("valid_from", "_end")
    closed = rows.withColumn("_end", F.coalesce("valid_to", far))
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = closed.withColumn("_new", F.when(F.col("valid_from") <= reach, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy(*key, "_group").agg(F.min("valid_from").alias("valid_from"), F.max("_end").alias("_end"), F.count("*").alias("assertions"))
    return merged.select(*key, "valid_from", F.when(F.col("_end") < far, F.col("_end")).alias("valid_to"), "assertions")


def close(valid_to: Column, at: Column) -> Column:
    """An interval's end after closing it at a moment; nothing is deleted."""
    return F.least(F.coalesce(valid_to, at), at)


def is_late(observed_at: Column, valid_to: Column) -> Column:
    """Observed after its validity had ended."""
    return F.coalesce(observed_at > valid_to, F.lit(False))
