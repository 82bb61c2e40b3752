"""Streams: first sightings and totals kept by micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.streaming.workers import drain, file_stream, place


def first_sightings(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The event with the smallest id per key: every micro-batch stores its own, the least of these counts."""
    least = lambda rows: rows.groupBy(*keys).agg(F.min("event_id").alias("event_id"))
    return least(drain(file_stream(spark, path), {"first": least}, place(spark, "sightings"))["first"])


def drained_totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts and sums per event type, from the stored parts of all micro-batches; a batch that is replayed replaces its own part."""
    parts = drain(file_stream(spark, path), {"totals": lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("event_id").alias("first_event"))}, place(spark, "totals"))["totals"]
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first_event").alias("first_event"))
