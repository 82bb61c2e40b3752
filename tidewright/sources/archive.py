"""Content-addressed archive of raw payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.graph import shared_folder


def write_archive(payloads: DataFrame, path: str | None = None) -> str:
    """Write (platform, item, raw) with the digest of every payload, by platform, and return the path."""
    if path is None:
        path = shared_folder(payloads.sparkSession, "archive")
    payloads.withColumn("sha256", F.sha2("raw", 256)).write.partitionBy("platform").option("compression", "zstd").parquet(path)
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's rows with ``intact``: whether the payload still has its digest."""
    rows = spark.read.schema("item string, raw binary, sha256 string, platform string").parquet(path)
    return rows.withColumn("intact", F.sha2("raw", 256) == F.col("sha256"))


def compression_of(raw):
    """Codec by the first bytes: gzip, zstd or none."""
    head = F.hex(F.substring(raw, 1, 4))
    return F.when(head.startswith("1F8B"), "gzip").when(head == "28B52FFD", "zstd").otherwise("none")
