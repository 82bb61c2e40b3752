"""Join shapes: counted left joins, best matches, ordered look-ups, blocking and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_counts(left: DataFrame, right: DataFrame, on: str, name: str) -> DataFrame:
    """``left`` with the number of its ``right`` rows, 0 where there is none; the right side is counted before the join."""
    return left.join(right.groupBy(on).agg(F.count("*").alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def best_match(candidates: DataFrame, key: str | Sequence[str], *order: Column) -> DataFrame:
    """The first candidate of every key by ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    return candidates.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def in_order(ids: DataFrame, rows: DataFrame, on: str, position: str) -> DataFrame:
    """Rows named by an id list, in the list's order; missing ids are left out."""
    return ids.join(rows, on).orderBy(position)


def block_pairs(records: DataFrame, id_: str, keys: Column, most: int | None = None, broad=None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of records that share a key.

    Blocks of more than ``most`` records are left out if ``broad`` (key to Column)
    says that their key is of a kind that anything fills (all, if it is not given),
    which the caller must want; :func:`block_sizes` reports their number.
    """
    exploded = records.select(F.col(id_).alias("id"), F.explode(F.array_distinct(keys)).alias("key"))
    if most is not None:
        loose = F.lit(True) if broad is None else broad(F.col("key"))
        large = exploded.filter(loose).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key")
        exploded = exploded.join(large, "key", "left_anti")
    left, right = exploded.select(F.col("id").alias("a"), "key"), exploded.select(F.col("id").alias("b"), "key")
    return left.join(right, "key").filter("a < b").select("a", "b").distinct()


def block_sizes(records: DataFrame, id_: str, keys: Column) -> DataFrame:
    return records.select(id_, F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def overlap_join(left: DataFrame, right: DataFrame, on: str, bin_days: int) -> DataFrame:
    """Pairs of half-open intervals (start, end) under one key that overlap.

    Both sides are put into the bins of days they touch and joined on key and
    bin; a pair counts in the later of the two first bins only.
    """
    bins = lambda df, p: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.datediff(f"{p}start", F.lit("1970-01-01")) / bin_days), F.floor(F.datediff(f"{p}end", F.lit("1970-01-01")) / bin_days))))
    first = lambda p: F.floor(F.datediff(f"{p}start", F.lit("1970-01-01")) / bin_days)
    both = bins(left, "l_").join(bins(right, "r_"), [on, "_bin"])
    return both.filter((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_bin") == F.greatest(first("l_"), first("r_")))).drop("_bin")
