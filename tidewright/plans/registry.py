"""All queries of the library, by name, with the DuckDB SQL of each where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for module in ("filters", "joins", "aggregates", "ranking", "paging", "graphs", "texts", "scalars", "resolution", "search", "records", "further", "signatures", "markup", "exchange", "evidence", "structures", "entities", "streams", "walks", "trees", "writes"):
        import_module(f"tidewright.plans.{module}")
