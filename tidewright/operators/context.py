"""Evidence of one query: near-duplicates collapsed in rank order, passages and facts fitted to a budget.

Both walk a query's rows in order, since every choice depends on those before
it, so they run once a query on the rows that ranking has left of it: callers
cut the pool by ``top_per_group`` first.  Budgets are filled by array functions on
the JVM, as most queries have few rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of the budget for facts and for passages; the rest is held in reserve.
FACT_SHARE, PASSAGE_SHARE = 0.15, 0.80


def collapse_near_duplicates(pool: DataFrame, distance: int = 3) -> DataFrame:
    """(query_id, chunk_id, rank, absorbed) of the rows (query_id, chunk_id, rank, print) that stay.

    A row within ``distance`` bits of an earlier survivor of its query is absorbed
    by the first such one; rows without a print (null) stay and absorb nothing.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "chunk_id"], ignore_index=True)
        prints = np.array([int(p) if known == 1 else 0 for p, known in zip(rows["print"], rows["known"])], np.int64).view(np.uint64)
        kept, absorbed, holders = [], [], []
        for i, known in enumerate(rows["known"]):
            near = np.flatnonzero(np.bitwise_count(prints[[kept[h] for h in holders]] ^ prints[i]) <= distance) if known and holders else ()
            if len(near):
                absorbed[holders[near[0]]] += 1
                continue
            if known:
                holders.append(len(kept))
            kept.append(i)
            absorbed.append(0)
        return rows.loc[kept, ["query_id", "chunk_id", "rank"]].assign(absorbed=absorbed)

    known = F.col("print").isNotNull()
    rows = pool.select("query_id", "chunk_id", "rank", F.coalesce("print", F.lit(0)).cast("long").alias("print"), known.cast("int").alias("known"))
    return rows.groupBy("query_id").applyInPandas(walk, "query_id long, chunk_id long, rank long, absorbed long")


def fill(costs: list[int], limit: int, groups: list | None = None) -> tuple[list[int], int]:
    """Places, in order, of what fits one after another, and the cost left: with groups, one of each before any second."""
    kept, met, left = set(), set(), limit
    for breadth in (True, False) if groups is not None else (False,):
        for i, cost in enumerate(costs):
            if i in kept or cost > left or (breadth and groups[i] in met):
                continue
            kept.add(i)
            left -= cost
            if breadth:
                met.add(groups[i])
    return sorted(kept), left


def pack_evidence(passages: DataFrame, facts: DataFrame, budget: int) -> DataFrame:
    """(query_id, kind, id, cost) of what fits the token budget of every query.

    ``passages``: query_id, id, signal, score, cost; ``facts``: query_id, id,
    score, current, cost.  Facts go first, by score, current ones before ended; what they
    leave goes to the passages.  One that is too long is passed over, not the end.
    """
    both = passages.select("query_id", F.lit("passage").alias("kind"), "id", "signal", F.col("score").cast("double").alias("score"), F.lit(True).alias("current"), "cost").unionByName(
        facts.select("query_id", F.lit("fact").alias("kind"), "id", F.lit(0).cast("long").alias("signal"), F.col("score").cast("double").alias("score"), "current", "cost"))
    listed = both.groupBy("query_id").agg(*[_in_order(F.col("kind") == kind, F.col("current")).alias(kind) for kind in ("fact", "passage")])
    told = listed.withColumn("facts", filled(F.col("fact"), F.lit(int(budget * FACT_SHARE)), False))
    packed = told.withColumn("passages", filled(F.col("passage"), F.lit(int(budget * PASSAGE_SHARE)) + F.col("facts.left"), True))
    marked = [F.transform(F.col(f"{kind}s.kept"), lambda x: F.struct(F.lit(kind).alias("kind"), x["id"].alias("id"), x["cost"].alias("cost"))) for kind in ("fact", "passage")]  # noqa: B023
    return packed.select("query_id", F.explode(F.concat(*marked)).alias("x")).select("query_id", "x.*")


def _in_order(which: Column, current: Column) -> Column:
    """The rows ``which`` of a group as one array by score, current ones before others, then id; no score comes last."""
    known = F.col("score").isNotNull() & ~F.isnan("score")
    order = [(~known).alias("last"), F.when(known, -F.col("score")).alias("by"), (~current).alias("ended")]
    return F.array_sort(F.collect_list(F.when(which, F.struct(*order, F.col("id").cast("long").alias("id"), F.col("signal").cast("long").alias("signal"), F.col("cost").cast("long").alias("cost")))))


def filled(items: Column, limit: Column, breadth: bool) -> Column:
    """(kept, left) of an array of structs with signal and cost, as :func:`fill` has it."""
    numbered = F.transform(items, lambda x, i: F.struct(i.alias("at"), x["id"].alias("id"), x["signal"].alias("signal"), x["cost"].alias("cost")))
    none = lambda xs: F.filter(xs, lambda _: F.lit(False))

    def walk(xs: Column, kept: Column, left: Column, once: bool) -> Column:
        start = F.struct(kept.alias("kept"), left.cast("long").alias("left"))

        def step(acc: Column, x: Column) -> Column:
            fits = x["cost"] <= acc["left"]
            if once:
                fits &= ~F.exists(acc["kept"], lambda y: F.coalesce(y["signal"] == x["signal"], F.lit(False)))
            return F.when(fits, F.struct(F.array_append(acc["kept"], x).alias("kept"), (acc["left"] - x["cost"]).alias("left"))).otherwise(acc)

        return F.aggregate(xs, start, step)

    if not breadth:
        return walk(numbered, none(numbered), limit, False)
    first = walk(numbered, none(numbered), limit, True)
    # One array element carries the first pass, so that it is made once for the second.
    both = F.transform(F.array(first), lambda f: walk(F.filter(numbered, lambda x: ~F.exists(f["kept"], lambda y: y["at"] == x["at"])), f["kept"], f["left"], False))
    return both[0]


def fill_rows(rows: DataFrame, budget: int, breadth: bool) -> DataFrame:
    """(query_id, id, cost) of the rows (query_id, id, signal, score, cost) that fit the budget, by score.

    With ``breadth`` one row of each signal goes before any second.
    """

    listed = rows.groupBy("query_id").agg(_in_order(F.lit(True), F.lit(True)).alias("items"))
    return listed.select("query_id", F.explode(filled(F.col("items"), F.lit(budget), breadth)["kept"]).alias("x")).select("query_id", "x.id", "x.cost")
