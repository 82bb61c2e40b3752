"""Connected components over an edge table, as joins and groupings.

Each round hooks every node to its smallest smaller neighbour, flattens the
resulting forest by pointer jumping and replaces both ends of every edge by
their roots.  Only local minima survive a round, so few rounds are needed.
A first pass contracts each partition's edges with a small union-find, which
shortens chains; it holds one partition's edges and nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import store, tidy


def local_forest(u, v) -> dict[int, int]:
    """Smallest reachable node for every node of the edges (u, v)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in zip(u, v):
        root.setdefault(a, a)
        root.setdefault(b, b)
        a, b = find(a), find(b)
        if a < b:
            root[b] = a
        elif b < a:
            root[a] = b
    return {x: find(x) for x in root}


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [p for p in parts if len(p)]
    if not frames:
        return
    edges = pd.concat(frames)
    roots = local_forest(edges["u"].tolist(), edges["v"].tolist())
    pairs = [(x, r) for x, r in roots.items() if x != r]
    if pairs:
        yield pd.DataFrame(pairs, columns=["u", "v"])


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping on (id, root) with root < id until every root is final."""
    while True:
        up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
        jumped = store(parent.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jump")
        moved = not jumped.filter("moved").isEmpty()
        parent = jumped.select("id", "root")
        if not moved:
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (long columns u, v): the smallest node it reaches.

    Self-loops and repeated edges are ignored; nodes that only have self-loops
    are not returned.  Null ends are dropped.  An empty table gives an empty one.
    """
    left = store(edges.filter("u is not null and v is not null and u != v").mapInPandas(tidy(_contract), "u long, v long"), "edges")
    mapping: DataFrame | None = None
    while not left.isEmpty():
        parent = _flatten(left.groupBy(F.greatest("u", "v").alias("id")).agg(F.min(F.least("u", "v")).alias("root")))
        if mapping is None:
            known = left.select(F.explode(F.array("u", "v")).alias("id")).distinct()
            mapping = known.join(parent, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
        else:
            mapping = mapping.join(parent.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        mapping = store(mapping, "labels")
        up, vp = (parent.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in ("u", "v"))
        moved = left.join(up, "u", "left").join(vp, "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
        left = store(moved.filter("u != v").distinct(), "edges")
    if mapping is None:
        return left.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return mapping
