"""Walks over edge tables for many seeds at once: path scores over hops, and sampled betweenness.

State is keyed by (query or source, node) and stored after each step, so plans stay
short, no node's neighbours are gathered in one place and no graph is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.graph import shared_table
from tidewright.operators.ranking import top_per_group

# Loss a hop, confidence of an edge without one, edges of a parent, nodes of a result, nodes from which sources are sampled.
DECAY, CONFIDENCE, FANOUT, NODES, SOURCES = 0.6, 0.5, 25, 1000, 2000


def path_scores(seeds: DataFrame, edges: DataFrame, hops: int, fanout: int = FANOUT, most: int = NODES, floor: float = 0.0, as_of=None) -> DataFrame:
    """query_id, node, hop, score of the nodes around the seeds (query_id, node) of each query.

    ``edges``: src, dst, confidence, valid_from, valid_to (null: open), in both
    directions if they are to be walked so.  A seed has score 1 and hop 0.  In hop h
    every node found in the hop before gives each of its ``fanout`` surest neighbours
    its score times the edge's confidence times DECAY**h.  Scores add over paths,
    also for nodes that were found before; the first hop stays.  What a parent gives
    is its score at the start of the hop, whatever it gains in it.  In the end the
    ``most`` best nodes of a query stay.
    """
    sure = edges.withColumn("confidence", F.coalesce("confidence", F.lit(CONFIDENCE))).filter((F.col("confidence") >= floor) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    if as_of is not None:
        sure = sure.filter((F.coalesce("valid_from", as_of) <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of)))
    single = sure.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    capped = shared_table(top_per_group(single, ["src"], [F.desc("confidence"), F.col("dst")], fanout).drop("rn"), "capped-edges")
    state = shared_table(seeds.select("query_id", "node").distinct().withColumns({"hop": F.lit(0), "score": F.lit(1.0)}), "reached")
    for hop in range(1, hops + 1):
        front = state.filter(F.col("hop") == hop - 1)
        given = front.join(capped, F.col("node") == F.col("src")).groupBy("query_id", F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("confidence")).alias("given"))
        gain = given.withColumn("given", F.col("given") * DECAY**hop)
        merged = state.join(gain, ["query_id", "node"], "full_outer").select("query_id", "node", F.coalesce("hop", F.lit(hop)).alias("hop"), (F.coalesce("score", F.lit(0.0)) + F.coalesce("given", F.lit(0.0))).alias("score"))
        state = shared_table(merged, "reached")
        if state.filter(F.col("hop") == hop).isEmpty():
            break
    # Sums that differ in their last digits alone are equal.
    return top_per_group(state, ["query_id"], [F.desc(F.round("score", 9)), F.col("node")], most).drop("rn")


def signals_around(reached: DataFrame, mentions: DataFrame) -> DataFrame:
    """query_id, signal, score: the sum over a query's nodes of path score times the salience of their mentions (node, signal, salience)."""
    return reached.join(mentions, "node").groupBy("query_id", "signal").agg(F.sum(F.col("score") * F.col("salience")).alias("score"))


def numbered(rows: DataFrame, by: str, name: str = "number") -> DataFrame:
    """``rows`` with their place in the order of ``by`` from 0; partitions are counted, none is gathered."""
    ranged = shared_table(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright(F.col("_at"), 33)
    before, total = {}, 0
    for r in ranged.groupBy(part.alias("part")).count().sort("part").collect():  # one row a partition
        before[r["part"]] = total
        total += r["count"]
    if not before:
        return rows.withColumn(name, F.lit(0).cast("long")).limit(0)
    base = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[part]
    return ranged.withColumn(name, base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def betweenness(nodes: DataFrame, both_ways: DataFrame, sample: int | None = None, normalized: bool = True) -> DataFrame:
    """node, centrality: the share of shortest paths between other nodes that pass through each, edges counted as one.

    ``nodes``: node; ``both_ways``: src, dst in both directions.  Searches start
    from all nodes, or from ``sample`` (SOURCES by default beyond so many nodes) at
    even strides of their order, and what they find is scaled up.  All searches go
    level by level together; each level holds the number of shortest paths to its
    nodes, and the dependencies are summed back from the last level to the first.
    """
    ids = shared_table(numbered(nodes.select("node").distinct(), "node"), "numbered")
    n = ids.count()
    if n < 3:
        return ids.select("node", F.lit(0.0).alias("centrality"))
    size = max(1, min(n, SOURCES if sample is None else sample))
    if size < n:
        stride = n / size
        # A node is a source where a multiple of the stride falls into its place.
        turn = F.ceil(F.col("number") / stride)
        ids_from = ids.filter((turn < size) & (F.floor(turn * stride) == F.col("number")))
    else:
        ids_from = ids
    edges = shared_table(both_ways.filter("src != dst").select("src", "dst").distinct(), "walked-edges")
    level = shared_table(ids_from.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "level")
    levels, seen = [level], level.select("source", "node")
    while True:
        found = level.join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        # Neighbours lie one level before, beside or behind: those two are all there is to leave out.
        level = shared_table(found.join(seen, ["source", "node"], "left_anti"), "level")
        if level.isEmpty():
            break
        seen = levels[-1].select("source", "node").unionByName(level.select("source", "node"))
        levels.append(level)
    total, depends = None, None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("depends", F.lit(0.0)) if depends is None else levels[k].join(depends, ["source", "node"], "left").withColumn("depends", F.coalesce("depends", F.lit(0.0)))
        here = shared_table(here, "dependencies")
        total = here.select("node", "depends") if total is None else total.unionByName(here.select("node", "depends"))
        back = here.select("source", F.col("node").alias("dst"), ((1 + F.col("depends")) / F.col("paths")).alias("part")).join(edges, "dst")
        depends = back.select("source", F.col("src").alias("node"), "part").join(levels[k - 1], ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("paths") * F.col("part")).alias("depends"))
    scale = 0.5 * (n / size) / ((n - 1) * (n - 2) / 2 if normalized else 1)
    if total is None:
        return ids.select("node", F.lit(0.0).alias("centrality"))
    summed = total.groupBy("node").agg(F.sum("depends").alias("s"))
    return ids.join(summed, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) * scale).alias("centrality"))
