"""Graph operators over edge tables (src, dst, weight)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster shares.  Without one there is no table that all executors see: an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        # One machine, as in tests: its own folder is shared by all.
        base = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder of the session and read back: cuts the lineage of a loop."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def project(edges: DataFrame) -> DataFrame:
    """Undirected projection of (src, dst, confidence, evidence): both directions, parallel edges summed, loops dropped."""
    weight = F.coalesce("confidence", F.lit(0.5)) * F.log1p(F.col("evidence"))
    single = edges.filter("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(weight).alias("weight"))
    return single.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(single.select("b", "a", "weight"))


def degree_centrality(nodes: DataFrame, both_ways: DataFrame) -> DataFrame:
    """Neighbours over the number of other nodes; isolated nodes have 0."""
    others = nodes.agg((F.count("*") - 1).alias("others"))
    degree = both_ways.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(degree, "node", "left").crossJoin(F.broadcast(others)).select("node", (F.coalesce("degree", F.lit(0)) / F.col("others")).alias("centrality"))


def pagerank(nodes: DataFrame, both_ways: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = None, teleport: DataFrame | None = None) -> DataFrame:
    """Weighted PageRank; stops at ``rounds`` or at the L1 tolerance.

    The walk restarts, and leaves nodes without edges, evenly or by the positive
    weights of ``teleport`` (node, weight); none on any node is an error.

    Edges are normalised once; each round is one join and one grouping on the
    node, written to the shared folder so that the plan stays short.
    """
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    if teleport is None:
        starts = nodes.select("node", F.lit(1.0 / n).alias("start"))
    else:
        wanted = nodes.join(teleport.filter("weight > 0").groupBy("node").agg(F.sum("weight").alias("weight")), "node")
        total = wanted.agg(F.sum("weight")).first()[0]
        if not total:
            raise ValueError("no positive weight on any node: the walk has nowhere to restart")
        starts = nodes.join(wanted, "node", "left").select("node", (F.coalesce("weight", F.lit(0.0)) / total).alias("start"))
    out = both_ways.groupBy("src").agg(F.sum("weight").alias("total"))
    moves = shared_table(both_ways.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "moves")
    state = shared_table(starts.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", "start", F.col("total").isNull().alias("sink"), F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(rounds):
        loose = state.filter("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        sent = moves.join(state, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = (1 - damping) * F.col("start") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("start"))
        stepped = state.join(sent, F.col("node") == F.col("to"), "left").crossJoin(F.broadcast(loose)).select("node", "start", "sink", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        stepped = shared_table(stepped, "ranks")
        state = stepped.drop("change")
        if tolerance is not None and stepped.agg(F.sum("change").alias("c")).first()["c"] < tolerance:
            break
    return state.select("node", "rank")


def neighbourhood(seeds: DataFrame, both_ways: DataFrame, hops: int, fanout: int) -> DataFrame:
    """(node, hop, score) reached from one set of seeds (node) over weights as confidences."""
    from tidewright.operators.traversal import path_scores

    open_ = F.lit(None).cast("timestamp")
    edges = both_ways.select("src", "dst", F.col("weight").alias("confidence"), open_.alias("valid_from"), open_.alias("valid_to"))
    return path_scores(seeds.withColumn("query_id", F.lit(0)), edges, hops, fanout).select("node", "hop", "score")


def modularity(both_ways: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of a membership (node, community), one row."""
    m = both_ways.agg((F.sum("weight") / 2).alias("m"))
    tag = lambda c: membership.select(F.col("node").alias(c), F.col("community").alias(f"{c}_community"))
    tagged = both_ways.join(tag("src"), "src").join(tag("dst"), "dst")
    inside = tagged.groupBy(F.col("src_community").alias("community")).agg(F.sum(F.when(F.col("src_community") == F.col("dst_community"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("degree"))
    return inside.crossJoin(F.broadcast(m)).agg(F.sum(F.col("inside") / (2 * F.col("m")) - resolution * F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def conductance(both_ways: DataFrame, membership: DataFrame, smallest: int = 3) -> DataFrame:
    """community, size, internal and external weight, conductance of communities with at least ``smallest`` members."""
    tag = lambda c: membership.select(F.col("node").alias(c), F.col("community").alias(f"{c}_community"))
    tagged = both_ways.join(tag("src"), "src").join(tag("dst"), "dst")
    same = F.col("src_community") == F.col("dst_community")
    weights = tagged.groupBy(F.col("src_community").alias("community")).agg((F.sum(F.when(same, F.col("weight")).otherwise(0.0)) / 2).alias("internal"), F.sum(F.when(~same, F.col("weight")).otherwise(0.0)).alias("external"))
    sizes = membership.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= smallest)
    total = 2 * F.col("internal") + F.col("external")
    return sizes.join(weights, "community").withColumn("conductance", F.when(total > 0, F.col("external") / total).otherwise(0.0))
