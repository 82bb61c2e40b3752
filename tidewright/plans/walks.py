"""Walks over the graph of customers and the parts they order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.graph import project
from tidewright.operators.traversal import betweenness, path_scores, signals_around
from tidewright.plans.graphs import nodes, trade
from tidewright.plans.registry import query, table

HOPS, FANOUT, MOST, SINCE = 2, 4, 12, "2000-06-01"

_EDGES = f"""l as (select o_custkey c, -1 - l_partkey p, round(avg(l_discount) * 9, 6) as confidence, min(l_shipdate) as valid_from from lineitem join orders on o_orderkey = l_orderkey group by 1, 2), both_ways as (select c src, p dst, confidence, valid_from from l union all select p, c, confidence, valid_from from l),
cap as (select src, dst, confidence from both_ways where valid_from <= timestamp '{SINCE}' and confidence >= 0.1 qualify row_number() over (partition by src order by confidence desc, dst) <= {FANOUT}),
h0 as (select c_custkey as query_id, c_custkey as node from customer where c_custkey % 20 = 0), g1 as (select query_id, dst node, sum(confidence) * 0.6 g from h0 join cap on src = node group by 1, 2),
s1 as (select query_id, node, case when h0.node is null then 1 else 0 end as hop, case when h0.node is null then 0.0 else 1.0 end + coalesce(g, 0) as score from h0 full outer join g1 using (query_id, node)),
g2 as (select query_id, dst node, sum(score * confidence) * 0.36 g from s1 join cap on src = node where hop = 1 group by 1, 2),
s2 as (select query_id, node, coalesce(hop, 2) as hop, coalesce(score, 0) + coalesce(g, 0) as score from s1 full outer join g2 using (query_id, node)),
best as (select * from s2 qualify row_number() over (partition by query_id order by round(score, 9) desc, node) <= {MOST})"""
# SQL tells the first hop's seeds from new nodes by a flag, as a full join coalesces its keys.
_EDGES = _EDGES.replace("h0 as (select c_custkey as query_id, c_custkey as node from", "h0 as (select c_custkey as query_id, c_custkey as node, true as seed from").replace("case when h0.node is null then 1 else 0 end", "case when seed then 0 else 1 end").replace("case when h0.node is null then 0.0 else 1.0 end", "case when seed then 1.0::double else 0.0::double end")


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between customers and parts (as negative numbers), valid from the first shipment on."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c"))
    lines = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").groupBy("c", (-1 - F.col("l_partkey")).alias("p")).agg(F.round(F.avg("l_discount") * 9, 6).alias("confidence"), F.min("l_shipdate").alias("valid_from"))
    one = lines.select(F.col("c").alias("src"), F.col("p").alias("dst"), "confidence", "valid_from")
    return one.unionByName(lines.select(F.col("p").alias("src"), F.col("c").alias("dst"), "confidence", "valid_from")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))


def reached(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("node"))
    return path_scores(seeds, bought(spark, sf_dir), HOPS, FANOUT, most, 0.1, F.lit(SINCE).cast("timestamp_ntz"))


@query(f"with {_EDGES} select query_id, node, hop, round(score, 6) as score from s2")
def w04_path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over two hops from every twentieth customer: all paths add up, also at nodes that were found before."""
    return reached(spark, sf_dir, 1_000_000).withColumn("score", F.round("score", 6))


@query(f"with {_EDGES} select query_id, node, hop, round(score, 6) as score from best")
def g26_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best nodes around every twentieth customer."""
    return reached(spark, sf_dir, MOST).withColumn("score", F.round("score", 6))


@query(f"with {_EDGES} select distinct query_id, o_orderkey as signal from best join orders on o_custkey = node where o_orderdate >= timestamp '1997-01-01'")
def g18_neighbourhood_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders since 1997 of the customers in each neighbourhood."""
    recent = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01'").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("signal"), F.lit(1.0).alias("salience"))
    return signals_around(reached(spark, sf_dir, MOST), recent).select("query_id", "signal")


@query(f"with {_EDGES}, s as (select query_id, o_orderkey as signal, sum(score * o_totalprice / 500000) score from best join orders on o_custkey = node group by 1, 2) select query_id, signal, round(score, 5) as score from s qualify row_number() over (partition by query_id order by round(score, 7) desc, signal) <= 10")
def k08_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best orders around every twentieth customer, by path score times salience."""
    from tidewright.operators.ranking import top_per_group

    mentions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("signal"), (F.col("o_totalprice") / 500000).alias("salience"))
    scored = signals_around(reached(spark, sf_dir, MOST), mentions)
    return top_per_group(scored, ["query_id"], [F.desc(F.round("score", 7)), F.col("signal")], 10).select("query_id", "signal", F.round("score", 5).alias("score"))


@query()
def g12_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of nations in the graph of their stronger trade."""
    both = project(trade(spark, sf_dir))
    strong = both.crossJoin(F.broadcast(both.agg(F.avg("weight").alias("mean")))).filter("weight > mean")
    return betweenness(nodes(spark, sf_dir), strong).select("node", F.round("centrality", 9).alias("centrality"))
