"""Graph-shaped relations: projections, centrality, traversal, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.graph import conductance, degree_centrality, modularity, pagerank, project
from tidewright.operators.ranking import least_values
from tidewright.plans.registry import query, table


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to nation trade: customer's nation to supplier's nation, with evidence."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    seller = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    joined = lines.join(orders, "l_orderkey").join(buyer, "c_custkey").join(seller, "l_suppkey")
    return joined.groupBy("src", "dst").agg(F.avg("l_discount").alias("confidence"), F.count("*").alias("evidence"))


TRADE = """trade as (select c_nationkey src, s_nationkey dst, avg(l_discount) confidence, count(*) evidence from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by 1, 2),
one as (select least(src, dst) a, greatest(src, dst) b, sum(coalesce(confidence, 0.5) * ln(1 + evidence)) weight from trade where src <> dst group by 1, 2),
edges as (select a src, b dst, weight from one union all select b, a, weight from one)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


@query(f"with {TRADE} select src, dst, round(weight, 6) as weight from edges")
def g09_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(trade(spark, sf_dir)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""with recursive {TRADE}, o as (select src, sum(weight) total from edges group by 1), w as (select e.src, e.dst, e.weight / o.total share from edges e join o on o.src = e.src),
r(i, node, rank) as (select 0, n_nationkey, 1.0::double / (select count(*) from nation) from nation union all (select r.i + 1, n.n_nationkey, 0.15::double / (select count(*) from nation) + 0.85 * (sum(case when w.dst = n.n_nationkey then r.rank * w.share else 0 end) ) from r join w on w.src = r.node join nation n on true where r.i < 20 group by 1, 2))
select node, round(rank, 8) as rank from r where i = 20""")
def g10_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(nodes(spark, sf_dir), project(trade(spark, sf_dir)), rounds=20).select("node", F.round("rank", 8).alias("rank"))


@query(f"with {TRADE} select n_nationkey as node, round(coalesce(d, 0) / (select count(*) - 1 from nation), 8) as centrality from nation left join (select src, count(*) d from edges group by 1) on src = n_nationkey")
def g11_degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degree_centrality(nodes(spark, sf_dir), project(trade(spark, sf_dir))).select("node", F.round("centrality", 8).alias("centrality"))


@query(f"""with {TRADE}, m as (select sum(weight) / 2 m from edges), t as (select s.n_regionkey sc, d.n_regionkey dc, weight from edges join nation s on s.n_nationkey = src join nation d on d.n_nationkey = dst), c as (select sc, sum(case when sc = dc then weight else 0 end) i, sum(weight) d from t group by 1) select round(sum(i / (2 * m) - pow(d / (2 * m), 2)), 8) as modularity from c, m""")
def g14_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return modularity(project(trade(spark, sf_dir)), member).select(F.round("modularity", 8).alias("modularity"))


@query(f"""with {TRADE}, t as (select s.n_regionkey sc, d.n_regionkey dc, weight from edges join nation s on s.n_nationkey = src join nation d on d.n_nationkey = dst), c as (select sc, sum(case when sc = dc then weight else 0 end) / 2 i, sum(case when sc <> dc then weight else 0 end) e from t group by 1), z as (select n_regionkey, count(*) size from nation group by 1 having count(*) >= 3) select n_regionkey as community, size, round(i, 6) as internal, round(e, 6) as external, round(e / (2 * i + e), 8) as conductance from z join c on sc = n_regionkey""")
def g16_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    out = conductance(project(trade(spark, sf_dir)), member)
    return out.select("community", "size", F.round("internal", 6).alias("internal"), F.round("external", 6).alias("external"), F.round("conductance", 8).alias("conductance"))


@query("""select n_regionkey as community, 'com_' || substr(sha256(array_to_string(list_sort(list(n_nationkey::varchar)), ',')), 1, 24) as community_id from nation group by 1""")
def g17_community_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.array_join(F.array_sort(F.collect_set(F.col("n_nationkey").cast("string"))), ",")
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("community")).agg(F.concat(F.lit("com_"), F.substring(F.sha2(members, 256), 1, 24)).alias("community_id"))


@query("""select n_nationkey, n_name from nation where n_nationkey = 7""")
def g20_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_nationkey = 7").select("n_nationkey", "n_name")


@query("""select l_orderkey, l_linenumber from lineitem where l_partkey = 11 order by l_shipdate desc, l_orderkey, l_linenumber limit 20""")
def g21_signals_mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_partkey = 11").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber")


@query(f"""with {TRADE}, c as (select src, dst from edges where weight > (select avg(weight) from edges)), h1 as (select dst node from c where src = 0), f as (select 0 node union select node from h1) select distinct least(c.src, c.dst) as a, greatest(c.src, c.dst) as b from c where c.src in (select node from f)""")
def g22_entity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within two hops of one node, each once."""
    both = project(trade(spark, sf_dir))
    strong = both.crossJoin(F.broadcast(both.agg(F.avg("weight").alias("mean")))).filter("weight > mean").select("src", "dst")
    near = strong.filter("src = 0").select(F.col("dst").alias("src")).union(spark.range(1).select(F.lit(0).alias("src"))).distinct()
    return strong.join(near, "src", "left_semi").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@query(f"""with {TRADE}, c as (select src, dst, weight from edges qualify row_number() over (partition by src order by weight desc, dst) <= 4), p1 as (select dst, weight conf, 1 hops from c where src = 0), p2 as (select c.dst, p1.conf * c.weight conf, 2 hops from p1 join c on c.src = p1.dst where c.dst <> 0), p as (select * from p1 union all select * from p2), best as (select dst, min(hops) h from p group by 1)
select p.dst as node, h as hops, count(*) as paths, round(max(conf), 6) as confidence from p join best on best.dst = p.dst and hops = h group by 1, 2""")
def g23_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.ranking import top_per_group

    capped = top_per_group(project(trade(spark, sf_dir)), ["src"], [F.desc("weight"), F.col("dst")], 4).select("src", "dst", "weight")
    one = capped.filter("src = 0").select(F.col("dst").alias("node"), F.col("weight").alias("conf"), F.lit(1).alias("hops"))
    two = one.join(capped, F.col("node") == F.col("src")).filter("dst != 0").select(F.col("dst").alias("node"), (F.col("conf") * F.col("weight")).alias("conf"), F.lit(2).alias("hops"))
    per = one.unionByName(two).groupBy("node", "hops").agg(F.count("*").alias("paths"), F.round(F.max("conf"), 6).alias("confidence"))
    return per.groupBy("node").agg(F.min(F.struct("hops", "paths", "confidence")).alias("m")).select("node", "m.hops", "m.paths", "m.confidence")


@query("""select c_custkey from customer where c_acctbal < 500 order by nullif(c_acctbal, 0) nulls first, c_custkey limit 20""")
def g25_stale_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal < 500").orderBy(F.nullif(F.col("c_acctbal"), F.lit(0)).asc_nulls_first(), "c_custkey").limit(20).select("c_custkey")


@query("""select l_suppkey, array_to_string(list_slice(list_sort(list_distinct(list(l_partkey))), 1, 100), ',') as parts from lineitem group by 1""")
def g02_capped_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = least_values(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 100)
    return capped.select("l_suppkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("parts"))


@query("""with old as (select user_id id, min(ts) f, max(ts) l, count(*) n from events where ts < timestamp '2024-01-15' group by 1), new as (select user_id id, min(ts) f, max(ts) l, count(*) n from events where ts >= timestamp '2024-01-15' group by 1) select coalesce(o.id, n.id) as id, least(o.f, n.f) as first_seen, greatest(o.l, n.l) as last_seen, coalesce(o.n, 0) + coalesce(n.n, 0) as source_count from old o full join new n on o.id = n.id""")
def g03_node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.merge import upsert_nodes

    state = lambda df: df.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("source_count"))
    events = table(spark, sf_dir, "events")
    return upsert_nodes(state(events.filter("ts < timestamp_ntz'2024-01-15'")), state(events.filter("ts >= timestamp_ntz'2024-01-15'")))


@query("""select l_partkey, sum(l_quantity) as total, max(l_shipdate) as observed, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') as flags, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) as last_supplier from lineitem group by 1""")
def g06_row_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("total"), F.max("l_shipdate").alias("observed"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags"), last.alias("last_supplier"))


@query("""select o_custkey, o_orderkey // 500 as batch, sha256(array_to_string(list_sort(list(distinct o_orderkey::varchar)), chr(30))) as batch_id from orders group by 1, 2""")
def g07_batch_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every batch of a customer's orders; a batch spans 500 keys, so no group holds more."""
    ids = F.array_join(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))), "\x1e")
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.expr("o_orderkey div 500").alias("batch")).agg(F.sha2(ids, 256).alias("batch_id"))


@query("""select distinct l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)""")
def g08_missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().join(known, "l_suppkey", "left_anti")


@query("""select l_orderkey, l_linenumber from lineitem join orders on o_orderkey = l_orderkey where l_shipdate <= o_orderdate""")
def y35_inverted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.filter("l_shipdate <= o_orderdate").select("l_orderkey", "l_linenumber")


@query("""select n_nationkey as node, 'r' || n_regionkey as community from nation""")
def y29_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "nation").groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("community")).agg(F.collect_set("n_nationkey").alias("members"))
    return groups.select(F.explode("members").alias("node"), "community")
