"""Order, limit, keyset pages and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.text import token_estimate
from tidewright.operators.filters import keyset_after
from tidewright.operators.ranking import top_per_group
from tidewright.plans.registry import query, table


@query("""select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25""")
def t01_ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("""select o_orderkey, o_orderdate, o_totalprice from orders where (o_orderdate < timestamp '1998-06-01') or (o_orderdate = timestamp '1998-06-01' and o_totalprice < 200000.0) or (o_orderdate = timestamp '1998-06-01' and o_totalprice = 200000.0 and o_orderkey < 900) order by o_orderdate desc, o_totalprice desc, o_orderkey desc limit 51""")
def t02_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row more than the page, to tell whether there is a next one."""
    after = keyset_after([("o_orderdate", F.expr("timestamp_ntz'1998-06-01'")), ("o_totalprice", 200000.0), ("o_orderkey", 900)])
    return table(spark, sf_dir, "orders").filter(after).orderBy(F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")).limit(51).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""select c_custkey from customer where c_acctbal > 5000.0 or (c_acctbal = 5000.0 and c_custkey > 10) order by c_acctbal, c_custkey limit 20""")
def t03_keyset_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = keyset_after([("c_acctbal", 5000.0), ("c_custkey", 10)], descending=False)
    return table(spark, sf_dir, "customer").filter(after).orderBy("c_acctbal", "c_custkey").limit(20).select("c_custkey")


@query("""select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 10""")
def t05_top_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("""select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 25""")
def t06_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 25).select("p_brand", "p_partkey")


@query("""select doc_id, ceil(length(text) / 4)::bigint as tokens from documents""")
def t10_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("""with u as (select 3 severity, 'unreviewed' kind, o_orderpriority feature, count(*) n from orders where o_orderstatus = 'O' group by 3 union all select 2, 'stalled', o_orderpriority, count(*) from orders where o_orderdate < timestamp '1996-01-01' group by 3 union all select 1, 'failing', l_returnflag, count(*) from lineitem where l_quantity > 45 group by 3) select severity, kind, feature, n from u""")
def t13_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    part = lambda df, severity, kind, feature: df.groupBy(F.col(feature).alias("feature")).agg(F.count("*").alias("n")).select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), "feature", "n")
    found = part(orders.filter("o_orderstatus = 'O'"), 3, "unreviewed", "o_orderpriority").unionByName(part(orders.filter("o_orderdate < timestamp_ntz'1996-01-01'"), 2, "stalled", "o_orderpriority")).unionByName(part(lines.filter("l_quantity > 45"), 1, "failing", "l_returnflag"))
    return found.orderBy(F.desc("severity"), "feature")


@query("""select event_id, ts, (select count(*) from events where event_type = 'signup') - 40 as omitted from (select * from events where event_type = 'signup' order by ts desc, event_id desc limit 40) order by ts, event_id""")
def t14_recent_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    total = chosen.agg((F.count("*") - 40).alias("omitted"))
    return chosen.orderBy(F.desc("ts"), F.desc("event_id")).limit(40).crossJoin(F.broadcast(total)).orderBy("ts", "event_id").select("event_id", "ts", "omitted")


@query("""select conv_id, turn, role from conversations where turn > 1 order by conv_id, turn limit 100""")
def y08_timeline_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("turn > 1").orderBy("conv_id", "turn").limit(100).select("conv_id", "turn", "role")


@query("""select o_orderkey from orders where o_orderstatus in ('O', 'P') order by o_orderdate desc, o_orderkey desc limit 30""")
def y09_run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30).select("o_orderkey")


@query("""select conv_id, turn from (select conv_id, turn, sum(ceil(length(text) / 4)) over (partition by conv_id order by turn) used from conversations) where used <= 300""")
def y21_context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation that fit a token budget, stopping at the first that doesn't."""
    used = F.sum(token_estimate(F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").withColumn("used", used).filter("used <= 300").select("conv_id", "turn")


@query("""select source, doc_id from (select source, doc_id, sum(n_chars) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) used from documents) where used <= 20000""")
def y49_shrink_to_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.sum("n_chars").over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "documents").withColumn("used", used).filter("used <= 20000").select("source", "doc_id")


@query("""select user_id, event_id from events where value * pow(0.5, date_diff('day', ts, timestamp '2024-02-01') / 30.0) >= 25 and event_type in ('purchase', 'signup') qualify row_number() over (partition by user_id order by value * pow(0.5, date_diff('day', ts, timestamp '2024-02-01') / 30.0) desc, event_id) <= 3""")
def y19_memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions.scoring import half_life

    kept = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup")).withColumn("relevance", F.col("value") * half_life(F.datediff(F.lit("2024-02-01"), "ts"), 30.0)).filter("relevance >= 25")
    return top_per_group(kept, ["user_id"], [F.desc("relevance"), F.col("event_id")], 3).select("user_id", "event_id")


@query("""select event_id from events where value >= 50 and props is not null and user_id is not null""")
def y20_memory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value >= 50 and props is not null and user_id is not null").select("event_id")


@query("""select c_custkey from customer where c_acctbal < 0 order by c_acctbal, c_custkey limit 10""")
def r19_due_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal < 0").orderBy("c_acctbal", "c_custkey").limit(10).select("c_custkey")


@query("""select o_orderkey from orders where o_orderstatus = 'P' and o_orderdate < timestamp '2001-08-01' - interval 1800 day""")
def r20_timed_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderdate < timestamp_ntz'2001-08-01' - interval 1800 days").select("o_orderkey")


@query("""select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 50""")
def r12_embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").orderBy("doc_id").limit(50).select("doc_id")
