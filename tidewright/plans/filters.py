"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.filters import Filters, as_of, compile_filters, contains_all, json_contains, overlaps
from tidewright.plans.registry import query, table


@query("""select doc_id, source, lang, n_chars from documents where source in ('src1','src2','src3') and lang in ('de','en') and n_chars >= 500""")
def f01_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = Filters(any_of={"source": ["src3", "src1", "src2"], "lang": ["en", "de"]}, at_least={"n_chars": 500})
    return table(spark, sf_dir, "documents").filter(compile_filters(chosen)).select("doc_id", "source", "lang", "n_chars")


@query("""select event_id, event_type, value from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20' and event_type in (select event_type from events group by 1 order by 1 limit 2)""")
def f02_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().orderBy("event_type").limit(2)
    inside = compile_filters(Filters(window=("ts", "2024-01-10", "2024-01-20")))
    return events.filter(inside).join(kinds, "event_type", "left_semi").select("event_id", "event_type", "value")


@query("""select d.doc_id, d.source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) and d.lang = 'en'""")
def f04_mention_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "labels").filter("quality = 1")
    return table(spark, sf_dir, "documents").filter("lang = 'en'").join(mentions, "doc_id", "left_semi").select("doc_id", "source")


@query("""with o as (select o_orderkey, list_distinct(list(l_returnflag)) flags from orders join lineitem on l_orderkey = o_orderkey group by 1) select o_orderkey from o where list_contains(flags,'A') and list_contains(flags,'R')""")
def f06_contains_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.filter(contains_all("flags", ["A", "R"])).select("o_orderkey")


@query("""with o as (select l_orderkey o_orderkey, list(l_shipdate) d, list(l_returnflag) f from lineitem group by 1) select o_orderkey, list_contains(f,'N') or list_contains(f,'R') as hit from o""")
def f06_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.select("o_orderkey", overlaps("flags", ["N", "R"]).alias("hit"))


@query("""select l_orderkey, count(*) filter (where l_linestatus = 'O' and l_quantity >= 40) > 0 as hit from lineitem group by 1""")
def f07_struct_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"))).alias("lines"))
    return lines.select("l_orderkey", json_contains("lines", lambda x: (x["status"] == "O") & (x["quantity"] >= 40)).alias("hit"))


@query("""select c_custkey, c_name from customer join nation on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation) and c_mktsegment <> 'BUILDING'""")
def f08_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    first = nation.agg(F.min("n_name").alias("n_name"))
    members = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    return members.join(nation.join(first, "n_name", "left_semi"), members.c_nationkey == nation.n_nationkey, "left_semi").select("c_custkey", "c_name")


@query("""select l_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where l_shipdate > o_orderdate and o_orderdate <= timestamp '1996-06-01' and l_shipdate > timestamp '1996-06-01'""")
def f09_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate > o_orderdate")
    return facts.filter(as_of("o_orderdate", "l_shipdate", F.expr("timestamp_ntz'1996-06-01'"))).select("l_orderkey", "l_linenumber")


@query("""with c as (select text, min(doc_id) m from documents group by 1) select d.doc_id from documents d join c on c.text = d.text where d.doc_id = c.m and d.n_chars > 0""")
def f12_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("n_chars > 0")
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""select s_suppkey, s_name from supplier where s_acctbal < 1000""")
def f13_watch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_acctbal < 1000").select("s_suppkey", "s_name")


@query("""select l_orderkey, count(*) filter (where coalesce(l_discount, 1.0) >= 0.05) as salient from lineitem group by 1""")
def f14_salient_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("salience"))
    return lines.select("l_orderkey", F.size(F.filter("salience", lambda s: F.coalesce(s, F.lit(1.0)) >= 0.05)).cast("long").alias("salient"))
