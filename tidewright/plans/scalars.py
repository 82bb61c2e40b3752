"""Dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.scoring import band, clamp, log_saturate, weighted_mean_of_present
from tidewright.operators.ranking import least_values
from tidewright.operators.temporal import close, is_late
from tidewright.plans.registry import query, table


@query("""select event_id, ts, year(ts) between 1900 and 2200 as valid from events""")
def m01_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.year("ts").between(1900, 2200).alias("valid"))


@query("""select o_orderkey, abs(date_diff('day', timestamp '1998-01-01', o_orderdate)) <= case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 7 else 31 end as uncertain from orders""")
def m02_boundary_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 7).otherwise(31)
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.abs(F.datediff("o_orderdate", F.lit("1998-01-01"))) <= window).alias("uncertain"))


@query("""select l_orderkey, l_linenumber, least(coalesce(nullif(l_shipdate, timestamp '1998-01-01'), timestamp '1999-01-01'), timestamp '1999-01-01') as valid_to from lineitem""")
def m03_interval_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.nullif(F.col("l_shipdate"), F.expr("timestamp_ntz'1998-01-01'"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", close(end, F.expr("timestamp_ntz'1999-01-01'")).alias("valid_to"))


@query("""select user_id, least(60.0 * pow(2, least(count(*) filter (where event_type = 'error'), 16)), 21600.0) as delay_s from events group by 1""")
def m05_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = F.sum((F.col("event_type") == "error").cast("int"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(60.0 * F.pow(F.lit(2.0), F.least(failures, F.lit(16))), F.lit(21600.0)).alias("delay_s"))


@query("""select c_custkey, case when c_mktsegment = 'MACHINERY' then 'disabled' when c_acctbal < 0 then 'running' when c_acctbal < 3000 then 'due' else 'waiting' end as decision from customer""")
def m06_due_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.when(F.col("c_mktsegment") == "MACHINERY", "disabled").when(F.col("c_acctbal") < 0, "running").when(F.col("c_acctbal") < 3000, "due").otherwise("waiting")
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("decision"))


@query("""select c_custkey, round(case when c_acctbal <= 0 then 0 else least(1, ln(1 + c_acctbal) / ln(5001)) end, 8) as reach from customer""")
def m07_log_saturate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(log_saturate(F.col("c_acctbal"), 5000), 8).alias("reach"))


@query("""select p_partkey, round(case when p_size between 1 and 50 then 0.6 * (p_retailprice / 3000 - 0.5) + 0.4 * (2.0 * (p_size - 1) / 49 - 1) else p_retailprice / 3000 - 0.5 end, 8) as polarity from part""")
def m08_rating_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, size = F.col("p_retailprice") / 3000 - 0.5, F.col("p_size")
    prior = 2.0 * (size - 1) / 49 - 1
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.when(size.between(1, 50), 0.6 * own + 0.4 * prior).otherwise(own), 8).alias("polarity"))


@query("""select l_orderkey, case when max(l_discount - 0.05) >= 0.035 and min(l_discount - 0.05) <= -0.035 then 'mixed' else 'neutral' end as label from lineitem group by 1""")
def m09_promote_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") - 0.05).alias("t"))
    mixed = (F.array_max("t") >= 0.035) & (F.array_min("t") <= -0.035)
    return targets.select("l_orderkey", F.when(mixed, "mixed").otherwise("neutral").alias("label"))


@query("""select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 8) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def m10_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.search import cosine

    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = v.select(F.col("vec_id").alias("a"), F.col("e").alias("x")), v.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("e").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 8).alias("cosine"))


@query("""with s as (select l_orderkey k, list_distinct(list(l_suppkey % 20)) s from lineitem group by 1) select a.k as a, b.k as b, case when len(list_intersect(a.s, b.s)) > 0 then round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 8) end as jaccard from s a join s b on b.k = a.k + 1""")
def m12_context_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 20).alias("s"))
    a, b = sets.select(F.col("l_orderkey").alias("a"), F.col("s").alias("x")), sets.select(F.col("l_orderkey").alias("b"), (F.col("l_orderkey") - 1).alias("a"), F.col("s").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return a.join(b, "a").select("a", "b", F.when(shared > 0, F.round(shared / F.size(F.array_union("x", "y")), 8)).alias("jaccard"))


@query("""select p_partkey, round((0.5 * p_size / 50 + case when p_retailprice > 1200 then 0.3 else 0 end) / (0.5 + case when p_retailprice > 1200 then 0.3 else 0 end), 8) as combined from part""")
def m13_combine_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"name": F.col("p_size") / 50, "alias": F.when(F.col("p_retailprice") > 1200, 1.0)}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(weighted_mean_of_present(parts, {"name": 0.5, "alias": 0.3}), 8).alias("combined"))


@query("""select p_partkey, case when p_size / 50.0 >= 0.92 then 'match' when p_size / 50.0 >= 0.75 then 'review' else 'distinct' end as decision from part""")
def m14_decision_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", band(F.col("p_size") / 50.0, [(0.92, "match"), (0.75, "review")], "distinct").alias("decision"))


@query("""select event_id, json_extract_string(props, '$.k') as k from events""")
def m16_dotted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as double) as number, try_cast(json_extract_string(props, '$.missing') as bigint) as missing from events""")
def m17_numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda path, kind: F.get_json_object("props", path).try_cast(kind)
    return table(spark, sf_dir, "events").select("event_id", number("$.k", "double").alias("number"), number("$.missing", "bigint").alias("missing"))


@query("""select p_partkey, 'brand=' || p_brand || '|size=' || p_size || '|type=' || p_type as fingerprint from part""")
def m18_property_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    entries = F.array_sort(F.map_entries(props))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("fingerprint"))


@query("""select l_orderkey, array_to_string(list_slice(list_sort(list_distinct(list(l_suppkey))), 1, 3), ',') as suppliers from lineitem group by 1""")
def m19_distinct_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = least_values(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 3)
    return capped.select("l_orderkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("suppliers"))


@query("""select c_custkey, least(greatest(coalesce(c_acctbal / 5000, 0), 0), 1) as score from customer""")
def m20_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", clamp(F.coalesce(F.col("c_acctbal") / 5000, F.lit(0.0))).alias("score"))


@query("""select l_orderkey, l_linenumber, l_shipdate < o_orderdate + interval 10 day as late from lineitem join orders on o_orderkey = l_orderkey""")
def r08_late_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", is_late(F.col("o_orderdate") + F.expr("interval 10 days"), F.col("l_shipdate")).alias("late"))


@query("""select p_partkey, a::bigint * 1000000 + b::bigint * 1000 + c::bigint as ordinal from (select p_partkey, p_size a, p_partkey % 7 b, p_partkey % 11 c from part)""")
def p12_version_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions.records import version_ordinal

    text = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 11).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", version_ordinal(text).alias("ordinal"))


@query("""select o_orderkey, o_orderpriority, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'alerts' when o_orderstatus = 'F' then 'archive' else 'signals' end as topic from orders""")
def y42_topic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "alerts").when(F.col("o_orderstatus") == "F", "archive").otherwise("signals")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", topic.alias("topic"))


@query("""select distinct o_orderstatus as current, t.target, (o_orderstatus = 'O' and t.target in ('P', 'F')) or (o_orderstatus = 'P' and t.target = 'F') as allowed from orders, (select unnest(['O', 'P', 'F']) target) t""")
def y10_state_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = spark.createDataFrame([("O", "P"), ("O", "F"), ("P", "F")], "current string, target string").withColumn("ok", F.lit(True))
    states = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("current")).distinct().withColumn("target", F.explode(F.array(F.lit("O"), F.lit("P"), F.lit("F"))))
    return states.join(F.broadcast(legal), ["current", "target"], "left").select("current", "target", F.coalesce("ok", F.lit(False)).alias("allowed"))


@query("""select page_id, case when url like '%.html' then 'document' when url like '%page=%' then 'listing' else 'other' end as kind, 'raw/' || 'web' || '/' || page_id || '.html' as object_key from pages""")
def y51_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("url").endswith(".html"), "document").when(F.contains("url", F.lit("page=")), "listing").otherwise("other")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.concat_ws("/", F.lit("raw"), F.lit("web"), F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("object_key"))
