"""Aggregations and composite scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.scoring import band, clamp, compose_confidence, corroboration, half_life, log_saturate, ratio, weighted_geometric_mean, weighted_mean_of_present
from tidewright.plans.registry import query, table


@query("""select source, count(*) as n from documents group by 1""")
def a01_grouped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("""select user_id, round(coalesce(sum(case when event_type = 'purchase' then value end), 0), 4) as spent from events group by 1""")
def a02_sum_null_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)), 4).alias("spent"))


@query("""select event_type, count(distinct user_id) as signals, round(avg(value), 6) as sentiment, max(ts) as last_seen from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' and value >= 0.3 group by 1""")
def a03_topic_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = table(spark, sf_dir, "events").filter("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-25' and value >= 0.3")
    return inside.groupBy("event_type").agg(F.countDistinct("user_id").alias("signals"), F.round(F.avg("value"), 6).alias("sentiment"), F.max("ts").alias("last_seen"))


@query("""select o_custkey, l_partkey, max(l_discount) as salience from lineitem join orders on o_orderkey = l_orderkey group by 1, 2""")
def a04_max_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey", "l_partkey").agg(F.max("l_discount").alias("salience"))


@query("""select l_orderkey, round(exp(sum(ln(1 - l_discount))), 9) as confidence from lineitem group by 1""")
def a05_path_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.product(1 - F.col("l_discount")), 9).alias("confidence"))


#: Messages as a dead-letter queue would record them, made from events.
FAILURES = """case when event_type = 'error' and value < 30 then 'Connection refused by host' when event_type = 'error' and value < 60 then 'ValidationError: field required' when event_type = 'error' then 'deadline exceeded' when event_type = 'signup' then 'KeyError x' else '' end"""
CLASSES = ("dependency", "validation", "timeout", "poison", "unknown")
# Markers of each failure class, in order of precedence.
MARKERS = {
    "dependency": ("connection", "unavailable", "refused", "unreachable", "no route", "temporarily", "serviceunavailable", "operationalerror"),
    "validation": ("validationerror", "validation error", "field required", "extra inputs", "unable to parse", "invalid"),
    "timeout": ("timeout", "timed out", "deadline"),
}
_SQL_CLASS = "case when trim(m) = '' then 'unknown' " + " ".join(f"when regexp_matches(lower(m), '{'|'.join(words)}') then '{name}'" for name, words in MARKERS.items()) + " else 'poison' end"


def failure_class(message):
    low = F.lower(message)
    out = F.when(F.trim(message) == "", "unknown")
    for name, words in MARKERS.items():
        out = out.when(low.rlike("|".join(words)), name)
    return out.otherwise("poison")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("message", F.expr(FAILURES))
    return events.select("event_id", "ts", "message", failure_class(F.col("message")).alias("failure_class"), (F.col("user_id") % 5).alias("replays"))


_SQL_DLQ = f"dlq as (select event_id, ts, m as message, {_SQL_CLASS} as failure_class, user_id % 5 as replays from (select *, {FAILURES} m from events))"


@query(f"with {_SQL_DLQ} select event_id, failure_class from dlq")
def a07_failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters(spark, sf_dir).select("event_id", "failure_class")


@query(f"""with {_SQL_DLQ}, c as (select unnest(['dependency','validation','timeout','poison','unknown','other']) failure_class) select c.failure_class, count(event_id) as n, count(event_id) filter (where c.failure_class in ('dependency','timeout') and replays < 3) as replayable from c left join dlq on dlq.failure_class = c.failure_class group by 1""")
def a06_dlq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([(c,) for c in (*CLASSES, "other")], "failure_class string")
    can = F.col("failure_class").isin("dependency", "timeout") & (F.col("replays") < 3)
    counts = dead_letters(spark, sf_dir).groupBy("failure_class").agg(F.count("*").alias("n"), F.sum(can.cast("long")).alias("replayable"))
    return classes.join(counts, "failure_class", "left").select("failure_class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("replayable", F.lit(0)).cast("long").alias("replayable"))


@query(f"with {_SQL_DLQ} select event_id, failure_class from dlq where ts >= timestamp '2024-01-20' and failure_class in ('dependency','timeout') order by ts desc, event_id desc limit 50")
def y44_dlq_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = dead_letters(spark, sf_dir).filter("ts >= timestamp_ntz'2024-01-20' and failure_class in ('dependency', 'timeout')")
    return chosen.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "failure_class")


@query(f"with {_SQL_DLQ} select event_id, case when replays >= 3 then 'exhausted' when failure_class not in ('dependency','timeout') then failure_class else '' end as reason from dlq")
def y45_refusal_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("replays") >= 3, "exhausted").when(~F.col("failure_class").isin("dependency", "timeout"), F.col("failure_class")).otherwise("")
    return dead_letters(spark, sf_dir).select("event_id", reason.alias("reason"))


@query(f"with {_SQL_DLQ} select event_id from dlq where failure_class in ('dependency','timeout') and replays < 3")
def r18_dlq_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters(spark, sf_dir).filter("failure_class in ('dependency', 'timeout') and replays < 3").select("event_id")


@query("""select l_orderkey, l_linenumber, round(pow(greatest(l_discount * 10, 0.05), 0.35) * pow(greatest(l_tax * 10, 0.05), 0.25) * pow(greatest(l_quantity / 50, 0.05), 0.2) * pow(0.05, 0.2), 6) as confidence from lineitem""")
def a08_compose_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"source_credibility": F.col("l_discount") * 10, "extraction_quality": F.col("l_tax") * 10, "content_integrity": F.col("l_quantity") / 50, "corroboration": F.lit(0.0)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", compose_confidence(parts).alias("confidence"))


# Weights, targets and half life of evidence sets.
EVIDENCE_WEIGHTS = {"verification": 0.30, "corroboration": 0.25, "independence": 0.20, "source_quality": 0.15, "recency": 0.10}
_SQL_EVIDENCE = """cited as (select o_custkey g, l_partkey sig, l_suppkey plat, l_discount * 10 conf, l_returnflag <> 'R' ok, date_diff('day', l_shipdate, timestamp '2001-12-01') age from lineitem join orders on o_orderkey = l_orderkey),
d as (select g, sig, min(conf) conf from cited where ok group by 1, 2), q as (select g, avg(conf) quality from d group by 1),
e as (select g, count(*) total, count(*) filter (where ok) verified, count(distinct sig) filter (where ok) sigs, count(distinct plat) filter (where ok) plats, median(greatest(age, 0)) filter (where ok) age from cited group by 1)"""


@query(f"""with {_SQL_EVIDENCE} select e.g as o_custkey, case when verified = 0 then 0.0::double else round(pow(greatest(verified / total, 0.05), 0.3) * pow(greatest(least(1, ln(1 + sigs) / ln(5)), 0.05), 0.25) * pow(greatest(least(1, ln(1 + plats) / ln(4)), 0.05), 0.2) * pow(greatest(quality, 0.05), 0.15) * pow(greatest(pow(0.5, age / 90.0), 0.05), 0.1), 4) end as confidence from e left join q on q.g = e.g""")
def a09_evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of every customer's set of citations; only verified ones count."""
    cited = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    cited = cited.select("o_custkey", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("conf"), (F.col("l_returnflag") != "R").alias("ok"), F.greatest(F.datediff(F.lit("2001-12-01"), "l_shipdate"), F.lit(0)).alias("age"))
    ok = F.col("ok")
    per = cited.groupBy("o_custkey").agg(F.count("*").alias("total"), F.sum(ok.cast("long")).alias("verified"), F.countDistinct(F.when(ok, F.col("l_partkey"))).alias("signals"), F.countDistinct(F.when(ok, F.col("l_suppkey"))).alias("platforms"), F.median(F.when(ok, F.col("age"))).alias("age"))
    quality = cited.filter(ok).groupBy("o_custkey", "l_partkey").agg(F.min("conf").alias("conf")).groupBy("o_custkey").agg(F.avg("conf").alias("quality"))
    parts = {"verification": F.col("verified") / F.col("total"), "corroboration": log_saturate(F.col("signals"), 4), "independence": log_saturate(F.col("platforms"), 3), "source_quality": F.col("quality"), "recency": half_life(F.col("age"), 90.0)}
    score = F.when(F.col("verified") == 0, 0.0).otherwise(F.round(weighted_geometric_mean(parts, EVIDENCE_WEIGHTS, 0.05), 4))
    return per.join(quality, "o_custkey", "left").select("o_custkey", score.alias("confidence"))


@query("""select event_type, round(pow(0.5, median(date_diff('second', ts, timestamp '2024-03-01') / 86400.0) / 90.0), 6) as recency from events group by 1""")
def a10_median_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_timestamp(F.lit("2024-03-01").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))) / 86400.0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(half_life(F.median(age), 90.0), 6).alias("recency"))


@query("""select l_suppkey, round(avg(c), 8) as mean_confidence from (select l_suppkey, l_orderkey, max(l_discount) c from lineitem group by 1, 2) group by 1""")
def a11_mean_over_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_discount").alias("c"))
    return once.groupBy("l_suppkey").agg(F.round(F.avg("c"), 8).alias("mean_confidence"))


@query("""select event_id, round(cume_dist() over (partition by event_type order by value), 8) as percentile, count(*) over (partition by event_type) >= 100 as settled from events""")
def a12_cohort_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a row's cohort at or below its value, from the cohort's counts per value."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("event_type").orderBy("value")
    whole = Window.partitionBy("event_type")
    shares = counts.select("event_type", "value", (F.sum("n").over(order) / F.sum("n").over(whole)).alias("share"), F.sum("n").over(whole).alias("size"))
    return events.join(shares, ["event_type", "value"]).select("event_id", F.round("share", 8).alias("percentile"), (F.col("size") >= 100).alias("settled"))


@query("""select p_partkey, round((case when p_size > 5 then p_size / 50.0 * 0.4 else 0 end + case when p_retailprice > 1000 then 0.3 * p_retailprice / 3000 else 0 end) / nullif(case when p_size > 5 then 0.4 else 0 end + case when p_retailprice > 1000 then 0.3 else 0 end, 0), 6) as score from part""")
def a13_engagement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {"reach": F.when(F.col("p_size") > 5, F.col("p_size") / 50.0), "endorsement": F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice") / 3000)}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(weighted_mean_of_present(axes, {"reach": 0.4, "endorsement": 0.3}), 6).alias("score"))


_STAGE_WEIGHTS = "case event_type when 'view' then 0.3 when 'click' then 0.25 when 'signup' then 0.2 when 'purchase' then 0.15 else 0.1 end"


@query(f"""with latest as (select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1) select user_id, round(sum(case when value >= 20 then {_STAGE_WEIGHTS} else 0 end)::double, 6) as quality from latest group by 1""")
def a14_extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return latest.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("value") >= 20, F.expr(_STAGE_WEIGHTS)).otherwise(0)).cast("double"), 6).alias("quality"))


@query("""select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def a15_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "value")).alias("m")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "m.event_id", "m.value")


@query("""select sha256(text) as cluster, round(least(1, ln(1 + count(distinct source)) / ln(9)), 6) as corroboration from documents group by 1""")
def a16_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("cluster")).agg(corroboration(F.countDistinct("source")).alias("corroboration"))


@query("""select s_suppkey, round(least(1, 0.5 + (case when s_nationkey < 10 then 0.1 else 0 end + case when s_acctbal > 0 then 0.1 * least(1, ln(1 + s_acctbal) / ln(100001)) else 0 end) * 0.5), 6) as credibility from supplier""")
def a17_source_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonus = F.when(F.col("s_nationkey") < 10, 0.10).otherwise(0.0) + 0.10 * log_saturate(F.col("s_acctbal"), 100_000)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.least(F.lit(1.0), 0.5 + bonus * 0.5), 6).alias("credibility"))


@query("""select doc_id, case when trim(text) = '' then case when source = 'src0' then 0.2 else 0.0 end when n_chars > 5000 then 0.5 else 1.0 end::double as integrity from documents""")
def a18_content_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    value = F.when(empty & (F.col("source") == "src0"), 0.2).when(empty, 0.0).when(F.col("n_chars") > 5000, 0.5).otherwise(1.0)
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("integrity"))


@query("""select o_custkey, round(max(n) / sum(n), 6) as share, max(n) / sum(n) > 0.5 and sum(n) >= 4 as concentrated from (select o_custkey, o_orderpriority, count(*) n from orders group by 1, 2) group by 1""")
def a19_source_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return counts.groupBy("o_custkey").agg(F.round(share, 6).alias("share"), ((share > 0.5) & (F.sum("n") >= 4)).alias("concentrated"))


@query("""select l_suppkey, round(count(*) filter (where l_returnflag <> 'R') / count(*), 6) as yield_rate from lineitem group by 1""")
def a20_yield_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sum((F.col("l_returnflag") != "R").cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(ratio(kept, F.count("*")), 6).alias("yield_rate"))


@query("""select user_id, round(case when count(*) filter (where event_type in ('view','click')) > 0 then count(*) filter (where event_type = 'click') / count(*) filter (where event_type in ('view','click')) else 0 end, 6) as hit_rate from events group by 1""")
def a21_cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda *kinds: F.sum(F.col("event_type").isin(*kinds).cast("long"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(ratio(n("click"), n("view", "click")), 6).alias("hit_rate"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as quantity, round(sum(l_extendedprice), 2) as price, count(*) as n from lineitem group by 1, 2""")
def a22_ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("n"))


@query("""select distinct l_suppkey, l_returnflag from lineitem""")
def a23_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("""select l_orderkey, l_linenumber, case when l_discount * 10 >= 0.75 then 'high' when l_discount * 10 >= 0.45 then 'medium' else 'low' end as band from lineitem""")
def a24_confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", band(F.col("l_discount") * 10, [(0.75, "high"), (0.45, "medium")], "low").alias("band"))


@query("""select user_id, round(sum(least(greatest(v / 100, 0), 1) * w), 6) as total from (select user_id, event_type, max(value) v, case event_type when 'view' then 0.4 when 'click' then 0.3 else 0.1 end w from events group by 1, 2) group by 1""")
def a25_rubric_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    weight = F.when(F.col("event_type") == "view", 0.4).when(F.col("event_type") == "click", 0.3).otherwise(0.1)
    return best.groupBy("user_id").agg(F.round(F.sum(clamp(F.col("v") / 100) * weight), 6).alias("total"))


@query("""select event_type, round((1 - avg(least(value / 100, 1))) * case event_type when 'view' then 0.4 when 'click' then 0.3 else 0.1 end, 8) as loss from events group by 1 order by loss desc, event_type limit 3""")
def y48_weakest_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("event_type") == "view", 0.4).when(F.col("event_type") == "click", 0.3).otherwise(0.1)
    loss = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.least(F.col("value") / 100, F.lit(1.0))).alias("score"))
    return loss.select("event_type", F.round((1 - F.col("score")) * weight, 8).alias("loss")).orderBy(F.desc("loss"), "event_type").limit(3)


@query("""select r_name, count(distinct n_nationkey) as features, count(distinct c_custkey) filter (where c_acctbal > 0) as artifacts from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1""")
def y01_version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("m"))
    features = table(spark, sf_dir, "nation").join(members, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.countDistinct("n_nationkey").alias("features"), F.sum("m").alias("artifacts"))
    out = table(spark, sf_dir, "region").join(features, "r_regionkey", "left")
    return out.select("r_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("features", "artifacts")])


@query("""select user_id, arg_min(event_type, (v, event_type)) as weakest from (select user_id, event_type, round(avg(value), 9) v from events group by 1, 2) group by 1""")
def y15_weakest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 9).alias("v"))
    return parts.groupBy("user_id").agg(F.min_by("event_type", F.struct("v", "event_type")).alias("weakest"))


@query("""select l_suppkey, l_partkey, count(distinct l_orderkey) as evidence from lineitem group by 1, 2""")
def y23_evidence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("l_orderkey").alias("evidence"))


@query("""select sha256(text) as cluster, array_to_string(list_sort(list_distinct(list(source))), ',') as platforms from documents group by 1""")
def y25_distinct_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("cluster")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("platforms"))
