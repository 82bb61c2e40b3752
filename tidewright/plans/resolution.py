"""Entity resolution and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.dedup import spread_minimum
from tidewright.operators.merge import delete_keys, upsert_guarded, upsert_last
from tidewright.plans.registry import query, table


@query("""with m as (select user_id, min(event_id) survivor, count(*) mentions, max(event_id) last_seen from events group by 1) select survivor, event_id as alias, mentions, last_seen from events e join m on e.user_id is not distinct from m.user_id""")
def k15_merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merged record as an alias of its survivor, with the survivor's totals: rows, so no group becomes one list."""
    rows = table(spark, sf_dir, "events")
    merged = rows.groupBy(F.col("user_id").alias("user")).agg(F.min("event_id").alias("survivor"), F.count("*").alias("mentions"), F.max("event_id").alias("last_seen"))
    return rows.join(merged, F.col("user_id").eqNullSafe(F.col("user"))).select("survivor", F.col("event_id").alias("alias"), "mentions", "last_seen")


@query()
def g29_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked by shared parts; every part links its orders as a star."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    first = lines.groupBy("p").agg(F.min("o").alias("u"))
    pairs = lines.join(first, "p").select("u", F.col("o").alias("v"))
    return spread_minimum(lines.select(F.col("o").alias("node")).distinct(), pairs).select("node", F.col("label").alias("component"))


@query("""with s as (select p_partkey, p_size v, p_name from part where p_partkey % 3 <> 0), b as (select p_partkey, (p_size * 7) % 50 v, upper(p_name) p_name from part where p_partkey % 2 = 0) select p_partkey, v, p_name from (select *, row_number() over (partition by p_partkey order by v desc, f desc) rn from (select *, 0 f from s union all select *, 1 from b)) where rn = 1""")
def s23_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    stored = part.filter("p_partkey % 3 != 0").select("p_partkey", F.col("p_size").alias("v"), "p_name")
    batch = part.filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") * 7 % 50).alias("v"), F.upper("p_name").alias("p_name"))
    return upsert_guarded(stored, batch, ["p_partkey"], "v")


@query("""with s as (select p_partkey, p_brand, p_name from part where p_partkey % 3 <> 0), b as (select p_partkey, 'new' p_brand, upper(p_name) p_name from part where p_partkey % 2 = 0) select coalesce(s.p_partkey, b.p_partkey) as p_partkey, coalesce(s.p_brand, b.p_brand) as p_brand, coalesce(b.p_name, s.p_name) as p_name from s full join b on b.p_partkey = s.p_partkey""")
def s24_last_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    stored = part.filter("p_partkey % 3 != 0").select("p_partkey", "p_brand", "p_name")
    batch = part.filter("p_partkey % 2 = 0").select("p_partkey", F.lit("new").alias("p_brand"), F.upper("p_name").alias("p_name"))
    return upsert_last(stored, batch, "p_partkey", ["p_brand"])


@query("""select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 0)""")
def s26_index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_keys(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")


@query("""select conv_id, turn from conversations where not (conv_id % 5 = 0 and turn >= 1)""")
def s28_vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(~((F.col("conv_id") % 5 == 0) & (F.col("turn") >= 1))).select("conv_id", "turn")


@query("""select count(*) as missing from lineitem where l_orderkey not in (select o_orderkey from orders) or l_suppkey not in (select s_suppkey from supplier)""")
def s29_endpoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    known = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi")
    return lines.agg(F.count("*").alias("all")).crossJoin(known.agg(F.count("*").alias("known"))).select((F.col("all") - F.col("known")).alias("missing"))


@query("""select d.doc_id, l.doc_id is null as pending from documents d left join labels l on l.doc_id = d.doc_id""")
def r14_index_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("done")).distinct()
    return table(spark, sf_dir, "documents").join(stamps, "doc_id", "left").select("doc_id", F.col("done").isNull().alias("pending"))


@query("""with u as (select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)) select c_custkey, coalesce(nullif(trim(c_name), ''), c_custkey::varchar) as identity from u""")
def y06_adopt_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    people = table(spark, sf_dir, "customer").join(linked, "c_custkey", "left_anti")
    return people.select("c_custkey", F.coalesce(F.when(F.trim("c_name") != "", F.col("c_name")), F.col("c_custkey").cast("string")).alias("identity"))


@query("""select conv_id from conversations group by 1 having count(*) filter (where role = 'assistant') = 0""")
def y12_uncited_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id").distinct().join(turns.filter("role = 'assistant'"), "conv_id", "left_anti")


@query("""select c_custkey from customer where starts_with(c_name, 'Customer#00000010')""")
def y03_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.startswith("c_name", F.lit("Customer#00000010"))).select("c_custkey")


@query("""with k as (select p_partkey, list_distinct(string_split(p_name || ' ' || p_type, ' ')) k from part) select a.p_partkey as a, b.p_partkey as b, array_to_string(list_sort(list_intersect(a.k, b.k)), ',') as shared from k a join k b on b.p_partkey = a.p_partkey + 1""")
def y28_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("k"))
    a, b = k.select(F.col("p_partkey").alias("a"), F.col("k").alias("x")), k.select(F.col("p_partkey").alias("b"), (F.col("p_partkey") - 1).alias("a"), F.col("k").alias("y"))
    return a.join(b, "a").select("a", "b", F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("shared"))
