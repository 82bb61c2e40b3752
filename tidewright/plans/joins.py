"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.joins import block_sizes, in_order, with_counts
from tidewright.operators.spans import quote_hits
from tidewright.plans.registry import query, table


@query("""select o_orderkey, c_name, o_totalprice from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' order by o_orderdate desc, o_orderkey limit 100""")
def j01_windowed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'")
    source = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return orders.join(source, F.col("o_custkey") == F.col("c_custkey")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "c_name", "o_totalprice")


@query("""select c_custkey, count(o_orderkey) as n_orders from customer left join orders on o_custkey = c_custkey group by 1""")
def j02_left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return with_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "n_orders")


@query("""select doc_id, source from documents where doc_id not in (select doc_id from labels)""")
def j03_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1, 2""")
def j04_identity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    linked = table(spark, sf_dir, "nation").join(people, "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return linked.join(table(spark, sf_dir, "region"), "r_regionkey").select("r_name", "n_name", "customers", "balance")


@query("""with c as (select s.s_suppkey, c.c_custkey, case when s.s_nationkey = c.c_nationkey and right(s.s_name, 3) = right(c.c_name, 3) then 0.9 when right(s.s_name, 3) = right(c.c_name, 3) then 0.6 end conf from supplier s join customer c on right(s.s_name, 3) = right(c.c_name, 3))
select s_suppkey, c_custkey, conf::double as confidence from (select *, row_number() over (partition by s_suppkey order by conf desc, c_custkey) rn from c) where rn = 1""")
def j05_best_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.right(c, F.lit(3))
    unlinked = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), key("s_name").alias("handle"))
    # The first customer of a handle and nation, and of a handle: nobody else of these can be the best.
    first = table(spark, sf_dir, "customer").groupBy(key("c_name").alias("handle"), F.col("c_nationkey").alias("nation")).agg(F.min("c_custkey").alias("near"))
    known = unlinked.join(first, ["handle", "nation"], "left").join(first.groupBy("handle").agg(F.min("near").alias("any")), "handle")
    return known.select("s_suppkey", F.coalesce("near", "any").alias("c_custkey"), F.when(F.col("near").isNotNull(), 0.9).otherwise(0.6).alias("confidence"))


@query("""with t as (select distinct p_name term from part), m as (select p.p_partkey, t.term, case when p.p_type = upper(split_part(t.term, ' ', 1)) then 0 when contains(p.p_name, split_part(t.term, ' ', 1)) then 1 when contains(p.p_name, split_part(t.term, ' ', 2)) then 2 end method from part p, t)
select p_partkey, term, method from (select *, row_number() over (partition by p_partkey order by method, term) rn from m where method is not null) where rn = 1""")
def j06_feature_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    word = lambda i: F.split("term", " ")[i]
    names = part.select(F.col("p_name").alias("term")).distinct().withColumn("first", word(0)).withColumn("second", word(1))
    # The first term of each word is the only one of it that can be the best.
    of = lambda key: names.groupBy(key.alias("key")).agg(F.min("term").alias("term"))
    # Substring rules over whole words are equalities on the words of a name.
    own = part.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    by_type = part.join(of(F.upper("first")), F.col("p_type") == F.col("key")).select("p_partkey", "term", F.lit(0).alias("method"))
    by_first = own.join(of(F.col("first")), F.col("word") == F.col("key")).select("p_partkey", "term", F.lit(1).alias("method"))
    by_second = own.join(of(F.col("second")), F.col("word") == F.col("key")).select("p_partkey", "term", F.lit(2).alias("method"))
    best = F.min(F.struct("method", "term"))
    return by_type.union(by_first).union(by_second).groupBy("p_partkey").agg(best.alias("b")).select("p_partkey", "b.term", "b.method")


@query("""select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1998-01-01' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""")
def j07_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' and o_orderdate < timestamp_ntz'1998-01-01'")
    reviews = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return open_.join(reviews, "o_orderkey", "left_anti").select("o_orderkey", "o_orderpriority")


@query("""select r_name, n_name, count(c_custkey) as members from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_acctbal > 5000 group by 1, 2""")
def j08_features_with_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"))
    nations = with_counts(table(spark, sf_dir, "nation"), rich, "n_nationkey", "members").withColumnRenamed("n_regionkey", "r_regionkey")
    return table(spark, sf_dir, "region").join(nations, "r_regionkey", "left").select("r_name", "n_name", F.coalesce("members", F.lit(0)).cast("long").alias("members"))


@query("""with ids as (select doc_id * 7 % 1000 as doc_id, doc_id as pos from documents) select i.pos, i.doc_id, d.source from ids i join documents d on d.doc_id = i.doc_id""")
def j09_ordered_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    ids = docs.select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 7 % 1000).alias("doc_id"))
    return in_order(ids, docs, "doc_id", "pos").select("pos", "doc_id", "source")


@query("""select l_partkey, l_orderkey, l_linenumber, rn from (select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by coalesce(l_discount, 0.5) desc, l_orderkey, l_linenumber) rn from lineitem join orders on o_orderkey = l_orderkey where o_orderdate < timestamp '1998-01-01') where rn <= 3""")
def j10_top_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.ranking import top_per_group

    valid = table(spark, sf_dir, "orders").filter("o_orderdate < timestamp_ntz'1998-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    mentions = table(spark, sf_dir, "lineitem").join(valid, "l_orderkey").select("l_partkey", "l_orderkey", "l_linenumber", F.coalesce("l_discount", F.lit(0.5)).alias("salience"))
    return top_per_group(mentions, ["l_partkey"], [F.desc("salience"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_partkey", "l_orderkey", "l_linenumber", "rn")


@query("""with m as (select text, min(doc_id) rep from documents group by 1) select d.doc_id, m.rep from documents d join m on m.text = d.text where exists (select 1 from labels l where l.doc_id = m.rep and quality = 1)""")
def j12_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    reps = docs.groupBy("h").agg(F.min("doc_id").alias("rep"))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("rep"))
    return docs.join(reps.join(good, "rep", "left_semi"), "h").select("doc_id", "rep")


@query("""with k as (select distinct s_suppkey id, unnest([s_nationkey::varchar || ':' || right(s_name, 1), 'b:' || floor(s_acctbal / 250)::bigint::varchar]) k from supplier) select count(*) as blocks, sum(n)::bigint as memberships, max(n) as largest, sum(n * (n - 1) // 2)::bigint as comparisons from (select k, count(*) n from k group by 1)""")
def k17_blocking_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.concat(F.col("s_nationkey").cast("string"), F.lit(":"), F.right("s_name", F.lit(1))), F.concat(F.lit("b:"), F.floor(F.col("s_acctbal") / 250).cast("string")))
    sizes = block_sizes(table(spark, sf_dir, "supplier"), "s_suppkey", keys)
    return sizes.agg(F.count("*").alias("blocks"), F.sum("n").alias("memberships"), F.max("n").alias("largest"), F.sum(F.expr("n * (n - 1) div 2")).alias("comparisons"))


@query("""with i as (select row_number() over () r, l_suppkey k, l_orderkey o, l_linenumber n, o_orderdate s, l_shipdate e from lineitem join orders on o_orderkey = l_orderkey where l_shipdate > o_orderdate)
select a.k, a.o, a.n, count(*) - 1 as overlaps from i a join i b on a.k = b.k and a.s < b.e and b.s < a.e group by a.r, a.k, a.o, a.n""")
def j15_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every interval with the number of others under its key that overlap it.

    Counts by key and instant are summed up along the instants, so no pair is
    made: an interval meets all that start before its end but those that ended by its start.
    """
    facts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).filter("l_shipdate > o_orderdate")
    rows = facts.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("o_orderdate").alias("s"), F.col("l_shipdate").alias("e"))
    marks = rows.select("k", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("e").alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("m"))
    sums = marks.groupBy("k", "m.t").agg(F.sum("m.up").alias("up"), F.sum("m.down").alias("down"))
    along = Window.partitionBy("k").orderBy("t")
    counted = sums.select("k", "t", (F.sum("up").over(along) - F.col("up")).alias("started"), F.sum("down").over(along).alias("ended"))
    at_end = counted.select("k", F.col("t").alias("e"), "started")
    at_start = counted.select("k", F.col("t").alias("s"), "ended")
    return rows.join(at_end, ["k", "e"]).join(at_start, ["k", "s"]).select("k", "o", "n", (F.col("started") - F.col("ended") - 1).alias("overlaps"))


@query("""select c1.conv_id, c1.turn, c2.turn as reply from conversations c1 join conversations c2 on c1.conv_id = c2.conv_id and c2.turn = c1.turn + 1 where c1.role = 'user' and c2.role = 'assistant'""")
def j16_artifact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply"))
    return turns.filter("role = 'user'").join(replies, ["conv_id", "turn"]).select("conv_id", "turn", "reply")


@query("""select f.rank, f.doc_id, d.source, d.n_chars from (select doc_id + 1 as rank, doc_id * 3 as doc_id from documents) f join documents d on d.doc_id = f.doc_id""")
def j17_passage_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("rank"), (F.col("doc_id") * 3).alias("doc_id"))
    return in_order(fused, table(spark, sf_dir, "documents"), "doc_id", "rank").select("rank", "doc_id", "source", "n_chars")


@query("""select b.item_id, count(d.doc_id) as found from benchmark b left join documents d on contains(d.text, b.text) group by 1""")
def x42_quote_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents that hold each quote."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    hits = quote_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], quotes)
    found = hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("found"))
    return quotes.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("found", F.lit(0)).cast("long").alias("found"))
