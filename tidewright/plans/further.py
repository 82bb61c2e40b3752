"""Further query-bearing functions: single metrics, traversal steps, listings and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators.dedup import simhash_clusters
from tidewright.operators.filters import Filters, compile_filters
from tidewright.operators.graph import conductance, project, shared_table
from tidewright.operators.joins import best_match
from tidewright.operators.ranking import counted_metrics, top_per_group
from tidewright.operators.search import cosine
from tidewright.plans.aggregates import dead_letters
from tidewright.plans.graphs import TRADE, trade
from tidewright.plans.ranking import JUDGED, judged
from tidewright.operators.spans import quote_hits
from tidewright.plans.registry import query, table


def metric(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return counted_metrics(*judged(spark, sf_dir), [10]).select("query_id", F.round(name, 6).alias(name))


@query(f"with {JUDGED} select query_id, round(found / k, 6) as precision from m where k = 10")
def w11_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, "precision")


@query(f"with {JUDGED} select query_id, round(case when total > 0 then found / total else 1.0 end, 6) as recall from m where k = 10")
def w12_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, "recall")


@query(f"with {JUDGED} select query_id, round(case when found > 0 then 2 * (found / k) * (found / total) / (found / k + found / total) else 0 end, 6) as f1 from m where k = 10")
def w13_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, "f1")


@query(f"with {JUDGED} select query_id, case when found > 0 then 1.0::double else 0.0::double end as hit from m where k = 10")
def w14_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, "hit")


@query(f"with {JUDGED} select round(avg(coalesce(1.0 / first, 0)), 6) as mrr from m where k = 10")
def w15_mean_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_metrics(*judged(spark, sf_dir), [10]).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


@query(f"with {JUDGED} select query_id, round(case when total > 0 then ap / total else 0 end, 6) as average_precision from m where k = 10")
def w16_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, "average_precision")


@query(f"with {JUDGED} select query_id, round(case when best > 0 then dcg / best else 1 end, 6) as ndcg from m where k = 10")
def w17_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, "ndcg")


@query(f"with {TRADE} select src as parent, dst as node, rn::bigint as rn from (select src, dst, row_number() over (partition by src order by weight desc, dst) rn from edges where weight >= 0.15 and src in (0, 3, 6)) where rn <= 5")
def j11_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop from a frontier with a weight floor and a fan-out cap per parent."""
    frontier = spark.createDataFrame([(0,), (3,), (6,)], "src int")
    hops = project(trade(spark, sf_dir)).filter("weight >= 0.15").join(F.broadcast(frontier), "src", "left_semi")
    return top_per_group(hops, ["src"], [F.desc("weight"), F.col("dst")], 5).select(F.col("src").alias("parent"), F.col("dst").alias("node"), "rn")


@query()
def x25_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations whose fingerprints are linked within three bits, by the smallest of each cluster."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")
    return simhash_clusters(turns)


@query("""select doc_id, source from documents where source in ('src4', 'src5') order by n_chars desc, doc_id limit 40""")
def y02_members_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = compile_filters(Filters(any_of={"source": ["src5", "src4"]}))
    return table(spark, sf_dir, "documents").filter(chosen).orderBy(F.desc("n_chars"), "doc_id").limit(40).select("doc_id", "source")


@query("""select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""")
def y05_unlinked_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(linked, "c_custkey", "left_anti").select("c_custkey")


@query("""select o_orderkey, o_orderstatus from orders where o_custkey = 11 order by o_orderkey""")
def y07_accounts_of_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_custkey = 11").orderBy("o_orderkey").select("o_orderkey", "o_orderstatus")


@query("""select conv_id, turn from conversations c where turn = (select max(turn) from conversations d where d.conv_id = c.conv_id)""")
def y11_current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of every report; superseded ones are hidden."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query("""with c as (select item_id as report, (item_id * 7 + n) % (select count(*) from documents) as cited, item_id, n from benchmark, (select unnest(range(0, 3)) n)), held as (select d.doc_id, b.item_id, b.text q, d.text t from documents d join benchmark b on contains(d.text, b.text)), k as (select item_id as report, doc_id as cited, item_id from held union select report, cited, item_id from c)
select report, cited, item_id, d.doc_id is not null as resolved, coalesce(contains(d.text, b.text), false) as verified, case when contains(d.text, b.text) then strpos(d.text, b.text) end as position from k join benchmark b using (item_id) left join documents d on d.doc_id = k.cited""")
def y14_verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored citations (report, cited document, quote) in one read: whether each document is there and holds the quote, and where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = shared_table(quote_hits(docs, ["doc_id"], items), "quote-hits")
    n = docs.count()
    loose = items.select(F.col("item_id").alias("report"), F.explode(F.array(*map(F.lit, range(3)))).alias("n"), "item_id").select("report", F.expr(f"(item_id * 7 + n) % {n}").alias("cited"), "item_id")
    cited = shared_table(found.select(F.col("item_id").alias("report"), F.col("doc_id").alias("cited"), "item_id").unionByName(loose).distinct(), "citations")
    there = docs.select(F.col("doc_id").alias("cited"), F.lit(True).alias("there"))
    hits = found.select(F.col("doc_id").alias("cited"), "item_id", "position")
    joined = cited.join(there, "cited", "left").join(hits, ["cited", "item_id"], "left")
    return joined.select("report", "cited", "item_id", F.coalesce("there", F.lit(False)).alias("resolved"), F.col("position").isNotNull().alias("verified"), "position")


@query("""with m as (select text, min(doc_id) canonical from documents group by 1) select doc_id, canonical from documents join m using (text) where doc_id <> canonical""")
def y26_forwarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("canonical")), "h").filter("doc_id != canonical").select("doc_id", "canonical")


@query("""select p_partkey from part where p_partkey <> 5 and (p_name = (select p_name from part where p_partkey = 5) or p_brand = (select p_brand from part where p_partkey = 5))""")
def y27_candidates_for_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array("p_name", "p_brand")).alias("key"))
    own = part.filter("p_partkey = 5").select("key")
    return part.filter("p_partkey != 5").join(F.broadcast(own), "key", "left_semi").select("p_partkey").distinct()


@query(f"""with {TRADE}, t as (select s.n_regionkey sc, d.n_regionkey dc, weight from edges join nation s on s.n_nationkey = src join nation d on d.n_nationkey = dst) select sc as community, round(sum(case when sc <> dc then weight else 0 end) / sum(weight), 8) as conductance from t group by 1""")
def y30_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return conductance(project(trade(spark, sf_dir)), member, smallest=1).select("community", F.round("conductance", 8).alias("conductance"))


@query("""select n_nationkey as node, coalesce(nullif(n_name, ''), 'unnamed') as name, coalesce(0.0::double, 0) as importance from nation""")
def y31_member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("n_name"), F.lit("")), F.lit("unnamed"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), name.alias("name"), F.lit(0.0).alias("importance"))


@query("""select o_custkey, max(o_orderdate) > timestamp '2000-06-01' as stale from orders group by 1""")
def y32_stale_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.max("o_orderdate") > F.expr("timestamp_ntz'2000-06-01'")).alias("stale"))


@query("""select distinct l_returnflag, l_linestatus from lineitem where (l_returnflag, l_linestatus) not in (select unnest(['A', 'R']), 'F')""")
def y34_endpoint_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = spark.createDataFrame([("A", "F"), ("R", "F")], "l_returnflag string, l_linestatus string")
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct().join(F.broadcast(legal), ["l_returnflag", "l_linestatus"], "left_anti")


@query("""select c_custkey, c_mktsegment not in ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') or length(c_name) > 18 or c_acctbal is null as rejected from customer""")
def y36_property_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE") | (F.length("c_name") > 18) | F.col("c_acctbal").isNull()
    return table(spark, sf_dir, "customer").select("c_custkey", bad.alias("rejected"))


@query("""select doc_id, source, lang from documents union select doc_id, source, lang from documents where doc_id in (select doc_id from labels)""")
def y37_stub_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    stubs = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return stubs.unionByName(docs).dropDuplicates(["doc_id"])


@query("""select o_custkey, date_diff('day', max(o_orderdate), timestamp '2001-08-01') > 365 as dormant from orders group by 1""")
def y46_dormant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.datediff(F.lit("2001-08-01"), F.max("o_orderdate")) > 365).alias("dormant"))


@query("""select doc_id, n_chars <= 25000 and lang in ('en', 'de') as fetch, case when lang = 'en' then 'text' when lang = 'de' then 'text' else 'other' end as kind from documents""")
def y50_media_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.col("lang").isin("en", "de")
    return table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") <= 25000) & allowed).alias("fetch"), F.when(allowed, "text").otherwise("other").alias("kind"))


@query("""select doc_id, lang from documents where lang in ('en', 'fr') and n_chars >= 100 and source <> 'src0'""")
def y17_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language is folded to its primary subtag before it is compared."""
    docs = table(spark, sf_dir, "documents").withColumn("lang", T.primary_subtag(F.col("lang")))
    return docs.filter(compile_filters(Filters(any_of={"lang": ["en", "fr"]}, at_least={"n_chars": 100})) & (F.col("source") != "src0")).select("doc_id", "lang")


@query("""select o_orderkey from orders where o_orderdate >= timestamp '2001-08-01' - interval 14 day""")
def m04_relative_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions.windows import parse_since

    since = parse_since("2w", "2001-08-01T00:00:00")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz")).select("o_orderkey")


@query("""select a.vec_id as a, b.vec_id as b, round(least(greatest(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0), 1), 8) as feature from embeddings a join embeddings b on b.vec_id = a.vec_id + 2""")
def k12_embedding_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = v.select(F.col("vec_id").alias("a"), F.col("e").alias("x")), v.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 2).alias("a"), F.col("e").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(F.least(F.greatest(cosine(F.col("x"), F.col("y")), F.lit(0.0)), F.lit(1.0)), 8).alias("feature"))


@query("""select event_id from events qualify row_number() over (partition by user_id order by event_id) = 1 union select event_id from events where value > 99""")
def r05_two_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = best_match(events, "user_id", F.col("event_id"))
    return first.select("event_id").union(events.filter("value > 99").select("event_id")).distinct()


@query()
def y43_dead_letter_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters keep their original bytes beside the class of the failure."""
    return dead_letters(spark, sf_dir).select("event_id", F.base64(F.encode("message", "UTF-8")).alias("body"), "failure_class", F.lit(0).alias("attempts"))


@query("""select user_id, count(*) as n, row_number() over (order by count(*) desc, user_id) as position from events group by 1 order by n desc, user_id limit 15""")
def y33_ranked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(15)
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).cast("long"))
