"""Queries over streams with stored sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators.chunking import chunk_documents
from tidewright.operators.search import bucket
from tidewright.plans.registry import query, table
from tidewright.streaming import workers as S


@query("""with recursive e as (select user_id::varchar || ':' || event_type as k, ts, event_id from events where user_id is not null and event_type is not null), s as (select k, arg_min(event_id, (ts, event_id)) id, min(ts) ts from e group by 1 union all select e.k, arg_min(e.event_id, (e.ts, e.event_id)), min(e.ts) from s join e on e.k = s.k and e.ts >= s.ts + interval 7 day group by e.k) select k as "key", id as event_id, ts from s""")
def r04_seen_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user and type are new or were forgotten after seven days, kept as state with an expiry."""
    events = S.file_stream(spark, f"{sf_dir}/events.parquet").filter("user_id is not null and event_type is not null")
    keyed = events.select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.seen_set(keyed, "key", S.place(spark, "seen-set")).select("key", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def posting_rows(batch: DataFrame) -> DataFrame:
    """Token rows of documents for the keyword sink."""
    words = batch.select("doc_id", F.explode(T.tokens(T.dedup_form(F.col("text")))).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("tf")).withColumn("bucket", bucket(F.col("token")))


@query("""with t as (select doc_id, regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[\\p{L}\\p{N}_]+') w from documents where n_chars >= 40), p as (select doc_id, unnest(w) token from t), k as (select doc_id, count(*) tokens, count(distinct token) as terms from p group by 1) select doc_id, terms, tokens from k""")
def r10_indexing_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed into a keyword sink and a chunk sink by micro-batch: terms and tokens that the keyword sink holds of each."""
    stream = S.file_stream(spark, f"{sf_dir}/documents.parquet").filter("n_chars >= 40")
    sinks = S.drain(stream, {"keyword": posting_rows, "chunks": lambda rows: chunk_documents(rows.select("doc_id", "text"))}, S.place(spark, "indexing"))
    return sinks["keyword"].groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


@query("""with m as (select user_id, event_type, ts, value / 100 as salience from events where user_id is not null and value >= 10) select user_id, event_type, min(ts) as first_seen, max(ts) as last_seen, count(*) as evidence, round(max(salience), 6) as salience from m group by 1, 2""")
def r11_graph_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salient mentions streamed into stored edges: dates widen, evidence adds up, once a micro-batch however often it is replayed."""
    stream = S.file_stream(spark, f"{sf_dir}/events.parquet").filter("user_id is not null and value / 100 >= 0.1")
    edges = lambda rows: rows.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("evidence"), F.max(F.col("value") / 100).alias("salience"))
    parts = S.drain(stream, {"edges": edges}, S.place(spark, "graph"))["edges"]
    return parts.groupBy("user_id", "event_type").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("evidence").alias("evidence"), F.round(F.max("salience"), 6).alias("salience"))


_PAGES = "o_orderpriority || ':' || o_custkey % 40 as stream, (o_orderkey % 5 + 1)::int as page"


@query(f"""with i as (select {_PAGES}, o_orderdate as updated_at, o_orderkey from orders), p as (select stream, page, max(updated_at) newest, count(*) n, max(o_orderkey) % 41 <> 0 as intact from i group by 1, 2), s as (select stream, count(*) filter (intact) as read, max(newest) newest from p group by 1), c as (select stream, timestamp '1998-01-01' as since from s where stream not like '%7') select stream, case when read = 5 then greatest(c.since, newest) else c.since end as since, read = 5 as complete, (select count(*) from i join p using (stream, page) where i.stream = s.stream and intact and (c.since is null or i.updated_at > c.since)) as items from s left join c using (stream)""")
def r15_artifact_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of many streams synced: cursors move where every page was there and intact; items come out either way."""
    rows = table(spark, sf_dir, "orders").select(F.expr(_PAGES.split(" as stream")[0]).alias("stream"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("page"), F.struct(F.col("o_orderdate").alias("updated_at"), "o_orderkey").alias("item"))
    pages = rows.groupBy("stream", "page").agg(F.collect_list("item").alias("items"), F.max("item.o_orderkey").alias("last")).select("stream", "page", F.lit(5).alias("total"), (F.col("last") % 41 != 0).alias("intact"), "items")
    known = pages.select("stream").distinct().filter("stream not like '%7'").select("stream", F.lit("1998-01-01").cast("timestamp_ntz").alias("since"))
    items, cursors = S.sync_streams(pages, known)
    return cursors.join(items.groupBy("stream").agg(F.count("*").alias("items")), "stream", "left").select("stream", "since", "complete", F.coalesce("items", F.lit(0)).cast("long").alias("items"))
