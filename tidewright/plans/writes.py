"""Queries that write stored tables: indexes, edges, logs, parked rows, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions.entities import plane_keys
from tidewright.operators.dedup import fingerprints, near_pairs
from tidewright.operators.graph import pagerank, project, shared_table
from tidewright.operators.joins import block_pairs
from tidewright.operators.merge import edge_key, upsert_edges, upsert_guarded
from tidewright.operators.search import bucket, store_index
from tidewright.plans.exchange import _id_sql, name_id
from tidewright.plans.graphs import nodes, trade
from tidewright.plans.registry import query, table
from tidewright.streaming import workers as S

#: Marks around text of tools: a text that holds one could end its fence.
FENCE = r"(?i)tool_(?:end_)?untrusted_data"


def scrubbed(text):
    """No control characters but tab, line feed and carriage return, then no fence marks: a mark cannot hide behind a control character."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), FENCE, "[redacted-fence-token]")


@query("""select doc_id, substr('<[redacted-fence-token]> ' || replace(replace(text, chr(7), ''), chr(127), '') || ' [redacted-fence-token]', 1, 2000) as scrubbed from documents""")
def f11_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between forged fence marks, one of them split by a control character, scrubbed and cut at 2,000 characters."""
    forged = F.concat(F.lit("<TOOL_untrusted_data> "), "text", F.lit(" tool_\x07end_untrusted_data\x7f"))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(scrubbed(forged), 1, 2000).alias("scrubbed"))


@query("""select 'evt-' || event_id as key, case event_type when 'error' then 'signals.failed' else 'signals.raw' end as topic, 1 as schema_version, 'loader' as producer, epoch_us(ts) as occurred_us, sha256(concat_ws('|', event_id, user_id, event_type, props)) as payload_hash from events""")
def s22_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed envelopes keyed by signal, streamed into a stored log and read back: topic, version, producer, instant and the payload's hash."""
    topic = F.when(F.col("event_type") == "error", "signals.failed").otherwise("signals.raw")
    wrap = lambda rows: rows.select(F.concat(F.lit("evt-"), "event_id").alias("key"), topic.alias("topic"), F.lit(1).alias("schema_version"), F.lit("loader").alias("producer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("occurred_us"), F.sha2(F.concat_ws("|", "event_id", "user_id", "event_type", "props"), 256).alias("payload_hash"))
    return S.drain(S.file_stream(spark, f"{sf_dir}/events.parquet"), {"log": wrap}, S.place(spark, "event-log"))["log"].drop("batch")


_BODY = "case when version = 2 then substr(text, 1, 200) when version = 0 then 'stale ' || text else text end"


@query(f"""with v as (select doc_id, text, 1 as version from documents union all select doc_id, text, 2 from documents where doc_id % 2 = 0 union all select doc_id, text, 0 from documents where doc_id % 3 = 0), w as (select doc_id, version, {_BODY} as text from v qualify row_number() over (partition by doc_id order by version desc) = 1), t as (select doc_id, version, unnest(regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[\\p{{L}}\\p{{N}}_]+')) token from w) select doc_id, version, count(distinct token) as terms, count(*) as tokens from t group by 1, 2""")
def s25_versioned_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed, then newer and stale versions in bulk: the stored postings hold the newest version of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = docs.withColumn("version", F.lit(1))
    batch = docs.filter("doc_id % 2 = 0").withColumn("version", F.lit(2)).unionByName(docs.filter("doc_id % 3 = 0").withColumn("version", F.lit(0)))
    kept = upsert_guarded(stored, batch, ["doc_id"], "version").select("doc_id", "version", F.expr(_BODY).alias("text"))
    kept = shared_table(kept, "indexed-versions")
    postings = store_index(kept, {"text": T.tokens(T.dedup_form(F.col("text")))})
    held = postings.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum(F.size("positions")).alias("tokens"))
    return held.join(kept.select("doc_id", "version"), "doc_id").select("doc_id", "version", "terms", "tokens")


@query(f"""select vec_id, {_id_sql('', chr(39) + 'chunk:' + chr(39) + ' || vec_id')} as point_id, vec_id // 256 as batch, 4 as planes from embeddings where embedding is not null and len(embedding) = (select max(len(embedding)) from embeddings) and list_dot_product(embedding, embedding) > 0""")
def s27_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points stored by bucket of their planes: derived id, vector of the collection's width, batch of 256."""
    vectors = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    points = vectors.filter(F.size("embedding") == dim).select("vec_id", name_id("", F.concat(F.lit("chunk:"), "vec_id")).alias("point_id"), "embedding", F.floor(F.col("vec_id") / 256).alias("batch"), plane_keys(F.col("embedding").cast("array<double>")).alias("planes"))
    rows = points.select("vec_id", "point_id", "embedding", "batch", F.explode("planes").alias("plane")).withColumn("bucket", bucket(F.col("plane")))
    stored = shared_table(rows.repartition("bucket").sortWithinPartitions("bucket", "plane"), "points")
    return stored.groupBy("vec_id", "point_id", "batch").agg(F.countDistinct("plane").cast("int").alias("planes"))


_KIND = "case when l_returnflag = 'R' then 'RELATED_TO' else 'MENTIONS' end"
_EVIDENCE = "case when l_returnflag = 'N' then 'line-' || l_linenumber else '' end"


@query(f"""with e as (select l_orderkey, l_linenumber, {_KIND} k, 'ent_' || l_suppkey s, 'ent_' || l_partkey d, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' f, {_EVIDENCE} v from lineitem) select l_orderkey, l_linenumber, sha256(k || chr(31) || case when k = 'RELATED_TO' and d < s then d else s end || chr(31) || case when k = 'RELATED_TO' and d < s then s else d end || chr(31) || f || chr(31) || v)[1:32] as edge_key from e""")
def g05_edge_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of edges by kind, ends, start and evidence; one kind has no direction."""
    key = edge_key(F.expr(_KIND), F.concat(F.lit("ent_"), "l_suppkey"), F.concat(F.lit("ent_"), "l_partkey"), F.col("l_shipdate"), F.expr(_EVIDENCE), ["RELATED_TO"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("edge_key"))


@query(f"""with e as (select sha256({_KIND} || chr(31) || case when l_returnflag = 'R' and 'ent_' || l_partkey < 'ent_' || l_suppkey then 'ent_' || l_partkey || chr(31) || 'ent_' || l_suppkey else 'ent_' || l_suppkey || chr(31) || 'ent_' || l_partkey end || chr(31) || '1990-01-01T00:00:00.000000+00:00' || chr(31))[1:32] as edge_key, l_orderkey % 3 b, l_shipdate seen from lineitem) select edge_key, count(*) filter (where b < 2) as evidence_count, max(seen) filter (where b < 2) as newest, case when count(*) filter (where b = 1) > 0 then 'b1' else 'b0' end as last_batch_id from e where b < 2 group by 1""")
def g04_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of edges, the second one twice: evidence adds up, a batch that comes again adds nothing."""
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").select(edge_key(F.expr(_KIND), F.concat(F.lit("ent_"), "l_suppkey"), F.concat(F.lit("ent_"), "l_partkey"), start, F.lit(""), ["RELATED_TO"]).alias("edge_key"), (F.col("l_orderkey") % 3).alias("b"), F.lit(1).alias("new_evidence"), F.col("l_discount").alias("confidence"), start.alias("valid_from"), F.col("l_shipdate").alias("observed_at"))
    stored = rows.limit(0).select("edge_key", F.lit(0).cast("long").alias("evidence_count"), "confidence", "valid_from", "observed_at", F.lit("").alias("last_batch_id"))
    newest = rows.filter("b < 2").groupBy("edge_key").agg(F.max("observed_at").alias("newest"))
    for b in (0, 1, 1):
        stored = shared_table(upsert_edges(stored, rows.filter(F.col("b") == b), f"b{b}"), "edges")
    return stored.join(newest, "edge_key").select("edge_key", "evidence_count", "newest", "last_batch_id")


@query("""with k as (select distinct s_suppkey id, unnest([s_nationkey::varchar || ':' || right(s_name, 1), 'b:' || floor(s_acctbal / 250)::bigint::varchar]) k from supplier), n as (select k from k where k like 'b:%' group by 1 having count(*) > 200)
select distinct a.id as a, b.id as b from k a join k b on a.k = b.k and a.id < b.id where a.k not in (select k from n)""")
def j14_blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share a nation and last digit, or a band of balance; only the bands can be too broad to count."""
    keys = F.array(F.concat(F.col("s_nationkey").cast("string"), F.lit(":"), F.right("s_name", F.lit(1))), F.concat(F.lit("b:"), F.floor(F.col("s_acctbal") / 250).cast("string")))
    return block_pairs(table(spark, sf_dir, "supplier"), "s_suppkey", keys, 200, lambda k: k.startswith("b:"))


@query()
def j13_banded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents within three bits, found through four bands of sixteen."""
    prints = shared_table(fingerprints(table(spark, sf_dir, "documents")).select("print").filter("print != 0").distinct(), "prints")
    return near_pairs(prints)


@query("""select count(*) filter (where event_type <> 'error') as good, count(*) filter (where event_type = 'error') as parked, coalesce(sum(case when event_type = 'error' then 3 end), 0)::bigint as attempts from events""")
def r02_park_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose failing rows are parked with their attempts and body beside the sink of the good ones; both are stored."""
    bad = F.col("event_type") == "error"
    good = lambda rows: rows.filter(~bad).select("event_id", "event_type")
    parked = lambda rows: rows.filter(bad).select("event_id", F.lit(3).alias("attempts"), F.lit("handler").alias("error"), F.to_json(F.struct("event_id", "event_type", "props")).alias("body"))
    sinks = S.drain(S.file_stream(spark, f"{sf_dir}/events.parquet"), {"good": good, "parked": parked}, S.place(spark, "parking"))
    return sinks["good"].agg(F.count("*").alias("good")).crossJoin(sinks["parked"].agg(F.count("*").alias("parked"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts")))


@query("""with seen as (select event_type, max(ts) ts from events where event_id % 2 = 0 group by 1), prev as (select event_type, max(ts) as floor from events where event_id % 3 = 0 and event_type <> 'click' group by 1) select event_type, greatest(seen.ts, floor) as watermark, coalesce(floor > seen.ts, false) as clamped, greatest(seen.ts, floor) - interval 10 minute as read_from from seen left join prev using (event_type)""")
def r06_source_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors after a read: never behind where they stood, read from with an overlap."""
    events = table(spark, sf_dir, "events")
    seen = events.filter("event_id % 2 = 0").groupBy("event_type").agg(F.max("ts").alias("ts"))
    prev = events.filter("event_id % 3 = 0 and event_type != 'click'").groupBy("event_type").agg(F.max("ts").alias("floor"))
    mark = F.greatest("ts", "floor")
    return seen.join(prev, "event_type", "left").select("event_type", mark.alias("watermark"), F.coalesce(F.col("floor") > F.col("ts"), F.lit(False)).alias("clamped"), (mark - F.expr("interval 10 minutes")).alias("read_from"))


@query()
def g10_personal_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of nations whose walks restart at nations of the first region alone."""
    home = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("node"), F.lit(1.0).alias("weight"))
    return pagerank(nodes(spark, sf_dir), project(trade(spark, sf_dir)), 100, tolerance=1e-6, teleport=home)
