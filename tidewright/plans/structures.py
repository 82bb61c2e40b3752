"""Pages of a code host read, components refined, embeddings keyed, mentions typed, payloads mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import entities as E
from tidewright.functions.records import json_depth
from tidewright.operators import context
from tidewright.operators.chunking import chunk_documents
from tidewright.operators.ranking import top_per_group
from tidewright.plans.exchange import _id_sql, name_id
from tidewright.plans.registry import query, table
from tidewright.sources import repository as R

SINCE = "1997-01-01"
PAGE = 50


def _pages(rows: DataFrame, scope: str, item, key: str | None = None) -> DataFrame:
    """Answers of a code host made from a table: at most PAGE items a page."""
    items = F.collect_list(item)
    body = F.to_json(items if key is None else F.struct(items.alias(key)))
    return rows.groupBy(F.expr(scope).alias("scope")).agg(body.alias("raw"))


def _iso(column: str):
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query(f"select 'c' || o_orderkey as sha, o_orderpriority as title, 'Customer ' || o_custkey as author, epoch(o_orderdate)::bigint as at, (o_orderkey % 3)::int as n_parents from orders where o_orderdate >= timestamp '{SINCE}'")
def s11_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits from an instant on, read from archived pages; broken pages add nothing."""
    orders = table(spark, sf_dir, "orders")
    person = F.struct(F.concat(F.lit("Customer "), "o_custkey").alias("name"), _iso("o_orderdate").alias("date"))
    parents = F.transform(F.slice(F.array(F.lit("p1"), F.lit("p2")), F.lit(1), (F.col("o_orderkey") % 3).cast("int")), lambda p: F.struct(p.alias("sha")))
    item = F.struct(F.concat(F.lit("c"), "o_orderkey").alias("sha"), F.struct(F.concat("o_orderpriority", F.lit("\n\nbody")).alias("message"), person.alias("author")).alias("commit"), parents.alias("parents"))
    good = _pages(orders, f"cast(o_orderkey div {PAGE} as string)", item)
    broken = good.filter("cast(scope as long) % 7 = 0").select("scope", F.lit("{broken").alias("raw"))
    return R.commits(good.union(broken), SINCE).select("sha", "title", "author", F.unix_timestamp("authored_at").alias("at"), "n_parents")


def _pull_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), F.struct(F.concat(F.lit("u"), "o_custkey").alias("login")).alias("user"), F.when(F.col("o_orderkey") % 10 != 0, _iso("o_orderdate")).alias("updated_at"), F.when(F.col("o_orderstatus") == "F", _iso("o_orderdate")).alias("merged_at"))
    return _pages(table(spark, sf_dir, "orders"), f"cast(o_orderkey div {PAGE} as string)", item)


@query(f"select o_orderkey as number, o_orderpriority as title, case o_orderstatus when 'O' then 'open' else 'closed' end as state, 'u' || o_custkey as author, o_orderstatus = 'F' as merged from orders where o_orderkey % 10 = 0 or o_orderdate > timestamp '{SINCE}'")
def s12_pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests updated after an instant, and those that lack one."""
    return R.pull_requests(_pull_pages(spark, sf_dir), SINCE).drop("updated_at")


@query(f"select l_orderkey as number, l_orderkey * 10 + l_linenumber as review_id, l_returnflag as state, 's' || l_suppkey as reviewer from lineitem join orders on o_orderkey = l_orderkey where o_orderkey % 10 = 0 or o_orderdate > timestamp '{SINCE}'")
def s13_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of the changed pull requests only."""
    item = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("state"), F.struct(F.concat(F.lit("s"), "l_suppkey").alias("login")).alias("user"), _iso("l_shipdate").alias("submitted_at"))
    pages = _pages(table(spark, sf_dir, "lineitem"), "cast(l_orderkey as string)", item)
    return R.reviews(pages, R.pull_requests(_pull_pages(spark, sf_dir), SINCE)).drop("submitted_at")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "click", "success")
    item = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.when(done.isNull(), "in_progress").otherwise("completed").alias("status"), done.alias("conclusion"), F.sha1(F.col("event_id").cast("string")).alias("head_sha"), _iso("ts").alias("created_at"))
    return R.workflow_runs(_pages(table(spark, sf_dir, "events"), f"cast(event_id div {PAGE} as string)", item, "workflow_runs"), "2024-01-03")


@query("select event_id as run_id, event_type as name, case when event_type in ('error', 'click') then 'completed' else 'in_progress' end as status, case event_type when 'error' then 'failure' when 'click' then 'success' end as conclusion, sha1(event_id::varchar) as head_sha from events where date_trunc('second', ts) >= timestamp '2024-01-03'")
def s14_workflow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).drop("created_at")


@query("select event_id as run_id, event_id * 10 + j as job_id, 'job ' || j as name, case when j = 1 then 'failure' else 'success' end as conclusion, j + 1 as n_steps, case when j = 1 then 'step 1' end as failed_step from events, (select unnest([0, 1, 2])::int j) where date_trunc('second', ts) >= timestamp '2024-01-03' and event_type <> 'click'")
def s15_run_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the runs that did not succeed, with the first failed step."""
    step = lambda j: F.transform(F.sequence(F.lit(0), F.lit(j)), lambda n: F.struct(n.alias("number"), F.concat(F.lit("step "), n.cast("string")).alias("name"), F.when((n == 1) & F.lit(j == 1), "failure").otherwise("success").alias("conclusion")))
    jobs = F.array(*[F.struct((F.col("event_id") * 10 + j).alias("id"), F.lit(f"job {j}").alias("name"), F.lit("failure" if j == 1 else "success").alias("conclusion"), step(j).alias("steps")) for j in range(3)])
    pages = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("scope"), F.to_json(F.struct(jobs.alias("jobs"))).alias("raw"))
    return R.run_jobs(pages, _runs(spark, sf_dir))


_RAW = """case event_id % 3 when 0 then props when 1 then '{"a":[' || props || ',"]}\\\\""],"b":{}}' else '[]' end"""


@query("with r as (select event_id, " + _RAW.replace("\\\\", "\\") + """ raw from events), b as (select event_id, regexp_replace(regexp_replace(regexp_replace(raw, '\\\\.', '', 'g'), '"[^"]*"', '', 'g'), '[^\\[\\]{}]', '', 'g') b from r), c as (select event_id, b, unnest(range(1, length(b) + 1)) i from b), d as (select event_id, sum(case when substr(b, i, 1) in ('[', '{') then 1 else -1 end) over (partition by event_id order by i) d from c) select event_id, max(d)::int as depth from d group by 1""")
def m15_json_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_depth(F.expr(_RAW)).alias("depth"))


def _keys_sql(width: int = 64) -> str:
    side = lambda p: f"case when list_dot_product(e, [{', '.join(map(repr, p.tolist()))}]::double[]) >= 0 then '1' else '0' end"
    planes = E.planes(width)
    bands = ", ".join(f"'{b}:' || " + " || ".join(side(p) for p in planes[b * E.BITS : (b + 1) * E.BITS]) for b in range(E.BANDS))
    return f"with v as (select vec_id, embedding::double[] e from embeddings where list_dot_product(embedding, embedding) > 0) select vec_id, unnest([{bands}]) as band from v"


@query(_keys_sql())
def m11_plane_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking keys of every vector by the sides of seeded planes."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(E.plane_keys(F.col("embedding"))).alias("band"))


_KINDS_SQL = " ".join(f"when w in ({', '.join(repr(y) for y in [k.lower(), *[w for w, x in E.OTHER_WORDS.items() if x == k]])}) then '{k}'" for k in E.TYPES)
_REPORTED = "case p_partkey % 6 when 0 then ' Vendor ' when 1 then 'GPE' when 2 then 'person' when 3 then p_type when 4 then 'software' end"


@query(f"""with p as (select p_partkey, lower(trim({_REPORTED})) w, substr(trim(regexp_replace(lower(trim(p_brand || ' ' || p_name || '!')), '[^\\w]+', '_', 'g'), '_'), 1, 48) slug from part) select p_partkey, case {_KINDS_SQL} else 'Unknown' end as kind, 'ent_' || slug || '|part-' || p_partkey as hints from p""")
def x41_types_and_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported types put into the closed set, and ids to look a surface up by; ids of no sound form are left out."""
    proposed = F.array(F.concat(F.lit(" PART-"), "p_partkey"), F.lit("not an id"), F.concat(F.lit("part-"), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", E.entity_type(F.expr(_REPORTED)).alias("kind"), F.array_join(E.lookup_hints(F.concat("p_brand", F.lit(" "), "p_name", F.lit("!")), proposed), "|").alias("hints"))


@query("select page_id, 'web' as connector, '1.0' as connector_version, sha256(html) as raw_sha256, octet_length(encode(html)) as raw_bytes, 'text/html' as content_type, sha256(url) as native_id from pages")
def p13_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a row comes from: reader, digest and size of the bytes as they came, native id."""
    lineage = F.struct(F.lit("web").alias("connector"), F.lit("1.0").alias("connector_version"), F.sha2("html", 256).alias("raw_sha256"), F.octet_length("html").cast("long").alias("raw_bytes"), F.lit("text/html").alias("content_type"), F.sha2("url", 256).alias("native_id"))
    return table(spark, sf_dir, "pages").select("page_id", lineage.alias("l")).select("page_id", "l.*")


@query(f"select event_id, {_id_sql('sig_', chr(39) + 'events:' + chr(39) + ' || event_id')} as signal_id, event_type as title, 'user ' || user_id as author, epoch_us(ts) // 1000 as created_ms, value as score, json_extract_string(props, '$.k') as k from events")
def p02_signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole payload as one signal: identity, content, author, time, engagement and what is left as metadata."""
    events = table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.struct(F.concat(F.lit("user "), "user_id").alias("name")).alias("author"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created"), F.struct(F.col("value").alias("score")).alias("stats"), F.col("props").alias("extra")))
    signal = F.struct(name_id("sig_", F.concat(F.lit("events:"), F.col("p.id").cast("string"))).alias("signal_id"), F.struct("p.title").alias("content"), F.col("p.author.name").alias("author"), F.col("p.created").alias("created_ms"), F.col("p.stats").alias("engagement"), F.from_json("p.extra", "map<string, string>").alias("metadata"))
    rows = events.select("event_id", payload.alias("raw")).select("event_id", F.from_json("raw", "id long, title string, author struct<name: string>, created long, stats struct<score: double>, extra string").alias("p"))
    return rows.select("event_id", signal.alias("s")).select("event_id", "s.signal_id", "s.content.title", "s.author", "s.created_ms", F.col("s.engagement.score").alias("score"), F.col("s.metadata")["k"].alias("k"))


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 2,000 characters with 200 of overlap and their document's fields."""
    docs = table(spark, sf_dir, "documents")
    return chunk_documents(docs, 2000, 200).join(docs.select("doc_id", "lang", "source"), "doc_id").select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "*")


@query()
def y38_index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_chunks(spark, sf_dir).select("chunk_id", "doc_id", "char_start", "char_end", F.length("chunk").alias("n_chars"))


@query()
def p11_chunk_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for the vector index: derived id and the payload that filters and citations need, without the vector."""
    payload = F.struct("doc_id", "lang", "source", "chunk_index", "char_start", "char_end", F.sha2("chunk", 256).alias("text_sha256"))
    return index_chunks(spark, sf_dir).select(name_id("", F.concat(F.lit("chunk:"), "chunk_id")).alias("point_id"), payload.alias("p")).select("point_id", "p.*")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("query_id"), F.col("o_orderkey").cast("long").alias("id"), F.crc32(F.col("o_orderpriority").cast("binary")).alias("signal"), F.col("o_totalprice").alias("score"), (F.length("o_orderpriority") * 10).cast("long").alias("cost"))
    return top_per_group(orders, ["query_id"], [F.desc("score"), F.col("id")], 150).drop("rn")


@query()
def t08_passage_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders fitted to a budget: one of each priority before any second."""
    return context.fill_rows(_passages(spark, sf_dir), 400, breadth=True)


@query()
def t09_fact_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders fitted to a budget in the order of their scores alone."""
    return context.fill_rows(_passages(spark, sf_dir), 150, breadth=False)
