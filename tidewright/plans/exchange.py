"""What goes out to and comes in from stores: envelopes, indexes, edges, ids, reports, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.plans.registry import query, table

#: Fixed value: the namespace of name-based ids (the public one for URLs).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_id(prefix: str, name: Column) -> Column:
    """``prefix`` and the hex digits of the name-based UUID (version 5) of ``name``."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.lit(prefix), F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 19, 14))


def _id_sql(prefix: str, name: str) -> str:
    h = f"sha1(unhex('{NAMESPACE}') || encode({name}))"
    return f"'{prefix}' || substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || lower(printf('%x', (('0x' || substr({h}, 17, 2))::int & 63) | 128)) || substr({h}, 19, 14)"


@query(f"select c_custkey, {_id_sql('ent_', chr(39) + 'person:' + chr(39) + ' || c_name')} as entity_id from customer")
def k18_entity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", name_id("ent_", F.concat(F.lit("person:"), "c_name")).alias("entity_id"))


_IDS = {"art_": "'orders:' || o_orderkey", "src_": "'priority:' || o_orderpriority", "per_": "'customer:' || o_custkey", "ver_": "'version:' || (o_orderkey % 100)"}


@query("select o_orderkey, " + ", ".join(f"{_id_sql(p, n)} as {p}id" for p, n in _IDS.items()) + " from orders")
def m21_deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of artifacts, sources, persons and versions from their natural keys."""
    return table(spark, sf_dir, "orders").select("o_orderkey", *[name_id(p, F.expr(n)).alias(f"{p}id") for p, n in _IDS.items()])


_ENVELOPE = """case when event_id % 11 = 0 then '{broken' else '{"schema_version":' || (event_id % 4)::varchar || ',"key":"k' || event_id || '"}' end"""


@query(f"""with e as (select event_id, {_ENVELOPE} raw from events), d as (select event_id, case when json_valid(raw) then json_extract_string(raw, '$.schema_version')::int end v, case when json_valid(raw) then json_extract_string(raw, '$.key') end k from e) select event_id, case when v between 1 and 2 then k end as signal_key, case when v is null then 'undecodable' when v between 1 and 2 then 'readable' else 'unsupported' end as state from d""")
def r03_envelope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes read from JSON; broken ones and versions outside the readable range are told apart, none is lost."""
    raw = F.expr(_ENVELOPE.replace("::varchar", ""))
    read = F.from_json(raw, "schema_version int, key string")
    rows = table(spark, sf_dir, "events").select("event_id", read.alias("e"))
    v = F.col("e.schema_version")
    state = F.when(v.isNull(), "undecodable").when(v.between(1, 2), "readable").otherwise("unsupported")
    return rows.select("event_id", F.when(v.between(1, 2), F.col("e.key")).alias("signal_key"), state.alias("state"))


@query("""select n_name as report, '# ' || n_name || chr(10) || chr(10) || string_agg('- ' || s_name || ' (' || s_nationkey || ')', chr(10) order by s_name, s_suppkey) as markdown from nation join supplier on s_nationkey = n_nationkey group by n_name""")
def s31_markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per nation in Markdown: title and one line per supplier in order."""
    lines = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit("- "), "s_name", F.lit(" ("), F.col("s_nationkey").cast("string"), F.lit(")"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_name", "s_suppkey", line.alias("line")))), lambda x: x["line"]), "\n")
    return lines.groupBy("n_name").agg(body.alias("body")).select(F.col("n_name").alias("report"), F.concat(F.lit("# "), "n_name", F.lit("\n\n"), "body").alias("markdown"))


@query("""select 'person' as kind, c_custkey::varchar as native_id, c_name as title, null::varchar as parent from customer union all select 'pull_request', o_orderkey::varchar, o_orderpriority, o_custkey::varchar from orders union all select 'review', l_orderkey || '#' || l_linenumber, l_returnflag, l_orderkey::varchar from lineitem""")
def p06_artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different payloads as one table of artifacts by kind."""
    text = lambda c: F.col(c).cast("string")
    people = table(spark, sf_dir, "customer").select(F.lit("person").alias("kind"), text("c_custkey").alias("native_id"), F.col("c_name").alias("title"))
    pulls = table(spark, sf_dir, "orders").select(F.lit("pull_request").alias("kind"), text("o_orderkey").alias("native_id"), F.col("o_orderpriority").alias("title"), text("o_custkey").alias("parent"))
    reviews = table(spark, sf_dir, "lineitem").select(F.lit("review").alias("kind"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("native_id"), F.col("l_returnflag").alias("title"), text("l_orderkey").alias("parent"))
    return people.unionByName(pulls, allowMissingColumns=True).unionByName(reviews, allowMissingColumns=True)


@query("""with p as (select doc_id, lang, source, string_split(text, chr(10)) lines from documents where text is not null), x as (select doc_id, lang, source, unnest(lines) line, generate_subscripts(lines, 1) - 1 i from p) select doc_id || ':' || i as chunk_id, doc_id, lang, source, length(line) as n_chars from x where trim(line) <> ''""")
def p10_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document as rows for the keyword index, with the document's fields."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.filter(F.trim("line") != "").select(F.concat_ws(":", "doc_id", "i").alias("chunk_id"), "doc_id", "lang", "source", F.length("line").cast("long").alias("n_chars"))


@query("""with r as (select o_custkey q, o_orderkey d, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn, o_orderkey % 7 s from orders), h as (select q, d, row_number() over (partition by q order by s desc, rn) pos from r where rn <= 5), t as (select q, d, rn pos from r where rn > 5) select * from h union all select * from t""")
def t11_rerank_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of a fused list are put in the second score's order; the rest stays as it was."""
    fused = Window.partitionBy("q").orderBy(F.desc("o_totalprice"), "d")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("d"), "o_totalprice", (F.col("o_orderkey") % 7).alias("s")).withColumn("rn", F.row_number().over(fused))
    head = F.col("rn") <= 5
    again = Window.partitionBy("q", head).orderBy(F.when(head, -F.col("s")), "rn")
    return rows.withColumn("again", F.row_number().over(again)).select("q", "d", F.when(head, F.col("again")).otherwise(F.col("rn")).cast("long").alias("pos"))


@query("""with seeds as (select s_suppkey n from supplier where s_suppkey % 20 = 0), e as (select distinct l_suppkey a, l_partkey b from lineitem), parts as (select distinct b from e join seeds on a = n), reach as (select distinct a from e join parts using (b)) select a, b from e where a in (select a from reach) and b in (select b from parts)""")
def g24_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges between the nodes within two hops of the seeds, whatever their time."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    seeds = table(spark, sf_dir, "supplier").filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("a"))
    parts = edges.join(seeds, "a", "left_semi").select("b").distinct()
    reach = edges.join(parts, "b", "left_semi").select("a").distinct()
    return edges.join(parts, "b", "left_semi").join(reach, "a", "left_semi").select("a", "b")


@query("""with q as (select n_nationkey q, lower(n_name) text from nation), a as (select n_nationkey q, lower(r_name) alias, 1 pos from nation join region on n_regionkey = r_regionkey union all select n_nationkey, lower(split_part(n_name, ' ', 1)), 2 from nation union all select n_nationkey, lower(n_name) || ' trade', 3 from nation), f as (select q, alias, min(pos) pos from a join q using (q) where not contains(text, alias) group by 1, 2) select q, alias as term, row_number() over (partition by q order by pos, alias) as position from f qualify position <= 2""")
def g27_query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and aliases that a query lacks, in order, at most two."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = F.array(F.lower("r_name"), F.lower(F.split("n_name", " ")[0]), F.lower(F.concat("n_name", F.lit(" trade"))))
    terms = rows.select(F.col("n_nationkey").alias("q"), F.lower("n_name").alias("text"), F.posexplode(aliases).alias("pos", "term"))
    kept = terms.filter(~F.contains("text", F.col("term"))).groupBy("q", "term").agg(F.min("pos").alias("pos"))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy("pos", "term")).cast("long")).filter("position <= 2").select("q", "term", "position")


@query("""with s as (select o_orderkey from orders where o_orderkey % 20 = 0), m as (select distinct l_partkey p from lineitem join s on l_orderkey = o_orderkey) select distinct l_suppkey as supplier, l_partkey as part, l_shipdate as since from lineitem join m on l_partkey = p order by since desc, supplier, part limit 200""")
def g28_facts_of_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts around the entities that the retrieved signals mention, newest first."""
    lines = table(spark, sf_dir, "lineitem")
    found = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    mentioned = lines.join(found, "l_orderkey", "left_semi").select("l_partkey").distinct()
    facts = lines.join(mentioned, "l_partkey", "left_semi").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("since")).distinct()
    return facts.orderBy(F.desc("since"), "supplier", "part").limit(200)


@query("""with d as (select l_partkey feature, l_orderkey artifact, l_returnflag <> 'R' belongs, l_shipdate decided, l_linenumber n from lineitem) select feature, artifact, arg_max(belongs, (decided, n)) as belongs, max(decided) as decided_at, 1.0::double as confidence from d group by 1, 2""")
def y04_membership_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision on each membership stays, with full confidence."""
    made = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_orderkey").alias("artifact"), (F.col("l_returnflag") != "R").alias("belongs"), F.col("l_shipdate").alias("decided"), F.col("l_linenumber").alias("n"))
    last = made.groupBy("feature", "artifact").agg(F.max(F.struct("decided", "n", "belongs")).alias("m"))
    return last.select("feature", "artifact", F.col("m.belongs").alias("belongs"), F.col("m.decided").alias("decided_at"), F.lit(1.0).alias("confidence"))


@query("""select o_custkey as investigation, o_orderkey as report, row_number() over w as version, lead(o_orderkey) over w as superseded_by from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def y13_report_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of an investigation as versions; each is superseded by the next."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("investigation"), F.col("o_orderkey").alias("report"), F.row_number().over(w).cast("long").alias("version"), F.lead("o_orderkey").over(w).alias("superseded_by"))


@query("""with i as (select l_suppkey s, l_partkey p, l_shipdate::date f, case when l_returnflag <> 'N' then l_shipdate + interval 30 day end t from lineitem) select s as supplier, max(case when f <= date '1996-06-30' and (t is null or t > date '1996-06-30') then p end) as at_instant, count(*) filter (where t is null) as open from i group by 1""")
def y22_interval_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part whose interval covers an instant, and the number of intervals still open."""
    at = F.to_date(F.lit("1996-06-30"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_shipdate").cast("date").alias("f"), F.when(F.col("l_returnflag") != "N", F.date_add(F.col("l_shipdate").cast("date"), 30)).alias("t"))
    covers = (F.col("f") <= at) & (F.col("t").isNull() | (F.col("t") > at))
    return rows.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.max(F.when(covers, F.col("l_partkey"))).alias("at_instant"), F.count_if(F.col("t").isNull()).alias("open"))


_SPLIT = r"[^\p{L}\p{N}''-]+"
_STOPS = ("the", "a", "an", "and", "or", "of", "in", "on", "to", "is", "for", "with", "it", "that", "was", "he", "der", "die", "das", "und", "la", "le", "el", "de", "que", "y", "et", "les")


@query(f"""with w as (select doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '{_SPLIT}')) w, generate_subscripts(string_split_regex(lower(coalesce(text, '')), '{_SPLIT}'), 1) i from documents), s as (select doc_id, w, i, count(*) filter (where w = '' or w in ({", ".join(f"'{x}'" for x in _STOPS)})) over (partition by doc_id order by i) g, w = '' or w in ({", ".join(f"'{x}'" for x in _STOPS)}) stop from w), r as (select doc_id, g, count(*) n from s where not stop group by 1, 2 having count(*) <= 3), x as (select s.doc_id, w, n from s join r using (doc_id, g) where not stop) select doc_id, w as word, count(*) as frequency, sum(n)::bigint as degree, round(sum(n) / count(*), 6) as score from x group by 1, 2""")
def x34_rake_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of candidate phrases (runs of up to three words between stop words): degree over frequency."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), _SPLIT.replace("''", "'"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("i", "w")).withColumn("stop", (F.col("w") == "") | F.col("w").isin(*_STOPS))
    runs = rows.withColumn("g", F.sum(F.col("stop").cast("int")).over(Window.partitionBy("doc_id").orderBy("i"))).filter("not stop")
    sized = runs.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "g"))).filter("n <= 3")
    return sized.groupBy("doc_id", F.col("w").alias("word")).agg(F.count("*").alias("frequency"), F.sum("n").alias("degree")).withColumn("score", F.round(F.col("degree") / F.col("frequency"), 6))
