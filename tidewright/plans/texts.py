"""Text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators.dedup import cluster_documents
from tidewright.operators.spans import quote_hits, resolve_mentions
from tidewright.plans.registry import query, table


@query("""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', '\n', 'g'), '\\n{3,}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g') as clean from documents""")
def x08_collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("clean"))


@query("""select doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[email]', 'g') as redacted from documents where contains(text, '@')""")
def x09_redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@")))
    return docs.select("doc_id", F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]").alias("redacted"))


@query("""with n as (select o_orderkey, (o_orderkey * 7919 + 1000003)::varchar d from orders), x as (select o_orderkey, d, length(d) - i as pos, substr(d, i + 1, 1)::int v from n, (select unnest(range(0, 16)) i) where i < length(d)) select o_orderkey, sum(case when pos % 2 = 0 then case when v * 2 > 9 then v * 2 - 9 else v * 2 end else v end) % 10 = 0 as valid from x group by 1""")
def x10_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("o_orderkey") * 7919 + 1000003).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.call_function("luhn_check", number).alias("valid"))


_TRACKED = "^(" + "|".join(T.TRACKING_PREFIXES) + ")|^(" + "|".join(T.TRACKING_NAMES) + ")$"
_SQL_URL = """u as (select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) s, lower(regexp_extract(url, '://([^/?#]*)', 1)) h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) p, regexp_extract(url, '\\?([^#]*)', 1) q from pages),
k as (select *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(lower(split_part(x, '=', 1)), 'TRACKED'))) a from u)""".replace("TRACKED", _TRACKED)


@query(f"with {_SQL_URL} select page_id, s || '://' || h || case when p = '' then '/' else p end || case when len(a) > 0 then '?' || array_to_string(a, '&') else '' end as canonical from k")
def x11_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query(f"""with p as (select page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) x from pages) select page_id, split_part(x, '=', 1) as name, regexp_matches(lower(split_part(x, '=', 1)), '{_TRACKED}') as tracking from p where x <> ''""")
def x12_tracking_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("x")).filter("x != ''")
    name = F.split("x", "=")[0]
    return params.select("page_id", name.alias("name"), T.is_tracking(name).alias("tracking"))


@query("""select doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as content_hash from documents""")
def x14_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.dedup_form(F.col("text")), 256).alias("content_hash"))


_SQL_TOKENS = "tok as (select doc_id, regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[\\p{L}\\p{N}_]+') t from documents)"


@query(f"with {_SQL_TOKENS} select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct from tok")
def x15_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(T.dedup_form(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_SQL_SHINGLES = f"""{_SQL_TOKENS}, sh as (select doc_id, case when len(t) < 3 then t else list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], chr(31))) end s from tok)"""


@query(f"with {_SQL_SHINGLES} select doc_id, len(s) as n_shingles, sha256(array_to_string(s, '|')) as digest from sh")
def x16_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(T.dedup_form(F.col("text"))).alias("t"))
    return words.select("doc_id", T.shingles(F.col("t")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


@query("""select a.page_id as a, b.page_id as b, bit_count(xor(a.page_id * 2654435761, b.page_id * 2654435761))::int as distance from pages a join pages b on b.page_id = a.page_id + 1""")
def x19_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    a, b = pages.select(F.col("page_id").alias("a")), pages.select(F.col("page_id").alias("b"), (F.col("page_id") - 1).alias("a"))
    return a.join(b, "a").select("a", "b", T.hamming(F.col("a") * 2654435761, F.col("b") * 2654435761).cast("int").alias("distance"))


@query("""select page_id, band, (page_id * 2654435761 >> (band * 16)) & 65535 as value from pages, (select unnest([0, 1, 2, 3]) band)""")
def x21_band_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda b: F.struct(b.alias("band"), F.call_function("shiftrightunsigned", F.col("page_id") * 2654435761, b * 16).bitwiseAND(F.lit(65535)).alias("value")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(keys).alias("k")).select("page_id", "k.band", "k.value")


@query(f"""with {_SQL_SHINGLES}, x as (select distinct doc_id, unnest(s) g from sh), n as (select doc_id, count(*) n from x group by 1), i as (select a.doc_id a, count(*) k from x a join x b on b.doc_id = a.doc_id + 1 and b.g = a.g group by 1) select p.doc_id as a, q.doc_id as b, round(coalesce(k, 0) / nullif(coalesce(m.n, 0) + coalesce(o.n, 0) - coalesce(k, 0), 0), 8) as jaccard from sh p join sh q on q.doc_id = p.doc_id + 1 left join n m on m.doc_id = p.doc_id left join n o on o.doc_id = q.doc_id left join i on i.a = p.doc_id""")
def x23_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Jaccard of given pairs: every document and the one with the next id."""
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(T.dedup_form(F.col("text"))).alias("t"))
    a, b = words.select(F.col("doc_id").alias("a"), F.col("t").alias("x")), words.select(F.col("doc_id").alias("b"), (F.col("doc_id") - 1).alias("a"), F.col("t").alias("y"))
    sets = a.join(b, "a").select("a", "b", T.shingles(F.col("x")).alias("x"), T.shingles(F.col("y")).alias("y"))
    return sets.select("a", "b", F.round(F.try_divide(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))), 8).alias("jaccard"))


@query("""with h as (select doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) h from documents) select doc_id, min(doc_id) over (partition by h) as canonical, 'dc_' || substr(sha256((min(doc_id) over (partition by h))::varchar), 1, 12) as cluster_id, case when doc_id = min(doc_id) over (partition by h) then null else min(doc_id) over (partition by h) end as duplicate_of from h""")
def x26_content_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal content with their canonical document; nothing is discarded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.dedup_form(F.col("text")), 256).alias("h"))
    return cluster_documents(docs)


@query(f"""with {_SQL_TOKENS}, w as (select doc_id, unnest(t) w from tok) select w as word, count(*) as frequency, count(distinct doc_id) as documents, round(count(*) / count(distinct doc_id), 6) as score from w where length(w) >= 5 group by 1""")
def x34_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(T.dedup_form(F.col("text")))).alias("word")).filter(F.length("word") >= 5)
    per = words.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("frequency"), F.count("*").alias("documents"), F.round(F.sum("n") / F.count("*"), 6).alias("score"))


@query("""with a as (select 'view' alias, 'engagement' slug union all select 'click', 'engagement' union all select 'signup', 'growth' union all select 'purchase', 'revenue') select user_id, slug, max(value) as score from events join a on alias = event_type group by 1, 2 qualify row_number() over (partition by user_id order by max(value) desc, slug) <= 6""")
def x35_topic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.ranking import top_per_group

    alias = spark.createDataFrame([("view", "engagement"), ("click", "engagement"), ("signup", "growth"), ("purchase", "revenue")], "event_type string, slug string")
    best = table(spark, sf_dir, "events").join(F.broadcast(alias), "event_type").groupBy("user_id", "slug").agg(F.max("value").alias("score"))
    return top_per_group(best, ["user_id"], [F.desc("score"), F.col("slug")], 6).drop("rn")


@query("""select doc_id, case when lang = 'de' then 'de-AT' else lang end as tag, lang as primary from documents""")
def x37_language_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("lang") == "de", F.lit(" DE-at")).otherwise(F.upper("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.language_tag(raw).alias("tag"), T.primary_subtag(F.trim(raw)).alias("primary"))


@query("""select doc_id, case when len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) > 0 then 'Latn' end as script from documents""")
def x38_dominant_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions.names import dominant_script

    return table(spark, sf_dir, "documents").select("doc_id", dominant_script(F.col("text")).alias("script"))


_SMALL = "abcdefghijklmnopqrstuvwxyz"
_SPANS = "(d.doc_id + b.item_id) % 4"


@query(f"""with h as (select d.doc_id, b.item_id, {_SPANS} k, strpos(d.text, b.text) - 1 p, strpos(lower(d.text), lower(b.text)) - 1 q, length(b.text) n from documents d join benchmark b on contains(d.text, b.text)) select doc_id, item_id, (case when k < 2 then p else q end)::int as start, (case when k < 2 then p else q end + n)::int as "end", case k when 0 then 'reported' when 1 then 'exact' when 2 then 'case' else 'blanks' end as tier from h""")
def x39_locate_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item in every document that holds it, reported rightly, with a wrong offset, in capitals or with wider blanks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    k = F.expr("(doc_id + item_id) % 4")
    surface = F.when(k == 2, F.translate("quote", _SMALL, _SMALL.upper())).when(k == 3, F.replace("quote", F.lit(" "), F.lit("  "))).otherwise(F.col("quote"))
    start = F.when(k == 0, F.col("position") - 1).when(k == 1, F.col("position") + 6).cast("int")
    told = quote_hits(docs, ["doc_id"], items).join(items, "item_id").select("doc_id", F.col("item_id").alias("ord"), surface.alias("surface"), start.alias("start"), F.when(k < 2, start + F.length("quote")).cast("int").alias("end"))
    numbered = told.withColumn("reported", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).select("doc_id", "reported", F.col("ord").alias("item_id"))
    return resolve_mentions(docs, told).join(numbered, ["doc_id", "reported"]).select("doc_id", "item_id", "start", "end", "tier")


@query()
def x40_verified_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words as mentions of their documents: each takes a place of its own, 64 a document, by start."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+)"), 1)).alias("ord", "surface"))
    none = F.lit(None).cast("int")
    return resolve_mentions(docs, words.select("doc_id", "ord", "surface", none.alias("start"), none.alias("end"))).select("doc_id", "reported", "start", "end", "surface", "tier", "position")


@query("""select p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part""")
def x45_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("""select doc_id, case when length(text) <= 300 then text else substr(text, 1, 200) || ' ... ' || right(text, 100) end as condensed from documents""")
def x43_elide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.elide_middle(F.col("text"), 300).alias("condensed"))


@query("""select p_partkey, array_to_string(list_transform(list_slice(list_filter(regexp_extract_all(p_name || ' ' || p_type, '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2), 1, 12), lambda x: '"' || x || '"'), ' OR ') as q from part""")
def x44_lucene_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.lucene_safe(F.concat_ws(" ", "p_name", "p_type")).alias("q"))


@query("""select doc_id, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x) <> '')) as paragraphs from documents""")
def x48_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("paragraphs"))


@query("""select conv_id || ':' || turn as chunk_id, conv_id::varchar as signal, turn from conversations""")
def x49_chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"))
    return joined.select("chunk_id", F.substring_index("chunk_id", ":", 1).alias("signal"), F.substring_index("chunk_id", ":", -1).cast("long").alias("turn"))


@query("""select doc_id, case when source in ('src0','src1') then 'whole' when source in ('src2','src3','src4') then 'heading' else 'paragraph' end as strategy from documents""")
def x50_chunk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.when(F.col("source").isin("src0", "src1"), "whole").when(F.col("source").isin("src2", "src3", "src4"), "heading").otherwise("paragraph")
    return table(spark, sf_dir, "documents").select("doc_id", strategy.alias("strategy"))


@query()
def x47_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.chunking import chunk_documents

    return chunk_documents(table(spark, sf_dir, "documents"), most=2000, overlap=200)


@query()
def x17_simhash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.dedup import simhash_clusters

    return simhash_clusters(table(spark, sf_dir, "documents"))
