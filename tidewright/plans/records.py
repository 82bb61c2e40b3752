"""Sources, sinks, record normalisation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.records import first_value, named_id, to_instant
from tidewright.plans.registry import query, table


@query("""select event_id, coalesce(nullif(trim(json_extract_string(props, '$.title')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), 'none') as field from events""")
def p01_field_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", first_value(F.col("props"), ["title", "k"], "none").alias("field"))


@query("""select page_id, case when page_id % 2 = 0 then page_id::varchar else sha256(url) end as native_id from pages""")
def p03_native_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(item, F.sha2("url", 256)).alias("native_id"))


@query()
def p04_signal_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("sig_"), named_id(ns, F.concat_ws(":", F.lit("web"), F.col("url")))).alias("signal_id"))


@query("""select event_id, epoch(date_trunc('second', ts))::bigint as a, epoch(date_trunc('second', ts))::bigint as b from events""")
def p05_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same instant read from epoch milliseconds and from an ISO text."""
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    millis = (F.unix_timestamp(at) * 1000).cast("string")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(to_instant(millis)).alias("a"), F.unix_timestamp(to_instant(iso)).alias("b"))


@query("""select doc_id, source || '/' || lang as platform, n_chars, substr(text, 1, 80) as title from documents where n_chars > 0""")
def p09_signal_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").filter("n_chars > 0").createOrReplaceTempView("signal_view")
    return spark.sql("select doc_id, source || '/' || lang as platform, n_chars, substr(text, 1, 80) as title from signal_view")


@query("""select page_id, sha256(html) as sha256, octet_length(encode(html)) as bytes, true as intact from pages""")
def s19_archive_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads written to the archive by content address, read back and checked."""
    from tidewright.sources.archive import read_archive, write_archive

    pages = table(spark, sf_dir, "pages").select(F.lit("web").alias("platform"), F.col("page_id").cast("string").alias("item"), F.encode("html", "UTF-8").alias("raw"))
    kept = read_archive(spark, write_archive(pages))
    return kept.select(F.col("item").cast("long").alias("page_id"), "sha256", F.octet_length("raw").cast("long").alias("bytes"), "intact")


@query("""select event_id from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1""")
def r04_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sighting per key over a stream that is drained; state keeps one row a key."""
    from tidewright.streaming.dedup import first_sightings

    return first_sightings(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"]).select("event_id")


@query("""select event_type, count(*) as n, round(sum(value), 4) as total, min(event_id) as first_event from events group by 1""")
def r09_batch_equals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped count kept up to date by micro-batches that are merged into a stored table."""
    from tidewright.streaming.dedup import drained_totals

    return drained_totals(spark, f"{sf_dir}/events.parquet").select("event_type", "n", F.round("total", 4).alias("total"), "first_event")
