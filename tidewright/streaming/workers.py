"""Streams into stored tables: each micro-batch replaces its own part of every sink, so that a replay changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidewright.operators.graph import shared_folder

# Fixed value: days until a sighting is forgotten.
SEEN_DAYS = 7


def file_stream(spark: SparkSession, path: str, schema: StructType | None = None, per_batch: int | None = None) -> DataFrame:
    """A stream over the files of a folder, or over one file; ``per_batch`` files make a micro-batch."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if schema is None:
        # A pattern instead of the path, as a stream takes a single file only by pattern.
        folder, _, name = path.rpartition("/")
        path = f"{folder}/{name[:-1]}[{name[-1]}]"
    return reader.parquet(path)


def drain(stream: DataFrame, sinks: Mapping[str, Callable[[DataFrame], DataFrame]], base: str) -> dict[str, DataFrame]:
    """Run ``stream`` until its input is used up and return the sinks' tables with the column batch.

    A micro-batch is written to every sink under its number, over what an earlier
    try has left there.  Offsets lie under ``base`` too: called again with it, a
    stopped run goes on with the micro-batch it broke off in.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, made in sinks.items():
            made(batch).write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    return {name: spark.read.parquet(f"{base}/{name}") for name in sinks}


def first_sightings_with_expiry(stream: DataFrame, key: str, days: float = SEEN_DAYS, late: str = "0 seconds") -> DataFrame:
    """key, event_id and ts of the rows of a stream (key, event_id, ts) that are seen first or after their key was forgotten.

    The first sighting fixes when a key expires; later ones do not put it off.  A
    key's state is one instant, dropped when the watermark passes it.  Rows of a
    micro-batch are taken in order of time and id; one that comes later than a
    newer sighting of its key, while that lasts, is a repetition.
    """
    span = pd.Timedelta(days=days)
    schema = stream.select(key, "event_id", "ts").schema

    def fresh(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([p[["event_id", "ts"]] for p in parts]).sort_values(["ts", "event_id"])
        until = pd.Timestamp(state.get[0]) if state.exists else None
        found, at = [], 0
        times = rows["ts"].to_numpy()
        while at < len(rows):
            # The next row that the last sighting does not cover.
            if until is not None:
                at = int(times.searchsorted(until.to_datetime64(), "left"))
                if at >= len(rows):
                    break
            found.append(at)
            until = pd.Timestamp(times[at]) + span
        if until is not None:
            state.update((until.to_pydatetime(),))
            # A deadline that the watermark has passed already is dropped at the next chance.
            state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if found:
            out = rows.iloc[found]
            yield pd.DataFrame({key: [group[0]] * len(out), "event_id": out["event_id"], "ts": out["ts"]})[[f.name for f in schema]]

    marked = stream.select(key, "event_id", "ts").withWatermark("ts", late)
    return marked.groupBy(key).applyInPandasWithState(fresh, schema, "until timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def seen_set(stream: DataFrame, key: str, base: str, days: float = SEEN_DAYS) -> DataFrame:
    """The sightings of :func:`first_sightings_with_expiry` of a whole stream (key, event_id, ts), drained into a table with the column batch.

    A micro-batch is walked key by key on the JVM, by time and id, from the instants
    that the one before left; so one that is tried again finds what it found.  An
    instant is kept until the newest event has passed it; rows older than the newest
    event of earlier micro-batches are late and left out.
    """
    spark = stream.sparkSession
    span = F.lit(round(days * 86_400_000_000))
    row = F.struct("ts", "event_id")
    rows = stream.select(key, "event_id", "ts")
    kinds = dict(rows.dtypes)
    kept = f"struct<until:bigint,found:array<struct<ts:{kinds['ts']},event_id:{kinds['event_id']}>>>"

    def walk(acc: Column, x: Column) -> Column:
        at = F.unix_micros(x["ts"].cast("timestamp"))
        fresh = acc["until"].isNull() | (at >= acc["until"])
        return F.when(fresh, F.struct((at + span).alias("until"), F.array_append(acc["found"], x).alias("found")).cast(kept)).otherwise(acc)

    def write(batch: DataFrame, number: int) -> None:
        # Two places take turns: a micro-batch that is tried again still has its predecessor's.
        mine, last = f"{base}/state-{number % 2}", f"{base}/state-{(number + 1) % 2}"
        seen, newest = None, None
        if number:
            state = spark.read.parquet(last)
            newest = state.agg(F.max("newest")).first()[0]
            seen = state.filter("until is not null").select(F.col(key).alias("known"), F.col("until").alias("start"))
            batch = batch.filter(F.unix_micros(F.col("ts").cast("timestamp")) >= F.lit(newest)) if newest is not None else batch
        grouped = batch.filter("ts is not null").groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        if seen is None:
            grouped = grouped.withColumn("start", F.lit(None).cast("long"))
        else:
            grouped = grouped.join(seen, F.col(key).eqNullSafe(F.col("known")), "full_outer").withColumn(key, F.coalesce(key, "known"))
        begin = F.struct(F.col("start").alias("until"), F.array().alias("found")).cast(kept)
        walked = grouped.select(key, F.aggregate(F.coalesce("rows", F.array()), begin, walk).alias("w"), F.unix_micros(F.element_at("rows", -1)["ts"].cast("timestamp")).alias("last"))
        walked.write.mode("overwrite").parquet(f"{base}/walked")
        walked = spark.read.schema(walked.schema).parquet(f"{base}/walked")
        walked.select(key, F.explode("w.found").alias("f")).select(key, "f.event_id", "f.ts").write.mode("overwrite").parquet(f"{base}/fresh/batch={number}")
        end = walked.agg(F.greatest(F.max("last"), F.lit(newest).cast("long")).alias("newest"))
        # One row tells the newest event; the others are keys and when they are forgotten.
        alive = walked.select(key, F.col("w.until").alias("until")).join(F.broadcast(end), F.col("until") > F.col("newest")).drop("newest")
        alive.unionByName(end, allowMissingColumns=True).write.mode("overwrite").parquet(mine)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/fresh")


def sync_streams(pages: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, cursors) after one sync over archived pages.

    ``pages``: stream, page (from 1), total (pages of the answer), intact, items
    (array of structs with updated_at).  ``cursors``: stream, since; a stream without
    one is read from the start.  Items newer than the cursor come out, whatever is
    missing.  A stream's cursor moves to its newest item only if every page is there
    and intact: a gap would never be asked for again.
    """
    state = pages.groupBy("stream").agg(F.max("total").alias("total"), F.countDistinct(F.when(F.col("intact") & F.col("page").between(1, F.col("total")), F.col("page"))).alias("read"), F.max(F.array_max(F.transform("items", lambda x: x["updated_at"]))).alias("newest"))
    since = cursors.select("stream", "since")
    rows = pages.filter("intact").join(since, "stream", "left").select("stream", "page", "since", F.explode("items").alias("item"))
    items = rows.filter(F.col("since").isNull() | (F.col("item.updated_at") > F.col("since"))).select("stream", "page", "item.*").distinct()
    moved = since.join(state, "stream", "full_outer")
    complete = F.coalesce(F.col("read") == F.col("total"), F.lit(False))
    return items, moved.select("stream", F.when(complete, F.greatest("since", "newest")).otherwise(F.col("since")).alias("since"), complete.alias("complete"))


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's sinks and offsets."""
    return shared_folder(spark, name)
