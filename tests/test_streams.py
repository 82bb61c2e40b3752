from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewright.streaming import workers as S

T0 = dt.datetime(2024, 1, 1)


def files(spark, folder, batches, schema):
    """One file a batch, in order of their names and times."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05 if i else 0)
    return folder


def test_sightings_expire_after_seven_days(spark, tmp_path):
    """Several micro-batches in order of time equal one replay; repetitions don't put the expiry off."""
    rng = random.Random(2)
    minutes = sorted(rng.randrange(60 * 24 * 40) for _ in range(400))
    rows = [(f"k{rng.randrange(6)}", i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    rows += [("edge", 1000, T0), ("edge", 1001, T0 + dt.timedelta(days=7) - dt.timedelta(microseconds=1)), ("edge", 1002, T0 + dt.timedelta(days=7)), ("edge", 1003, T0 + dt.timedelta(days=7)), ("edge", 1004, T0 + dt.timedelta(days=13)), ("edge", 1005, T0 + dt.timedelta(days=14))]
    rows.sort(key=lambda r: (r[2], r[1]))
    want, until = set(), {}
    for k, i, t in rows:
        if k not in until or t >= until[k]:
            want.add(i)
            until[k] = t + dt.timedelta(days=7)
    schema = "key string, event_id long, ts timestamp"
    folder = files(spark, str(tmp_path / "in"), [rows[i : i + 90] for i in range(0, len(rows), 90)], schema)
    stream = S.file_stream(spark, folder, spark.createDataFrame(rows[:1], schema).schema, per_batch=1)
    out = S.drain(S.first_sightings_with_expiry(stream, "key"), {"fresh": lambda b: b}, str(tmp_path / "run"))["fresh"]
    got = [r["event_id"] for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {1000, 1002, 1005} <= want and not {1001, 1003, 1004} & want
    assert out.select("batch").distinct().count() > 1


def test_seen_set_walks_keys_without_python_and_goes_on_after_a_break(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    minutes = sorted(rng.randrange(60 * 24 * 40) for _ in range(400))
    rows = [(f"k{rng.randrange(6)}" if rng.random() < 0.9 else None, i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    rows += [("edge", 1000, T0), ("edge", 1001, T0 + dt.timedelta(days=7) - dt.timedelta(microseconds=1)), ("edge", 1003, T0 + dt.timedelta(days=7)), ("edge", 1002, T0 + dt.timedelta(days=7)), ("edge", 1004, T0 + dt.timedelta(days=13)), ("edge", 1005, T0 + dt.timedelta(days=14))]
    rows.sort(key=lambda r: (r[2], r[1]))
    want, until = set(), {}
    for k, i, t in rows:
        if k not in until or t >= until[k]:
            want.add((k, i, t))
            until[k] = t + dt.timedelta(days=7)
    schema = "key string, event_id long, ts timestamp"
    folder = files(spark, str(tmp_path / "in"), [rows[i : i + 90] for i in range(0, len(rows), 90)], schema)
    given = spark.createDataFrame(rows[:1], schema).schema
    start = lambda: S.file_stream(spark, folder, given, per_batch=1)
    # A batch that fails once between its sightings and its state is walked again to the same rows.
    base, whole, broken = str(tmp_path / "run"), F.broadcast, {"left": 3}

    def breaks(df):
        broken["left"] -= 1
        if not broken["left"]:
            raise RuntimeError("lost before the state")
        return whole(df)

    monkeypatch.setattr(F, "broadcast", breaks)
    with pytest.raises(Exception, match="lost before the state"):
        S.seen_set(start(), "key", base)
    found = S.seen_set(start(), "key", base)
    assert sorted(map(str, map(tuple, found.select("key", "event_id", "ts").collect()))) == sorted(map(str, want))
    assert found.select("batch").distinct().count() > 3
    once = S.seen_set(S.file_stream(spark, folder, given), "key", str(tmp_path / "once"))
    assert {r["event_id"] for r in once.collect()} == {i for _, i, _ in want} and once.select("batch").distinct().count() == 1


def test_a_broken_run_goes_on_and_equals_an_undisturbed_one(spark, tmp_path):
    schema = "id long, word string"
    batches = [[(10 * b + i, f"w{(b + i) % 4}") for i in range(8)] for b in range(4)]
    folder = files(spark, str(tmp_path / "in"), batches, schema)
    given = spark.createDataFrame(batches[0], schema).schema
    words = lambda rows: rows.groupBy("word").agg(F.count("*").alias("n"))
    broken = {"left": True}

    def ids(rows):
        if broken["left"] and rows.filter("id >= 20").count():
            raise RuntimeError("lost between two sinks")
        return rows.select("id")

    base = str(tmp_path / "run")
    start = lambda: S.file_stream(spark, folder, given, per_batch=1)
    with pytest.raises(Exception, match="lost between two sinks"):
        S.drain(start(), {"words": words, "ids": ids}, base)
    assert spark.read.parquet(f"{base}/words").select("batch").distinct().count() == spark.read.parquet(f"{base}/ids").select("batch").distinct().count() + 1
    broken["left"] = False
    again = S.drain(start(), {"words": words, "ids": ids}, base)
    whole = S.drain(start(), {"words": words, "ids": ids}, str(tmp_path / "whole"))
    for name in ("words", "ids"):
        assert sorted(map(tuple, again[name].collect())) == sorted(map(tuple, whole[name].collect()))
    assert again["words"].agg(F.sum("n")).first()[0] == 32 == again["ids"].count()
    assert S.drain(start(), {"words": words, "ids": ids}, base)["ids"].count() == 32


def test_cursors_move_only_after_a_complete_read(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    item = lambda n, d: (n, day(d))
    pages = [
        ("whole", 1, 2, True, [item(1, 5), item(2, 1)]), ("whole", 2, 2, True, [item(3, 9)]), ("whole", 2, 2, True, [item(3, 9)]),
        ("gap", 1, 3, True, [item(4, 5)]), ("gap", 3, 3, True, [item(5, 8)]),
        ("broken", 1, 1, False, [item(6, 8)]), ("new", 1, 1, True, [item(7, 2)]), ("empty", 1, 1, True, []), ("old", 1, 1, True, [item(8, 1)]),
    ]
    frame = spark.createDataFrame(pages, "stream string, page int, total int, intact boolean, items array<struct<id:long,updated_at:timestamp>>")
    known = spark.createDataFrame([("whole", day(3)), ("gap", day(3)), ("broken", day(3)), ("empty", day(3)), ("old", day(3)), ("quiet", day(3))], "stream string, since timestamp")
    items, cursors = S.sync_streams(frame, known)
    assert sorted((r["stream"], r["id"]) for r in items.collect()) == [("gap", 4), ("gap", 5), ("new", 7), ("whole", 1), ("whole", 3)]
    assert {r["stream"]: (r["since"], r["complete"]) for r in cursors.collect()} == {"whole": (day(9), True), "gap": (day(3), False), "broken": (day(3), False), "new": (day(2), True), "empty": (day(3), True), "old": (day(3), True), "quiet": (day(3), False)}


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_folder(Session(), "x")
