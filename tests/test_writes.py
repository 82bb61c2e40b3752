from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidewright.operators.graph import pagerank
from tidewright.operators.joins import block_pairs
from tidewright.operators.merge import edge_key, upsert_edges
from tidewright.plans.writes import scrubbed

DAY = dt.datetime(2024, 3, 1, 12)


def test_edge_keys_have_one_direction_where_the_kind_has_none(spark):
    rows = [("R", "b", "a", DAY, "e"), ("R", "a", "b", DAY, "e"), ("M", "b", "a", DAY, None), ("M", "a", "b", DAY, None), ("R", "a", "b", DAY + dt.timedelta(1), "e")]
    frame = spark.createDataFrame(rows, "k string, s string, d string, f timestamp, e string")
    got = [r[0] for r in frame.select(edge_key(*map(F.col, "ksdfe"), ["R"])).collect()]
    plain = lambda *parts: hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32]
    first = "2024-03-01T12:00:00.000000+00:00"
    assert got == [plain("R", "a", "b", first, "e")] * 2 + [plain("M", "b", "a", first, ""), plain("M", "a", "b", first, ""), plain("R", "a", "b", "2024-03-02T12:00:00.000000+00:00", "e")]


def test_edges_count_a_replayed_batch_once(spark):
    batch = lambda *rows: spark.createDataFrame(rows, "edge_key string, new_evidence int, confidence double, valid_from timestamp, observed_at timestamp")
    stored = spark.createDataFrame([], "edge_key string, evidence_count long, confidence double, valid_from timestamp, observed_at timestamp, last_batch_id string")
    day = lambda n: DAY + dt.timedelta(n)
    one, two = batch(("a", 2, 0.5, day(0), day(1)), ("a", 1, 0.7, day(-1), day(2)), ("b", 1, None, day(0), day(0))), batch(("a", 4, 0.1, day(-5), day(3)))
    for rows, name in ((one, "1"), (one, "1"), (two, "2"), (two, "2")):
        stored = upsert_edges(stored, rows, name)
    got = {r["edge_key"]: r for r in stored.collect()}
    assert (got["a"]["evidence_count"], got["a"]["confidence"], got["a"]["valid_from"], got["a"]["observed_at"], got["a"]["last_batch_id"]) == (7, 0.1, day(-1), day(3), "2")
    assert (got["b"]["evidence_count"], got["b"]["last_batch_id"]) == (1, "1")


def test_scrubbing_leaves_no_hidden_mark(spark):
    texts = {"a\tb\r\nc\x00\x0b\x7f": "a\tb\r\nc", "x TOOL_UNTRUSTED_DATA y": "x [redacted-fence-token] y", "tool_\x00end_untrusted\x01_data": "[redacted-fence-token]", "untrusted_data": "untrusted_data"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scrubbed(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == texts


def test_only_broad_blocks_are_left_out(spark):
    rows = spark.createDataFrame([(i, ["b:1", f"x:{i % 2}"]) for i in range(6)], "id long, keys array<string>")
    assert {tuple(r) for r in block_pairs(rows, "id", F.col("keys"), 3, lambda k: k.startswith("b:")).collect()} == {(0, 2), (0, 4), (2, 4), (1, 3), (1, 5), (3, 5)}
    assert block_pairs(rows, "id", F.col("keys"), 2).collect() == []


def test_personal_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    one = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0)]
    both = spark.createDataFrame(one + [(b, a, w) for a, b, w in one], "src long, dst long, weight double")
    start = [0.25, 0.0, 0.0, 0.75, 0.0]
    rank, links = [0.2] * 5, {}
    for a, b, w in one:
        links.setdefault(a, []).append((b, w))
        links.setdefault(b, []).append((a, w))
    for _ in range(60):
        got, loose = [0.0] * 5, 0.0
        for n, r in enumerate(rank):
            if n not in links:
                loose += r
            for m, w in links.get(n, []):
                got[m] += r * w / sum(x for _, x in links[n])
        rank = [0.15 * start[n] + 0.85 * (got[n] + loose * start[n]) for n in range(5)]
    mine = {r["node"]: r["rank"] for r in pagerank(nodes, both, 60, teleport=spark.createDataFrame([(0, 1.0), (3, 3.0), (9, 5.0), (2, -1.0)], "node long, weight double")).collect()}
    assert [round(mine[n], 9) for n in range(5)] == [round(x, 9) for x in rank]
    with pytest.raises(ValueError, match="nowhere"):
        pagerank(nodes, both, 3, teleport=spark.createDataFrame([(9, 1.0)], "node long, weight double"))
