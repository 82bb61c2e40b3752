from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators.dedup import near_pairs, simhash_clusters, spread_minimum
from tidewright.operators.filters import Filters, compile_filters, keyset_after
from tidewright.operators.graph import conductance, modularity, neighbourhood, pagerank, project
from tidewright.operators.joins import block_pairs, overlap_join
from tidewright.operators.merge import upsert_guarded, upsert_last, upsert_nodes
from tidewright.operators.ranking import counted_metrics, reciprocal_rank_fusion, retrieval_metrics
from tidewright.operators.temporal import merge_intervals
from tidewright.sources.archive import compression_of, read_archive, write_archive


def two_cliques(spark):
    edges = [(a, b, 1.0, 1) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 1.0, 1), (2, 2, 1.0, 5)]
    return project(spark.createDataFrame(edges, "src int, dst int, confidence double, evidence int"))


def test_graph(spark):
    both = two_cliques(spark)
    assert both.count() == 42
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15), 99]], "node int")
    ranks = {r["node"]: r["rank"] for r in pagerank(nodes, both, rounds=60, tolerance=1e-9).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks[4] == pytest.approx(ranks[10]) and ranks[99] == min(ranks.values())
    member = nodes.filter("node < 20").withColumn("community", F.floor(F.col("node") / 10))
    q = modularity(both, member).first()["modularity"]
    assert q == pytest.approx(2 * (20 / 42 - (21 / 42) ** 2))
    out = {r["community"]: r for r in conductance(both, member).collect()}
    assert out[0]["conductance"] == pytest.approx(1 / 21)
    hops = {r["node"]: r["hop"] for r in neighbourhood(nodes.filter("node = 0"), both, 2, 10).collect()}
    assert hops == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 10: 2}


def test_intervals(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("a", day(1), day(3)), ("a", day(3), day(5)), ("a", day(7), None), ("a", day(9), day(10)), ("b", day(1), day(2))]
    df = spark.createDataFrame(rows, "k string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = sorted(((r["k"], r["valid_from"], r["valid_to"], r["assertions"]) for r in merge_intervals(df, ["k"]).collect()), key=str)
    assert got == [("a", day(1), day(5), 2), ("a", day(7), None, 2), ("b", day(1), day(2), 1)]
    side = lambda p: spark.createDataFrame([("k", day(1), day(20)), ("k", day(25), day(26))], f"k string, {p}_start timestamp_ntz, {p}_end timestamp_ntz")
    assert overlap_join(side("l"), side("r"), "k", 3).count() == 2


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.9), (3, None, 0.9)], "id int, s string, c double")
    assert [r["id"] for r in df.filter(compile_filters(Filters(any_of={"s": ["b", "a"]}, at_least={"c": 0.6}))).collect()] == [2]
    assert df.filter(compile_filters(Filters())).count() == 3
    with pytest.raises(ValueError):
        compile_filters(Filters(any_of={"s": [" "]}))
    assert [r["id"] for r in df.filter(keyset_after([("c", 0.9), ("id", 3)])).orderBy("id").collect()] == [1, 2]


def test_fusion_does_not_depend_on_order(spark):
    rows = [("keyword", "x", 1), ("vector", "x", 2), ("graph", "y", 1), ("vector", "y", 1)]
    schema = "backend string, chunk_id string, rank int"
    a = reciprocal_rank_fusion(spark.createDataFrame(rows, schema)).orderBy("chunk_id").collect()
    b = reciprocal_rank_fusion(spark.createDataFrame(rows[::-1], schema)).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], round(r["score"], 12)) for r in a] == [(r["chunk_id"], round(r["score"], 12)) for r in b] == [("x", round(1 / 61 + 1 / 62, 12)), ("y", round(1.8 / 61, 12))]


def test_metrics(spark):
    rows = [("q", 1, 3), ("q", 2, 0), ("q", 3, 1), ("q", None, 2), ("none", 1, 0)]
    out = {(r["query_id"], r["k"]): r for r in retrieval_metrics(spark.createDataFrame(rows, "query_id string, rank int, grade int"), [1, 3]).collect()}
    assert out["q", 3]["precision"] == pytest.approx(2 / 3) and out["q", 3]["recall"] == pytest.approx(2 / 3)
    assert out["q", 3]["average_precision"] == pytest.approx((1 + 2 / 3) / 3)
    assert (out["none", 1]["recall"], out["none", 1]["ndcg"], out["none", 1]["reciprocal_rank"]) == (1.0, 1.0, 0.0)


def test_merges(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "id int, v int, s string")
    new = spark.createDataFrame([(1, 4, "x"), (2, 1, "y"), (3, 1, "z")], "id int, v int, s string")
    assert sorted((r["id"], r["s"]) for r in upsert_guarded(old, new, ["id"], "v").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted((r["id"], r["v"], r["s"]) for r in upsert_last(old, new, "id", ["v"]).collect()) == [(1, 5, "x"), (2, 1, "y"), (3, 1, "z")]
    n = "id int, first_seen int, last_seen int, source_count long"
    got = upsert_nodes(spark.createDataFrame([(1, 3, 4, 2)], n), spark.createDataFrame([(1, 1, 2, 1), (2, 5, 5, 1)], n)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 4, 3), (2, 5, 5, 1)]


def test_blocks_and_components(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b", "b"]), (4, ["c"])], "id int, keys array<string>")
    assert sorted(map(tuple, block_pairs(df, "id", F.col("keys")).collect())) == [(1, 2), (1, 3)]
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    labels = {r["node"]: r["label"] for r in spread_minimum(nodes, pairs).collect()}
    assert labels == {i: 0 if i <= 40 else i for i in range(60)}


def test_simhash(spark):
    prints = spark.createDataFrame([(0b1011,), (0b1000,), (-1,), (2**40,)], "print long")
    assert sorted(map(tuple, near_pairs(prints).collect())) == [(8, 11), (8, 2**40)]
    docs = spark.createDataFrame([(1, "one two three four"), (2, "ONE two  three four"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, simhash_clusters(docs).collect())) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)]


def test_archive(spark, tmp_path):
    rows = spark.createDataFrame([("web", "1", bytearray(b"\x1f\x8b\x00")), ("web", "2", bytearray(b"plain"))], "platform string, item string, raw binary")
    kept = read_archive(spark, write_archive(rows, str(tmp_path / "archive"))).withColumn("codec", compression_of(F.col("raw")))
    assert sorted((r["item"], r["intact"], r["codec"]) for r in kept.collect()) == [("1", True, "gzip"), ("2", True, "none")]


def test_metrics_need_counts_alone_of_what_is_not_returned(spark):
    returned = spark.createDataFrame([("q", 1, 3), ("q", 2, 0), ("q", 3, 1)], "query_id string, rank int, grade int")
    grades = spark.createDataFrame([("q", 0, 10**12), ("q", 1, 1), ("q", 2, 1), ("q", 3, 1), ("none", 0, 5)], "query_id string, grade int, n long")
    out = {(r["query_id"], r["k"]): r for r in counted_metrics(returned, grades, [1, 3]).collect()}
    assert out["q", 3]["recall"] == pytest.approx(2 / 3) and out["q", 3]["average_precision"] == pytest.approx((1 + 2 / 3) / 3)
    assert out["q", 3]["ndcg"] == pytest.approx((7 + 1 / 2) / (7 + 3 / np.log2(3) + 1 / 2))
    assert (out["none", 1]["recall"], out["none", 1]["ndcg"], out["none", 1]["precision"]) == (1.0, 1.0, 0.0)


def test_components_of_any_shape_and_pairs_that_vanish(spark, monkeypatch):
    import random

    from tidewright.operators import dedup, graph

    rng = random.Random(6)
    stored = []
    monkeypatch.setattr(dedup, "shared_table", lambda df, name: (made := graph.shared_table(df, name), stored.append((name, made.count())))[0])
    line, star = [(i, i + 1) for i in range(100, 160)], [(900, i) for i in range(200, 240)]
    zigzag = [(400 + (i * 37) % 61, 400 + ((i + 1) * 37) % 61) for i in range(60)]
    loose = [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(70)]
    pairs = line + star + zigzag + loose + [(5, 5), (7, 6), (6, 7), (7, 6)]
    parent = {i: i for i in range(1000)}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(1000).withColumnRenamed("id", "node")
    got = dict(map(tuple, dedup.spread_minimum(nodes, spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert got == {i: root(i) for i in range(1000)}
    edges = [n for name, n in stored if name == "pairs"]
    assert edges[0] <= len(pairs) and edges[1] < edges[0] / 2 and edges[-1] == 0
    assert dict(map(tuple, dedup.spread_minimum(nodes.limit(3), spark.createDataFrame([], "u long, v long")).collect())) == {0: 0, 1: 1, 2: 2}
