from __future__ import annotations

import datetime as dt
import itertools
import random
from collections import deque

from pyspark.sql import functions as F

from tidewright.operators import traversal as V

EDGE = "src long, dst long, confidence double, valid_from timestamp, valid_to timestamp"
DAY = dt.datetime(2024, 1, 10)


def walk(seeds, edges, hops, fanout, most):
    """One query after the other, with dictionaries."""
    best = {}
    for s, d, c, start, end in edges:
        c = 0.5 if c is None else c
        if c >= 0.2 and (start is None or start <= DAY) and (end is None or end > DAY):
            best[s, d] = max(c, best.get((s, d), 0))
    out = {}
    for q in {q for q, _ in seeds}:
        score, first = {n: 1.0 for p, n in seeds if p == q}, {n: 0 for p, n in seeds if p == q}
        front = list(score)
        for hop in range(1, hops + 1):
            given = {}
            for n in front:
                for c, d in sorted(((c, d) for (s, d), c in best.items() if s == n), key=lambda x: (-x[0], x[1]))[:fanout]:
                    given[d] = given.get(d, 0) + score[n] * c * 0.6**hop
            front = [d for d in given if d not in score]
            for d, g in given.items():
                first.setdefault(d, hop)
                score[d] = score.get(d, 0) + g
        for n in sorted(score, key=lambda n: (-round(score[n], 9), n))[:most]:
            out[q, n] = (first[n], round(score[n], 9))
    return out


def test_path_scores_match_a_plain_walk(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(12), rng.randrange(12), rng.choice([None, 0.1, 0.3, 0.7, 0.9, 1.0]), rng.choice([None, DAY - dt.timedelta(2), DAY + dt.timedelta(2)]), rng.choice([None, None, DAY, DAY + dt.timedelta(1)])) for _ in range(120)]
    seeds = [(1, 0), (1, 3), (2, 5), (2, 5), (3, 99)]
    frame = spark.createDataFrame(edges + [(None, 1, 0.9, None, None)], EDGE)
    for hops, fanout, most in ((1, 3, 100), (3, 3, 100), (4, 2, 6)):
        got = V.path_scores(spark.createDataFrame(seeds, "query_id long, node long"), frame, hops, fanout, most, 0.2, F.lit(DAY))
        assert {(r["query_id"], r["node"]): (r["hop"], round(r["score"], 9)) for r in got.collect()} == walk(seeds, edges, hops, fanout, most)
    empty = spark.createDataFrame([], "query_id long, node long")
    assert V.path_scores(empty, frame, 2).collect() == []


def passes(nodes, edges, sources):
    """Shortest paths counted between all pairs, the searches of ``sources`` alone."""
    near = {n: sorted({d for s, d in edges if s == n and d != n}) for n in nodes}
    total = dict.fromkeys(nodes, 0.0)

    def search(s):
        dist, count, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    count[y] = 0
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    count[y] += count[x]
        return dist, count

    found = {n: search(n) for n in nodes}
    for s in sources:
        for t, v in itertools.product(nodes, nodes):
            if len({s, t, v}) == 3 and t in found[s][0] and v in found[s][0] and t in found[v][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]:
                total[v] += found[s][1][v] * found[v][1][t] / found[s][1][t]
    n = len(nodes)
    return {v: x * 0.5 * (n / len(sources)) / ((n - 1) * (n - 2) / 2) for v, x in total.items()}


def test_betweenness_matches_paths_counted_by_hand(spark):
    rng = random.Random(9)
    for n, m in ((4, 3), (9, 12), (14, 22), (6, 0)):
        one = {tuple(rng.sample(range(n), 2)) for _ in range(m)}
        edges = [e for a, b in one for e in ((a, b), (b, a))]
        nodes = list(range(n))
        frame = spark.createDataFrame([(x,) for x in nodes], "node long")
        both = spark.createDataFrame(edges + edges[:2] + [(1, 1)], "src long, dst long")
        for sample in (None, max(1, n // 3)):
            size = sample or n
            sources = [nodes[int(i * n / size)] for i in range(size)]
            got = {r["node"]: round(r["centrality"], 9) for r in V.betweenness(frame, both, sample).collect()}
            assert got == {k: round(v, 9) for k, v in passes(nodes, edges, sources).items()}
    assert [r["centrality"] for r in V.betweenness(frame.limit(2), both).collect()] == [0.0, 0.0]


def test_numbers_follow_the_order(spark):
    rows = [(random.Random(i).randrange(10**6),) for i in range(500)]
    got = V.numbered(spark.createDataFrame(rows, "k long").distinct().repartition(7), "k").collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["number"])] == sorted({k for (k,) in rows})
    assert sorted(r["number"] for r in got) == list(range(len(got)))
