"""Refined components, keys, hints, depths and readers of pages against plain definitions."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import entities as E
from tidewright.functions.records import json_depth
from tidewright.operators import context, refine
from tidewright.sources import repository as R


def joined_by_definition(members, score, floor):
    """Means taken anew over all pairs of two parts in every round."""
    parts = [(m,) for m in sorted(members)]
    while True:
        best = []
        for a, b in itertools.combinations(sorted(parts), 2):
            mean = sum(score.get((min(x, y), max(x, y)), 0.0) for x in a for y in b) / (len(a) * len(b))
            if mean >= floor:
                best.append((-round(mean, 9), sorted(a + b), a, b))
        if not best:
            return sorted(parts)
        _, both, a, b = min(best)
        parts = [p for p in parts if p not in (a, b)] + [tuple(both)]


@pytest.mark.parametrize("seed", range(12))
def test_average_linkage_equals_its_definition(seed):
    rng = random.Random(seed)
    members = rng.sample(range(100), rng.randrange(1, 12))
    score = {p: rng.choice([0.95, 0.8, 0.5, 0.1]) for p in itertools.combinations(sorted(members), 2) if rng.random() < 0.7}
    assert refine.average_linkage(members, [(*p, s) for p, s in score.items()]) == joined_by_definition(members, score, refine.FLOOR)


def test_components_split_and_large_ones_stay(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9), *[(i, 20) for i in range(20, 26)]], "node long, component long")
    scores = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.95), (1, 3, 0.1), (1, 20, 0.99)], "u long, v long, score double")
    got = {r["node"]: (r["component"], r["part"]) for r in refine.split_components(members, scores, most=5).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 9: (9, 9), **{i: (20, 20) for i in range(20, 26)}}
    assert refine.split_components(members.limit(0), scores).count() == 0


def test_large_components_split_as_their_definition_says(spark, monkeypatch):
    rng = random.Random(8)
    members, scores, want = [], [], {}
    for component in (0, 100, 200, 300):
        own = range(component, component + rng.randrange(20, 45))
        score = {p: rng.choice([1.0, 0.95, 0.8, 0.5, 0.1]) for p in itertools.combinations(own, 2) if rng.random() < component / 500 + 0.1}
        members += [(m, component) for m in own]
        scores += [(*rng.sample(p, 2), s) for p, s in score.items()]
        want |= {m: (component, part[0]) for part in joined_by_definition(own, score, refine.FLOOR) for m in part}
    members.append((999, 999))
    frames = spark.createDataFrame(members, "node long, component long"), spark.createDataFrame(scores, "u long, v long, score double")
    assert 50 < len(set(want.values())) < len(want)
    for cell in (refine.CELL, 15):
        monkeypatch.setattr(refine, "CELL", cell)
        got = {r["node"]: (r["component"], r["part"]) for r in refine.refined_components(*frames, most=22).collect()}
        assert got == want | {999: (999, 999)}


def test_depth_of_json(spark):
    raws = ['{"a": {"b": [1, {"c": "]}{["}]}}', "[]", "3", '"\\"["', '{"a": "\\\\"}', None, '{"k": "' + '\\"x[' * 20000 + '"}']
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string").orderBy("i").select(json_depth(F.col("raw"))).collect()]
    assert got == [4, 1, 0, 0, 1, None, 1]


def test_keys_of_vectors(spark):
    nan = float("nan")
    vectors = [[1.0, 2.0, -3.0], [2.0, 4.0, -6.0], [-1.0, -2.0, 3.0], [0.0, 0.0, 0.0], [], None, [1.0, nan, 2.0], [1.0, None, 2.0]]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<float>").coalesce(1).orderBy("i").select(E.plane_keys(F.col("v"))).collect()]
    assert got[0] == got[1] and [k[:2] for k in got[0]] == ["0:", "1:", "2:", "3:"] and all(len(k) == 10 for k in got[0])
    assert all({x, y} == {"0", "1"} for a, b in zip(got[0], got[2]) for x, y in zip(a[2:], b[2:]))
    assert got[3:] == [[]] * 5


def test_types_and_hints(spark):
    rows = spark.createDataFrame([(" GPE ", " Acme, Inc. ", ["acme", "a sentence of words", "Acme_2"]), ("company", "!!", None), (None, None, ["x"] * 3), ("launch", "a", ["b", "c", "d", "e"])], "kind string, surface string, proposed array<string>")
    got = [tuple(r) for r in rows.select(E.entity_type(F.col("kind")), E.lookup_hints(F.col("surface"), F.col("proposed"))).collect()]
    assert got == [("Region", ["ent_acme_inc", "acme", "acme_2"]), ("Company", []), ("Unknown", ["x"]), ("Event", ["ent_a", "b", "c", "d"])]


def test_pages_are_read(spark):
    pull = lambda n, at, merged=None: {"number": n, "title": "t", "state": "open", "user": {"login": "u"}, "updated_at": at, "merged_at": merged, "more": 1}
    pages = spark.createDataFrame([("1", json.dumps([pull(1, "2024-01-02T00:00:00Z"), pull(2, "2024-01-01T00:00:00Z"), pull(3, None, "2024-01-01T00:00:00Z")])), ("2", "{broken"), ("3", "[]"), ("4", None)], "scope string, raw string")
    pulls = R.pull_requests(pages, "2024-01-01T00:00:00Z")
    assert sorted((r["number"], r["merged"]) for r in pulls.collect()) == [(1, False), (3, True)]
    assert R.pull_requests(pages).count() == 3
    asked = spark.createDataFrame([("1", json.dumps([{"id": 7, "state": "APPROVED", "user": None}])), ("2", json.dumps([{"id": 8}]))], "scope string, raw string")
    assert [(r["number"], r["review_id"], r["reviewer"]) for r in R.reviews(asked, pulls).collect()] == [(1, 7, None)]
    runs = R.workflow_runs(spark.createDataFrame([("r", json.dumps({"workflow_runs": [{"id": 1, "conclusion": "success"}, {"id": 2, "conclusion": "failure"}, {"id": 3}]}))], "scope string, raw string"))
    jobs = spark.createDataFrame([(str(i), json.dumps({"jobs": [{"id": i * 10, "name": "j", "conclusion": "failure", "steps": [{"name": "a", "conclusion": "success"}, {"name": "b", "conclusion": "failure"}]}]})) for i in (1, 2, 3)], "scope string, raw string")
    assert sorted((r["run_id"], r["failed_step"], r["n_steps"]) for r in R.run_jobs(jobs, runs).collect()) == [(2, "b", 2), (3, "b", 2)]


def test_rows_fill_a_budget(spark):
    rows = spark.createDataFrame([(1, 1, 5, 0.9, 4), (1, 2, 5, 0.8, 4), (1, 3, 6, 0.7, 4), (1, 4, 7, 0.1, 1), (2, 9, 5, 0.5, 99)], "query_id long, id long, signal long, score double, cost long")
    assert sorted(r["id"] for r in context.fill_rows(rows, 9, True).collect()) == [1, 3, 4]
    assert sorted(r["id"] for r in context.fill_rows(rows, 9, False).collect()) == [1, 2, 4]
