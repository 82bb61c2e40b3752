"""Names, phrases, collapse and packs against plain definitions."""

from __future__ import annotations

import random

import pytest

from tidewright.operators import context, phrases
from tidewright.operators import similarity as S


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_common_length_equals_the_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randrange(0, 90))) for _ in range(2))
        assert S.common_length(a, b) == table_length(a, b)


def test_measures_of_names():
    assert S.ratio("apple", "aple") == pytest.approx(800 / 9) and S.ratio("", "") == 100
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro_winkler("abc", "xyz") == 0
    assert S.token_set("apple", "apple bakery") == 100 and S.token_set("", "a") == 0
    assert S.coverage(["apple"], ["apple", "bakery"]) == pytest.approx(2 / 3)
    assert S.similarity("acme cloud", "acme cloud") == 1 and S.similarity("", "a") is None and S.similarity(None, "a") is None
    assert S.similarity("apple", "apple bakery") < 0.75 < S.similarity("datadog", "datadg")


def test_similarity_columns(spark):
    rows = spark.createDataFrame([("apple", "apple bakery"), (None, "x"), ("a b", "b a")], "a string, b string")
    got = rows.select(S.name_similarity(rows.a, rows.b).alias("s"), S.token_coverage(rows.a, rows.b).alias("c")).collect()
    assert got[1]["s"] is None and got[1]["c"] == 0 and got[0]["c"] == pytest.approx(2 / 3) and got[2]["c"] == 1


def test_phrases_and_keywords(spark):
    docs = spark.createDataFrame([(1, "The contract renewal of Datadog, Grafana\nCloud suite plan 42 x renewal"), (2, None), (3, "the of")], "doc_id long, text string")
    found = phrases.candidate_phrases(docs, ["the", "of"])
    got = sorted((r["at"], r["surface"]) for r in found.collect())
    assert got == [(0, "contract renewal"), (1, "Datadog"), (2, "Grafana Cloud suite"), (3, "plan"), (4, "renewal")]
    scores = {r["word"]: r["score"] for r in phrases.word_scores(found).collect()}
    assert scores["renewal"] == 1.5 and scores["contract"] == 2 and scores["cloud"] == 3
    terms = [(r["term"], r["weight"]) for r in phrases.keywords(found).orderBy("position").collect()]
    assert terms[0] == ("Grafana Cloud suite", 1.0) and terms[1] == ("contract renewal", round(3.5 / 9, 4)) and len(terms) == 5
    named = spark.createDataFrame([(1, "Datadog"), (1, " ")], "doc_id long, surface string")
    assert {r["term"]: r["weight"] for r in phrases.keywords(found, named).collect()}["Datadog"] == round(1.5 / 9, 4)


def test_scored_phrases_give_the_same_keywords_and_travel_once(spark):
    rng = random.Random(8)
    words = ["Cloud", "cloud", "the", "x", "Été", "data-lake", "plan", "42", "PLAN", "renewal"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(rng.randrange(0, 120)))) for i in range(30)] + [(30, None), (31, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, phrases.keywords(phrases.candidate_phrases(docs, ["the"])).collect()))
    mine = phrases.keywords(phrases.scored_phrases(docs, ["the"]))
    assert len(want) > 100 and sorted(map(tuple, mine.collect())) == want
    assert mine._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_collapse_keeps_the_first(spark):
    rows = [(1, 10, 1, 0b1111), (1, 11, 2, 0b1110), (1, 12, 3, None), (1, 13, 4, 0b11110000), (1, 14, 5, -1), (2, 11, 1, 0b1110)]
    pool = spark.createDataFrame(rows, "query_id long, chunk_id long, rank long, print long")
    got = sorted(tuple(r) for r in context.collapse_near_duplicates(pool).collect())
    assert got == [(1, 10, 1, 1), (1, 12, 3, 0), (1, 13, 4, 0), (1, 14, 5, 0), (2, 11, 1, 0)]


def test_fill_passes_over_what_is_too_long():
    assert context.fill([5, 9, 3, 2], 10) == ([0, 2, 3], 0)
    assert context.fill([5, 4, 3], 9, ["x", "x", "y"]) == ([0, 2], 1)
    assert context.fill([20, 4, 3], 9, ["x", "x", "y"]) == ([1, 2], 2)


def test_pack_gives_facts_their_share(spark):
    passages = spark.createDataFrame([(1, 1, 7, 0.9, 60), (1, 2, 7, 0.8, 25), (1, 3, 8, 0.1, 20)], "query_id long, id long, signal long, score double, cost long")
    facts = spark.createDataFrame([(1, 1, 0.5, False, 10), (1, 2, 0.5, True, 10), (2, 9, 0.1, True, 15)], "query_id long, id long, score double, current boolean, cost long")
    got = {(r["query_id"], r["kind"], r["id"]) for r in context.pack_evidence(passages, facts, 100).collect()}
    assert got == {(1, "fact", 2), (1, "passage", 1), (1, "passage", 3), (2, "fact", 9)}


def test_budgets_filled_on_arrays_are_those_of_the_walk(spark):
    rng = random.Random(5)
    rows = [(q, i, rng.choice([1, 2, 3, None]), rng.choice([None, 0.0, 0.3, 0.5, 0.9]), rng.randint(0, 9)) for q in range(60) for i in range(rng.randrange(1, 14))]
    frame = spark.createDataFrame(rows, "query_id long, id long, signal long, score double, cost long")
    for breadth in (True, False):
        got, want = {(r["query_id"], r["id"]) for r in context.fill_rows(frame, 20, breadth).collect()}, set()
        for q in range(60):
            own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[3] is None, -(r[3] or 0), r[1]))
            kept, _ = context.fill([r[4] for r in own], 20, [object() if r[2] is None else r[2] for r in own] if breadth else None)
            want |= {(q, own[i][1]) for i in kept}
        assert got == want
    plan = context.fill_rows(frame, 20, True)._jdf.queryExecution().toString()
    assert "Pandas" not in plan
