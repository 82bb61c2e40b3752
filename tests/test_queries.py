"""Queries against DuckDB on the driver's smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TIDEWRIGHT_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from tidewright.plans import registry  # noqa: E402

registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if "float" in str(frame[c].dtype).lower() or "int" in str(frame[c].dtype).lower():
            frame[c] = frame[c].astype(float).round(6)
        elif "datetime" in str(frame[c].dtype):
            frame[c] = frame[c].astype("datetime64[us]")
    frame = frame.astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_components_equal_union_find(spark, duck):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for order, part in duck.execute("select l_orderkey, l_partkey from lineitem").fetchall():
        a, b = root((0, order)), root((1, part))
        parent[max(a, b)] = min(a, b)
    want = {x[1]: root(x)[1] for x in list(parent) if x[0] == 0}
    got = {r["node"]: r["component"] for r in entry.queries()["g29_components"](spark, SF).collect()}
    assert got == want


def test_filters_reach_the_scan(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    plan = entry.queries()["f01_metadata_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed, schema = plan.split("PushedFilters:")[1].split("ReadSchema:")[:2]
    assert "In(source" in pushed and "GreaterThanOrEqual(n_chars" in pushed
    assert "text" not in schema


def least_peak(spark, query, folder):
    """Rows that the largest join of a query makes, by its plan's counters."""
    df = entry.queries()[query](spark, folder)
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
            continue
        if "QueryStage" in plan.nodeName():
            todo.append(plan.plan())
        counted = plan.metrics().get("numOutputRows")
        if "Join" in plan.nodeName() and counted.isDefined():
            most = max(most, counted.get().value())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def test_suggestions_meet_one_customer_of_a_handle(spark, tmp_path):
    spark.range(50).selectExpr("id s_suppkey", "cast(id % 3 as int) s_nationkey", "'s-007' s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(400).selectExpr("399 - id c_custkey", "cast(id % 2 as int) c_nationkey", "'c-007' c_name").write.parquet(f"{tmp_path}/customer.parquet")
    rows = entry.queries()["j05_best_suggestion"](spark, str(tmp_path)).collect()
    assert {r["s_suppkey"]: (r["c_custkey"], r["confidence"]) for r in rows} == {s: ({0: 1, 1: 0, 2: 0}[s % 3], 0.6 if s % 3 == 2 else 0.9) for s in range(50)}
    assert least_peak(spark, "j05_best_suggestion", str(tmp_path)) <= 400


def test_terms_meet_once_a_word(spark, tmp_path):
    spark.range(300).selectExpr("id p_partkey", "concat('red item', id) p_name", "if(id % 2 = 0, 'RED', 'BLUE') p_type").write.parquet(f"{tmp_path}/part.parquet")
    rows = entry.queries()["j06_feature_terms"](spark, str(tmp_path)).collect()
    assert {r["p_partkey"]: (r["term"], r["method"]) for r in rows} == {i: ("red item0", i % 2) for i in range(300)}
    assert least_peak(spark, "j06_feature_terms", str(tmp_path)) <= 600
