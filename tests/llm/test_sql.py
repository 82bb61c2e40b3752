"""The operators that SQL can express, against DuckDB on the driver's smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidewright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
