from __future__ import annotations

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import names, records, scoring, text
from tidewright.operators.chunking import split_text
from tidewright.operators.dedup import fingerprint


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_scores(spark):
    got = values(spark, [(1.0, None), (None, None), (0.2, 0.6)], "a double, b double", scoring.weighted_mean_of_present({"a": F.col("a"), "b": F.col("b")}, {"a": 0.25, "b": 0.75}))
    assert got == [(1.0,), (None,), (pytest.approx(0.5),)]
    parts = {k: F.col("x") for k in scoring.CONFIDENCE_WEIGHTS}
    assert values(spark, [(1.0,), (0.0,)], "x double", scoring.compose_confidence(parts)) == [(1.0,), (0.05,)]
    assert values(spark, [(None,), (8,), (1,)], "n int", scoring.corroboration(F.col("n"))) == [(0.315465,), (1.0,), (0.315465,)]


def test_record_fields(spark):
    rows = [('{"a": {"b": " "}, "c": [1, 2]}',), ("{}",), (None,)]
    assert values(spark, rows, "p string", records.first_value(F.col("p"), ["a.b", "c[1]"], "d")) == [("2",), ("d",), ("d",)]
    assert values(spark, [("1.2.3",), ("1.2",), ("x",), (None,)], "v string", records.version_ordinal(F.col("v"))) == [(1002003,), (0,), (0,), (0,)]
    times = ["1700000000", "1700000000000", "2023-11-14T22:13:20Z", "20231114T221320Z", "Tue, 14 Nov 2023 22:13:20 +0000", "no"]
    assert values(spark, [(t,) for t in times], "t string", F.unix_timestamp(records.to_instant(F.col("t")))) == [(1700000000,)] * 5 + [(None,)]
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    for name in ("a", "web:é", ""):
        assert values(spark, [(name,)], "n string", records.named_id(ns, F.col("n"))) == [(uuid.uuid5(uuid.UUID(ns), name).hex,)]


def test_urls_and_names(spark):
    cases = {"HTTP://Ex.com:80/a?b=1&utm_source=x&a=2#f": "http://ex.com/a?a=2&b=1", "https://ex.com": "https://ex.com/", "https://ex.com:443/?fbclid=1": "https://ex.com/", "relative": ""}
    for url, want in cases.items():
        assert values(spark, [(url,)], "u string", text.canonical_url(F.col("u"))) == [(want,)]
    legal = ["inc", "company"]
    for name, want in {"The Foo & Bar, Inc.": "foo and bar", "Zoë's Kitchen": "zoës kitchen", "The Company": "company", "  ": ""}.items():
        assert values(spark, [(name,)], "n string", names.normalize_name(F.col("n"), legal)) == [(want,)]
    for t, want in {"Привет a": "Cyrl", "かな漢字": "Jpan", "123": None, "漢字": "Hani"}.items():
        assert values(spark, [(t,)], "t string", names.dominant_script(F.col("t"))) == [(want,)]


def test_fingerprints():
    base = " ".join(f"w{i}" for i in range(200))
    assert fingerprint("") == 0 and fingerprint(None) == 0
    assert fingerprint(base) == fingerprint(base.upper() + "​")
    assert bin((fingerprint(base) ^ fingerprint(base.replace("w7 ", "x7 "))) & (2**64 - 1)).count("1") < 20


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_chunks_cover_the_text(t, most, overlap):
    spans = split_text(t, most, overlap)
    assert all(0 <= s < e <= len(t) and e - s <= most for s, e in spans)
    covered = {i for s, e in spans for i in range(s, e)}
    assert all(i in covered for i, c in enumerate(t) if not c.isspace())
    assert all(b[0] >= a[1] - overlap - most // 4 for a, b in zip(spans, spans[1:]))
