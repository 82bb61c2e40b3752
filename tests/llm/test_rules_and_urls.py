from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm import quality_rules as Q
from tidewright.llm import url_templates as U


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, odd_docs, labels):
    extra = spark.createDataFrame([(100, "a b c d e f g h " * 5 + "x\nx\ny # | é"), (101, "p q r s t u v w p q r s t u v w p q r s t u v w")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    docs = odd_docs.select("doc_id", "text", "lang").unionByName(extra)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in Q.judge(docs, labels).collect())
    want = sorted((r["doc_id"] or 0, *counted(r["text"])) for r in docs.collect())
    assert got == want


def test_base_test_decides_without_labels(odd_docs, labels):
    rows = Q.judge(odd_docs, labels.limit(0)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert Q.judge(odd_docs.limit(0), labels).count() == 0
    kept = Q.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 4, 8}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 100, 0.01), (3, 700, 0.01), (5, 2000, 0.004), (30, 100, 0.2), (0, 0, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(Q.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("v")).first()["v"]
        want = 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)


def test_certified_cutoff_limits_false_rejection(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(40)), "en") for i in range(1200)]
    bad = [(i, " ".join(f"word{i}### x{k}" for k in range(40)), "en") for i in range(1200, 1400)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 1200).cast("int").alias("quality"))
    rows = Q.judge(docs, labels).collect()
    assert all(r["kept"] for r in rows if r["doc_id"] < 1200)
    assert not any(r["kept"] for r in rows if r["doc_id"] >= 1200)


def test_urls(spark):
    urls = ["http://Shop.Example.com/en/71?x", "https://a.example.com/en/8", "http://x.net/de/8", "http://b.example.net/de/81/z", "ftp://org/es/", "nothing", None, "http://com#/en/", "http://notcom/en/"]
    pages = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, template int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()}
    assert got == {
        0: ("shop.example.com", "/en/71", "example.com/en/7", "allow"), 1: ("a.example.com", "/en/8", "com/en/", "block"), 2: ("x.net", "/de/8", "net/de/", "allow"), 3: ("b.example.net", "/de/81/z", "example.net/de/8", "block"),
        4: ("org", "/es/", "org/es/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("com", "", None, "allow"), 8: ("notcom", "/en/", None, "allow"),
    }
    assert U.filter_urls(pages.limit(0), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def test_bad_template_is_rejected(spark):
    rows = [(i, f"http://site.io/{'spam' if i % 2 else 'news'}/item{i}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select("page_id", (F.col("page_id") % 2 == 1).alias("bad")).filter("page_id < 120")
    out = U.filter_urls(pages, labels).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in out)
    assert {r["template"] for r in out} == {"site.io/spam/*/*", "site.io/news/*/*"}


def test_deep_and_unlabelled_branches_get_their_own_verdict(spark):
    urls = [f"http://site.io/a/b/c/d/{'spam' if i % 2 else 'news'}/x" for i in range(200)] + ["http://bad.io/spam/x"] * 100 + ["http://bad.io/clean/x"] * 50 + ["http://ok.io/x"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = pages.filter("url not like '%clean%'").select("page_id", F.col("url").contains("spam").alias("bad"))
    out = {r["page_id"]: r["verdict"] for r in U.filter_urls(pages, labels).collect()}
    assert all((out[i] == "block") == ("spam" in u) for i, u in enumerate(urls))


def test_repeated_rows_and_copies_of_the_holdout_change_no_cutoff(spark):
    """The bound holds for independent trials only: copies of good rows must not certify a cutoff."""
    good = [(i, f"word{i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en") for i in range(60)]
    bad = [(1000 + i, " ".join(f"b{i}#{k}### $$$" for k in range(40)), "en") for i in range(60)]
    marks = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    schema = "doc_id long, text string, lang string"
    cutoffs = lambda rows, labels: Q.certified_cutoffs(Q.text_counts(spark.createDataFrame(rows, schema).select("doc_id", "text", Q.stratum().alias("stratum"), Q.text_key()), "doc_id", "stratum", "text_key"), labels)
    assert cutoffs(good + bad, marks) == {} == cutoffs(good * 30 + bad * 30, marks)
    copies = [(10_000 + 100 * n + i, t, "en") for n in range(30) for i, t, _ in good]
    more = marks.unionByName(spark.createDataFrame([(i, 1) for i, *_ in copies], "doc_id long, quality int"))
    assert cutoffs(good + bad + copies, more) == {}
    many = [(100_000 + i, f"other{i} " + " ".join(f"v{i}x{k}" for k in range(25)), "en") for i in range(1500)]
    sure = marks.unionByName(spark.createDataFrame([(i, 1) for i, *_ in many], "doc_id long, quality int"))
    assert cutoffs(good + bad + many, sure) != {}
