from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import periodic_runs as R
from tidewright.llm import svd_whitening as W


def all_runs(w, least=2, copies=2):
    """Every period, every maximal stretch; a stretch counts with its smallest period."""
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= 2 * p:
                best.setdefault((s, i + p - s), p)
    return sorted((s, n, p) for (s, n), p in best.items() if n >= max(least, copies * p))


def strings(rng, count, most):
    for _ in range(count):
        n, k = rng.randint(0, most), rng.choice([1, 2, 2, 3, 30])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            if n > 3:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = w[:a] + [w[a + i % p] for i in range(n - a)]
                if rng.random() < 0.6:
                    w[rng.randrange(n)] = rng.randrange(k + 1)
        yield w


def test_next_smaller_suffixes_and_their_matches():
    for w in strings(random.Random(3), 1500, 40):
        nss, shared = R.next_smaller(w)
        for i in range(len(w)):
            r = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            assert nss[i] == r
            assert shared[i] == next((k for k in range(len(w) - r) if w[i + k] != w[r + k]), len(w) - r)


def test_runs_match_brute_force():
    for w in strings(random.Random(4), 1500, 45):
        assert R.runs(w) == all_runs(w)
    for w in strings(random.Random(5), 800, 160):
        words = [str(x).encode() for x in w]
        assert R.runs_of_texts([words, [], words])[2] == all_runs(w, 24, 3)
        assert R.runs_of_texts([words], 6, 2)[0] == all_runs(w, 6, 2)


def test_long_repetitive_words_take_linear_time(monkeypatch):
    """Comparisons of letters, counted through their equality, stay below a few for each letter."""
    seen = [0]

    class Letter(int):
        def __eq__(self, other):
            seen[0] += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = "a", "ab"
    while len(b) < 20000:
        a, b = b, b + a
    for w in ([i % 7 for i in range(20000)], [0] * 20000, [ord(c) for c in b], [0] * 9999 + [1] + [0] * 9999):
        seen[0] = 0
        R.next_smaller([Letter(x) for x in w])
        assert seen[0] < 3 * len(w)


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(all_runs(words, 24, 3), key=lambda x: (x[0], x[2]))
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def run_digests(docs):
    out = R.digests(docs, F.crc32(F.col("doc_id").cast("string")))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_digests_match_brute_force_on_documents_and_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(6)
    made = []
    for i in range(160):
        w = [f"w{rng.randrange(12)}" for _ in range(rng.randint(0, 150))]
        k = rng.randint(1, 9)
        made.append((i, " \n".join(w + w[:k] * rng.randint(0, 12) + ["end"] * rng.choice([0, 30]))))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = run_digests(docs)
    assert got == sorted((expected(*d) for d in made), key=str)
    assert sum(r[1] for r in got) > 60
    assert run_digests(odd_docs) == sorted((expected(r["doc_id"], r["text"]) for r in odd_docs.collect()), key=str)
    assert run_digests(no_docs) == []


def test_runs_as_rows_and_collapsed_texts_keep_columns(spark, odd_docs):
    loop = "one two three " * 9
    docs = odd_docs.unionByName(odd_docs.limit(1).withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit(f"lead in {loop}tail\n")))
    assert [tuple(r) for r in R.find_runs(docs).collect()] == [(77, 2, 27, 3)]
    out = R.collapse(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[77] == "lead in one two three tail"
    assert {k: v for k, v in kept.items() if k != 77} == {r["doc_id"]: r["text"] for r in odd_docs.collect()}


def plain(vectors):
    """Integer vectors, their distinct rows' eigenvalues (falling), trace and whitened first four components."""
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    s = fit.sum(axis=0)
    c = fit - s / len(fit)
    e, u = np.linalg.eigh(c.T @ c / len(fit))
    e, u = e[::-1], u[:, ::-1]
    return len(fit), ((len(fit) * x - s) ** 2).sum(axis=1), e, ((x - s / len(fit)) @ u[:, :4]) / np.sqrt(e[:4])


def check(spark, vectors, parts):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    got = W.digests(frame).toPandas().sort_values(["vec_id", "component"])
    n, deviation, e, white = plain(vectors)
    assert len(got) == 4 * len(vectors) and (got["n"] == n).all()
    assert (got[got.component == 1].deviation.to_numpy() == deviation).all()
    mine = got.whitened.to_numpy().reshape(-1, 4)
    signs = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * signs, white, atol=1e-8)
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4)[0], e[:4] / e.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9


def test_whitening_matches_numpy_through_many_merges(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(2)
        v = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12)) + 5).astype(np.float32)
        v[100:160] = v[7]  # one vector many times
        check(spark, v, 9)
        check(spark, v[:9, :8], 5)  # few vectors: empty and small partitions
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_merge_loses_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(-3000, 3000, (90, 7))
    one, parts = W.Summary.of(x), [W.Summary.of(p) for p in np.array_split(x, 11)]
    while len(parts) > 1:
        parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert parts[0].n == one.n and parts[0].sums == one.sums
    assert np.allclose(parts[0].values, one.values) and len(one.values) == 7
    assert np.allclose(np.abs(parts[0].vectors @ one.vectors.T), np.eye(7), atol=1e-9)


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (4, None), (5, [nan, 1.0]), (6, []), (7, [1e30, 1.0, 2.0]), (8, [-0.001]), (9, [inf, 1.0]), (10, [None, 1.0])]
    odd = spark.createDataFrame([(i, v, 9, "x", 2, 3) for i, v in rows], "vec_id long, embedding array<float>, dim int, x string, n int, part int")
    got = {(r["vec_id"], r["component"]): r for r in W.digests(odd).collect()}
    assert sorted(got, key=str) == sorted([(1, 1), (1, 2), (None, 1), (None, 2), (7, 1), (7, 2), (7, 3), (8, 1)], key=str)
    assert abs(abs(got[1, 1]["whitened"]) - 1) < 1e-12 and got[1, 1]["explained"] == 1.0 and got[1, 1]["n"] == 2
    assert got[1, 2]["whitened"] is None and got[1, 2]["explained"] == 0.0
    assert got[8, 1]["whitened"] is None and got[8, 1]["explained"] is None and got[8, 1]["deviation"] == 0
    assert W.digests(odd.limit(0)).collect() == []
