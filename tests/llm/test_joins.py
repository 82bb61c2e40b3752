from __future__ import annotations

import os
import random

import numpy as np

from tidewright.llm import embedding_dedup as E
from tidewright.llm import jaccard_join as J
from tidewright.llm.components import connected_components, local_forest
from tidewright.llm.shingles import shingle_set


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs):
    sets = {}
    for d, t in docs:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    u, v = [], []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                u.append(a)
                v.append(b)
    roots = local_forest(u, v)
    return {d: (len(s), roots.get(d, d)) for d, s in sets.items()}


def family(rng, base, n, first, edits):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        out.append((first + i, " ".join(w)))
    return out


def check(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_families_match_brute_force(spark, monkeypatch):
    """Variants at all distances around the threshold, copies, shared passages and short texts."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (140, 140, 60, 30)]
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i, b in enumerate(base):
        docs += family(rng, b, 60, 1000 * i, 7)
    docs += [(9000 + i, " ".join([f"q{i}x{k}" for k in range(80)] + passage)) for i in range(40)]
    docs += [(9500 + i, "Same copy of one longer text here") for i in range(20)] + [(9600, "tiny"), (9601, "TINY"), (9602, None), (9603, " "), (9604, "one two three four")]
    check(spark, docs)


def test_cells_in_blocks_match_brute_force(spark, monkeypatch):
    """Large families, hot shingles and groups of several members, with all marks small enough to be passed."""
    for name, value in (("LONG", 4), ("BLOCK_SETS", 7), ("BLOCK_SHINGLES", 900), ("UNDER_LEAD", 3), ("HOT", 30), ("LEAST", 2), ("BLOCK", 3000)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(11)
    docs = []
    for f in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range((120, 60, 40)[f])]
        docs += family(rng, base, 50, 1000 * f, (8, 6, 3)[f])
    # Many unlike documents with one passage, chained by a second one, and members that differ only in frequent shingles.
    passage, other = [f"p{i}" for i in range(50)], [f"o{i}" for i in range(50)]
    docs += [(5000 + i, " ".join([f"q{i}x{k}" for k in range(i % 9)] + passage + (other if i % 2 else []))) for i in range(45)]
    docs += [(6000 + i, " ".join([f"u{i // 6}y{k}" for k in range(30)] + passage[: 20 + i % 6] + other[i % 6 : 20])) for i in range(36)]
    docs += [(7000 + i, " ".join(f"long{i // 2}z{k}" for k in range(3000 + 5 * (i % 2)))) for i in range(4)]
    rng.shuffle(docs)
    check(spark, docs)


def test_lists_by_list_where_that_is_less(spark, monkeypatch):
    """A chain of lists that overlap in one document each is not made one cell."""
    monkeypatch.setattr(J, "LONG", 3)
    rows = [(10 * t, 10 * i, 10 * t, 10) for t in range(20) for i in range(t * 9, t * 9 + 10)]
    cells = J._long_cells(spark.createDataFrame([(t, g, 90 * (t // 10), n) for t, g, _, n in rows], "token long, g long, head long, length long")).collect()
    assert {c["kind"] for c in cells} == {1} and len(cells) >= len(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r["component_id"] for r in J.similar_components(odd_docs).collect()}
    assert (got[1], got[2], got[3], got[4], got[5], got[6], got[7], got[9], got[11], got[None]) == (1, 1, 1, 4, 5, 6, 7, 9, 9, None)
    assert J.similar_components(no_docs).count() == 0
    kept = J.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10]


def test_prefix_is_long_enough():
    for n in range(1, 400):
        need = -(-3 * n // 4)
        assert J.prefix_length(n) == n - need + 1


def test_shingles_are_of_whole_words():
    assert len(shingle_set("a b c d e f")) == 2
    assert set(shingle_set("A b\tc d  e")) == set(shingle_set("a b c d e"))
    assert set(shingle_set("ab c d e f")) != set(shingle_set("a bc d e f"))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (5000, 5001), (5001, 5000)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, 5000: 5000, 5001: 5000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 64))
    x = np.concatenate([rng.standard_normal((200, 64)), np.repeat(centre, 15, axis=0) + 0.12 * rng.standard_normal((180, 64))])
    x = np.concatenate([x, x[:10], 3 * x[10:14]])
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [1.0, None], 0), (904, [], 0), (905, [1.0, 0.0], 0), (906, [2.0, 0.0], 0), (None, [1.0] * 64, 0)]
    monkeypatch.setattr(E, "BLOCK", 8)
    out = {r["vec_id"]: r for r in E.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, keys int")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    want = close.sum(1)
    got = np.array([out[i]["n_links"] for i in range(len(x))])
    assert (got <= want).all()
    assert got.sum() >= 0.97 * want.sum()
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i in (900, 901, 902, 903, 904))
    assert (out[906]["component_id"], out[906]["n_links"], out[906]["kept"]) == (905, 1, False)
    assert out[None]["component_id"] is None and not out[None]["kept"]
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_needed_count_has_the_stated_recall():
    import math

    p = math.erf(E.WINDOW / math.sqrt(2))
    tail = sum(math.comb(E.LINES, k) * p**k * (1 - p) ** (E.LINES - k) for k in range(E.needed_collisions(), E.LINES + 1))
    assert tail >= E.RECALL


def test_jaccard_join_keeps_no_table_of_shingles(spark):
    from tidewright.llm.common import shared_dir

    base = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    texts = [" ".join(f"w{(i // 3) * 40 + k}" for k in range(30 + i % 3)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.similar_components(docs).collect()}
    assert got == {i: i - i % 3 for i in range(30)}
    left = {name.split("-")[0] for name in set(os.listdir(base)) - before}
    assert left and not left & {"counts", "signatures", "lists"}
