from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.operators.spans import Folds, locate, quote_hits, quote_pairs, resolve_mentions, verify


def plain(text, surface, start=None, end=None, taken=()):
    """The tiers with regular expressions."""
    s = surface.strip()
    if not s or not text:
        return None
    if start is not None and end is not None and 0 <= start < end <= len(text) and text[start:end] == s:
        return None if (start, end) in taken else (start, end, "reported")
    tiers = [("exact", [(i, i + len(s)) for i in range(len(text) - len(s) + 1) if text.startswith(s, i)]), ("case", [m.span() for m in re.finditer(re.escape(s), text, re.I)])]
    if len(s.split()) > 1:
        tiers.append(("blanks", [m.span() for m in re.finditer(r"\s+".join(map(re.escape, s.split())), text, re.I)]))
    for tier, spans in tiers:
        free = [x for x in spans if x not in taken]
        if free:
            return (*(free[0] if start is None else min(free, key=lambda x: (abs(x[0] - start), x[0]))), tier)
    return None


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aAbB \n\t", max_size=30), st.text(alphabet="aAbB \n", max_size=6), st.none() | st.integers(-1, 31), st.none() | st.integers(0, 33), st.sets(st.tuples(st.integers(0, 12), st.integers(0, 14)), max_size=6))
def test_locate_matches_regular_expressions(text, surface, start, end, taken):
    assert locate(Folds(text), surface, start, end, taken) == plain(text, surface, start, end, taken)


def test_every_tier_is_reached_and_offsets_cut_out_the_text():
    text = "Datadog costs more than Datadog used to. NEW  \n York is large; straße, Straße. İstanbul x"
    cases = {("Datadog", 0, 7): (0, 7, "reported"), ("Datadog", 26, 33): (24, 31, "exact"), ("datadog", None, None): (0, 7, "case"), ("new york", 90, 95): (41, 52, "blanks"), ("STRASSE", None, None): None, ("Straße", 0, 5): (71, 77, "exact"), ("istanbul", None, None): None, ("", 0, 3): None, ("x", None, None): (len(text) - 1, len(text), "exact")}
    for (surface, start, end), want in cases.items():
        assert locate(Folds(text), surface, start, end) == want
    assert Folds("İ ß").folded() == "İ ß"


def test_places_are_claimed_once_and_the_cap_is_in_reported_order():
    text = "Apple Vision Pro and Apple and apple"
    m = lambda s, a=None, b=None: {"surface": s, "start": a, "end": b}
    got = verify(text, [m("Apple"), m("apple"), m("APPLE", 21, 26), m("Apple"), m("Apple Vision Pro"), m("nothing"), m(" "), m(None), m("Apple", 0, 5)])
    assert [(x["reported"], x["start"], x["end"], x["tier"]) for x in got] == [(4, 0, 16, "exact"), (0, 0, 5, "exact"), (2, 21, 26, "case"), (1, 31, 36, "exact")]
    words = " ".join(f"w{i}" for i in range(100))
    kept = verify(words, [m(f"w{99 - i}") for i in range(100)])
    assert len(kept) == 64 and {x["reported"] for x in kept} == set(range(64)) and [x["start"] for x in kept] == sorted(x["start"] for x in kept)


def test_mentions_of_tables(spark):
    docs = spark.createDataFrame([(1, "a b a B"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    told = spark.createDataFrame([(1, 2, "B", None, None), (1, 1, "b", None, None), (1, 3, "b", None, None), (2, 1, "a", 0, 1), (3, 1, "a", None, None), (9, 1, "a", None, None)], "doc_id long, ord long, surface string, start int, end int")
    got = [tuple(r) for r in resolve_mentions(docs, told).collect()]
    assert sorted(got) == [(1, 0, 2, 3, "b", "exact", 0), (1, 1, 6, 7, "B", "exact", 1)]
    assert resolve_mentions(docs.limit(0), told).collect() == []


def test_mentions_of_one_document_are_held_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from tidewright.operators.spans import _verified

    words = [f"Word{i}" for i in range(400)]
    told = [{"surface": w, "start": None, "end": None} for w in words]
    kind = pa.list_(pa.struct([("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    part = pa.record_batch({"doc_id": pa.array(range(300)), "text": pa.array([" ".join(words)] * 300), "mentions": pa.array([told] * 300, kind)})
    tracemalloc.start()
    rows = [r for b in _verified(3)(iter([part])) for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 6)))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [(d, i, words[i], i) for d in range(300) for i in range(3)]
    # All mentions as objects at once take over 20 MB.
    assert peak < 4_000_000


def test_quotes_of_all_lengths_meet_their_texts(spark):
    rng = random.Random(4)
    words = ["ab", "Cd", "ef", "Gh", "été"]
    texts = [(i, rng.choice(["", "x"]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(60, None)]
    quotes = [(i, t[k : k + n]) for i, (_, t) in enumerate(texts[:40]) for k, n in [(rng.randint(0, 9), rng.randint(1, 30))]] + [(90, ""), (91, "ab Cd"), (92, "zz")]
    frame, asked = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string")
    want = {(d, i, t.index(q) + 1) for d, t in texts if t for i, q in quotes if q and q in t}
    assert {tuple(r) for r in quote_hits(frame, ["doc_id"], asked).collect()} == want
    assert {(r[0], r[1]) for r in quote_pairs(frame, ["doc_id"], asked).collect()} >= {(d, i) for d, i, _ in want}
    assert quote_hits(frame, ["doc_id"], asked.limit(0)).collect() == []
