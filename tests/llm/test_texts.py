from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidewright.llm import additive_model as A
from tidewright.llm import byte_bpe as B
from tidewright.llm import embedding_dedup as E
from tidewright.llm import histogram_sort as H
from tidewright.llm import jaccard_join as J
from tidewright.llm import masked_lm as L
from tidewright.llm import packing as K
from tidewright.llm import pii

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
MIXED = "ab'sT é\n\t  \x0b\x1c\x85  dDll19!?.$ßж漢😀\r"


@pytest.fixture(scope="module")
def encoder():
    return B.TextEncoder(BPE, P.PATTERN)


def test_bpe_equals_the_library(encoder):
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks.rank, special_tokens={})
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice(MIXED) for _ in range(rng.randint(0, 30)))
        ids = theirs.encode_ordinary(text)
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == text.encode()
        assert encoder.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_prefix_table_appends_and_edits(encoder):
    rng = random.Random(4)
    for _ in range(200):
        text = bytes(rng.choice(b"abcdeing th\xc3\xa9") for _ in range(rng.randint(0, 25)))
        table = B.PrefixEncoder(encoder.ranks)
        for i in range(len(text)):
            table.append(text[i : i + 1])
            assert table.tokens() == encoder.ranks.merged(text[: i + 1])
        s = rng.randint(0, len(text))
        e = rng.randint(s, len(text))
        table.edit(s, e, b"thing")
        changed = text[:s] + b"thing" + text[e:]
        assert table.text == changed and table.tokens() == encoder.ranks.merged(changed)


def test_edits_in_long_texts_stop_where_the_old_table_resumes(encoder, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdeing th") for _ in range(6000)).encode()
    table = B.PrefixEncoder(encoder.ranks, text)
    added = []
    append = B.PrefixEncoder.append
    monkeypatch.setattr(B.PrefixEncoder, "append", lambda self, more: (added.append(len(more)), append(self, more))[1])
    for at in (0, 1, 17, 2000, 5990, 6000):
        changed = text[:at] + b"thing" + text[at + 3 :]
        added.clear()
        table.edit(at, min(at + 3, len(text)), b"thing")
        assert sum(added) <= 5 + 4 * encoder.ranks.longest
        fresh = B.PrefixEncoder(encoder.ranks, changed)
        assert table.text == changed and table.last == fresh.last
        table.edit(at, at + 5, text[at : at + 3])
        assert table.text == text


def test_ids_beyond_doubles_stay_exact(spark, labels):
    """Ids that a double can't hold, beside a null, through every operator on texts and vectors and every stage."""
    big = 2**53 + 1
    text = "enough words of an ordinary kind to be kept by any rule at all, twenty of them or so, one after another, mail a.b@c.org"
    docs = spark.createDataFrame([(big, text, "en", big), (big + 2, "another text", "en", None), (None, None, None, 3)], "doc_id long, text string, lang string, n_chars long").coalesce(1)
    want = {big, big + 2, None}
    for out in (B.encode_documents(docs, BPE, P.PATTERN), B.token_digests(docs, BPE, P.PATTERN), A.classify(docs, labels), K.pack(docs, WORDS), pii.find_spans(docs), L.score_documents(docs), J.similar_components(docs)):
        assert {r["doc_id"] for r in out.collect()} == want
    assert {r["doc_id"] for r in B.decode_documents(B.encode_documents(docs, BPE, P.PATTERN), BPE, P.PATTERN).collect()} == want
    assert {r["row"]["doc_id"] for r in H.place(docs, 2).collect()} == want
    assert {(r["doc_id"], r["lang"]) for r in pii.redact(docs).collect()} == {(big, "en"), (big + 2, "en"), (None, None)}
    assert {r["n_chars"] for r in A.keep_good(docs, labels).collect()} == {big, None, 3}
    assert {r["component_id"] for r in J.similar_components(docs).collect()} == want
    vectors = spark.createDataFrame([(big, [1.0, 0.0]), (big + 2, [1.0, 0.01]), (None, None), (big + 4, None)], "vec_id long, embedding array<float>").coalesce(1)
    assert {(r["vec_id"], r["component_id"]) for r in E.near_duplicates(vectors).collect()} == {(big, big), (big + 2, big), (None, None), (big + 4, big + 4)}


def test_bpe_round_trip_of_odd_documents(spark, odd_docs, no_docs):
    tokens = B.encode_documents(odd_docs, BPE, P.PATTERN)
    back = B.decode_documents(tokens, BPE, P.PATTERN)
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in back.collect()) == sorted((r["doc_id"] or 0, (r["text"] or "").encode()) for r in odd_docs.collect())
    digests = B.token_digests(odd_docs, BPE, P.PATTERN).collect()
    assert len(digests) == odd_docs.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(b"").hexdigest() for r in digests if r["doc_id"] in (5, 6))
    assert B.token_digests(no_docs, BPE, P.PATTERN).count() == 0


def test_word_tokens_equal_the_library():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(WORDS), K.WordTokens(WORDS)
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choice(MIXED + "İΏ​\xa0") for _ in range(rng.randint(0, 20))) + rng.choice(["", "<|endoftext|>", " <|startoftext|>a"])
        assert list(ours.ids(text)) == theirs.encode(text, add_special_tokens=False).ids


def test_cuts_cover_and_classes_fit():
    for n in [*range(1, 300), 819, 820, 1365, 2048, 2049, 4095, 4096, 4097, 8192, 20000]:
        got = K.cuts(n)
        assert got[0][0] == 0 and sum(x for _, x in got) == n
        assert all(a + b == c for (a, b), (c, _) in zip(got, got[1:]))
        assert all(K.size_class(x) * x <= K.CAPACITY for _, x in got)


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    ours = K.WordTokens(WORDS)
    want = sorted((r["doc_id"] or 0, tuple([*ours.ids(r["text"]), 2])) for r in odd_docs.collect())
    rows = K.pack(odd_docs.repartition(3), WORDS, capacity=256, keep_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_doc.setdefault(r["doc_id"] or 0, []).append((r["start"], tuple(r["ids"])))
    whole = {d: sorted(p) for d, p in by_doc.items()}
    assert {d: tuple(x for _, ids in p for x in ids) for d, p in whole.items() if d != 10} == {d: ids for d, ids in want if d != 10}
    for s in {r["sequence_id"] for r in rows}:
        pieces = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 256
    assert K.pack(no_docs, WORDS).count() == 0


def test_shards_are_even_and_keep_copies(spark, no_docs, odd_docs):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 4000).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 37).cast("int"))).alias("text"))
    rows = H.place(docs, 8).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
    total = sum(r["size"] for r in rows)
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) < 0.01 * total / 8 + 200
    homes: dict = {}
    for r in rows:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    assert H.place(no_docs, 8).count() == 0
    odd = H.place(odd_docs, 3).collect()
    assert len(odd) == odd_docs.count() and odd[0]["row"]["n_words"] == 1


def test_splitters_count_exactly(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("key"), (F.col("id") % 50 + 1).alias("size"))
    data = sorted((r["key"], r["size"]) for r in rows.collect())
    for key, below, n in H.splitters(rows, 5):
        assert (below, n) == (sum(s for k, s in data if k < key), sum(k < key for k, _ in data))


def test_classifier_learns_held_out_quality(spark, odd_docs, no_docs, labels):
    rng = random.Random(1)
    docs, marks = [], []
    for i in range(600):
        good = i % 3 > 0
        words = [f"w{rng.randrange(500)}" + ("" if good else rng.choice(["###", "$$", ""])) for _ in range(rng.randint(5, 80))]
        docs.append((i, " ".join(words)))
        marks.append((i, int(good), 0))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = A.classify(df, known).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert A.classify(odd_docs, labels).count() == odd_docs.count()
    assert A.classify(no_docs, labels).count() == 0
    assert A.classify(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert A.keep_good(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = A.train(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9
    one = model.base + sum(t[np.searchsorted(model.cuts[f], x[7, f], "right")] for f, t in enumerate(model.tables)) + sum(t[np.searchsorted(model.pair_cuts[f], x[7, f], "right"), np.searchsorted(model.pair_cuts[g], x[7, g], "right")] for (f, g), t in model.pairs.items())
    assert model.scores(x)[7] == pytest.approx(1 / (1 + np.exp(-one)))


def slow_spans(text):
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_match_the_patterns():
    rng = random.Random(9)
    for _ in range(6000):
        text = "".join(rng.choice(["@", ".", "-", "+", "a", "b.c", " ", "1", "23", "4111 1111 1111 1111", "10.2.3.4", "é", "(", ")", "x@y.z", "+1 212 555 0100"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == slow_spans(text), text


def test_spans_of_odd_documents(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in pii.find_spans(odd_docs).collect()}
    r = rows[10]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert rows[5]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[5]["spans"] == ""
    assert set(r["spans"].split(",")) >= {"email:5:22", "phone:26:43"}
    assert pii.find_spans(no_docs).count() == 0
    masked = pii.redact(odd_docs)
    assert masked.columns == odd_docs.columns and masked.count() == odd_docs.count()
    text = masked.filter("doc_id = 10").first()
    assert "bob.b" not in text["text"] and "[EMAIL]" in text["text"] and text["n_chars"] == len(text["text"])
    assert text["_spans"] == "x"


def test_estimation_trusts_agreeing_labelers():
    counts = {("phone", (1, 1, 1, 1, 1, 1, 1)): 500, ("phone", (0, -1, 0, -1, -1, 1, -1)): 300, ("card", (-1, -1, 1, 0, 1, 1, 1)): 150, ("card", (1, 1, 1, 0, 1, 1, 1)): 170}
    truth = pii.estimate(counts)
    assert truth["phone", (1, 1, 1, 1, 1, 1, 1)] > 0.95 > 0.2 > truth["phone", (0, -1, 0, -1, -1, 1, -1)]
    assert truth["card", (1, 1, 1, 0, 1, 1, 1)] > 0.95 > 0.2 > truth["card", (-1, -1, 1, 0, 1, 1, 1)]
    assert pii.estimate({}) == {} and not pii.SpanClassifier().sure("call 212-555-0100", "phone", 5, 17)


def test_added_spans_have_precision_and_recall(spark):
    """Planted secrets, spelled addresses and numbers without a country among names, versions, hashes and order numbers."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    some = lambda k: " ".join(word() for _ in range(k))
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((24, 32, 40))))
    docs, want = [], {}
    for i in range(600):
        before, after, kind = some(6), some(6), i % 6
        span = [secret(), f"{word()} (at) {word()} (dot) com", f"{rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}", f"{word()}@{word()}.org", "".join(map(str, rng.choices(range(10), k=16))), word() + word()][kind]
        lead = [f'{rng.choice(("api_key", "token", "PASSWORD"))} = "', rng.choice(("mail ", "contact ")), "call ", "", "order no. ", 'title = "'][kind]
        tail = '"' if kind in (0, 5) else ""
        text = f"{before} {lead}{span}{tail} {after}"
        docs.append((i, text))
        if kind < 4:
            want[i] = text.index(span)
    got = {r["doc_id"]: {int(x.split(":")[1]) for x in r["spans"].split(",") if x} for r in pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hits = sum(at in got[i] for i, at in want.items())
    clean = [i for i, t in docs if i not in want and not pii.base_spans(t)]
    assert hits >= 0.9 * len(want)
    assert sum(bool(got[i]) for i in clean) <= 0.03 * len(clean)


def test_candidates_touch_no_base_span():
    rng = random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choice(["a (at) b (dot) c ", "212-555-0100", ' token = "abcd1234efgh5678" ', "1234567890123 ", "+1 ", "x@y.zz ", ".", "10.1.1.1 ", "4111111111111111 "]) for _ in range(rng.randint(0, 9)))
        base = pii.base_spans(text)
        more = pii.candidates(text, base)
        assert all(e <= s2 or e2 <= s for _, s, e in more for _, s2, e2 in base)
        assert all(a[2] <= b[1] for a, b in zip(more, more[1:]))


def test_language_model_prefers_its_language(spark, odd_docs, no_docs):
    rng = random.Random(6)
    nouns, verbs = [f"noun{i}" for i in range(20)], [f"verb{i}" for i in range(20)]
    line = lambda: " ".join(x for _ in range(30) for x in ("the", rng.choice(nouns), rng.choice(verbs)))
    docs = [(i, line()) for i in range(400)]
    mixed = line().split()
    rng.shuffle(mixed)
    docs += [(900, " ".join(mixed))]
    rows = {r["doc_id"]: r for r in L.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    clean = np.mean([rows[i]["mean_log_likelihood"] for i in range(400)])
    assert rows[900]["mean_log_likelihood"] < clean - 0.3
    odd = {r["doc_id"]: r for r in L.score_documents(odd_docs).collect()}
    assert odd[5]["n_tokens"] == 0 and odd[5]["log_likelihood"] == 0
    assert L.score_documents(no_docs).count() == 0


def test_language_model_sums_conditionals():
    """The score is the sum over words of log P(class | neighbours) + log P(word | class)."""
    vocab = L.Vocabulary([(b"a", 5), (b"b", 3), (b"c", 1)], [1] * L.RARE)
    net = L.Network(vocab.edge + 1)
    ids = vocab.encode("a b zzz c")
    near = vocab.windows(ids)
    assert near[0].tolist() == [vocab.edge, vocab.edge, 1, ids[2]]
    _, z = net.forward(near)
    assert np.allclose(np.exp(z).sum(axis=1), 1, atol=1e-5)
    before = -z[np.arange(4), vocab.cls[ids]].mean()
    for _ in range(50):
        net.learn(near, vocab.cls[ids], 0.5)
    after = -net.forward(near)[1][np.arange(4), vocab.cls[ids]].mean()
    assert after < before


def test_language_model_scores_match_brute_force(spark):
    """Every document's score recomputed word by word, short texts and ones of several stretches alike."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", "word", "seldom%d" % rng.randrange(40)]) for _ in range(n)) for n in (1, 2, 5, 900, 700, 800, L.STRETCH, L.STRETCH + 1, 3 * L.STRETCH + 5)]
    docs = spark.createDataFrame([*enumerate([*texts, None, " ", texts[3]])], "doc_id long, text string").coalesce(1)
    vocab, counts = L.vocabulary(docs)
    net = L.train(docs, vocab)
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    mass: dict = {}
    for w, k in n.items():
        mass[int(vocab.cls[vocab.ids[w]])] = mass.get(int(vocab.cls[vocab.ids[w]]), 0) + k
    got = {r["doc_id"]: r for r in L.score_documents(docs).collect()}
    for i, text in enumerate([*texts, None, " ", texts[3]]):
        words = L.tokens(text)
        at = [vocab.edge] * 2 + [vocab.ids[w] for w in words] + [vocab.edge] * 2
        want = 0.0
        for j, w in enumerate(words):
            cls = int(vocab.cls[vocab.ids[w]])
            h = np.tanh(sum(net.table[k * net.inputs + at[2 + j + p]].astype(float) for k, p in enumerate(L.PLACES)) + net.bias)
            z = h @ net.out + net.out_bias
            want += z[cls] - np.log(np.exp(z).sum()) + np.log(n[w] / mass[cls])
        assert got[i]["n_tokens"] == len(words) and got[i]["log_likelihood"] == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert got[3]["log_likelihood"] == pytest.approx(got[len(texts) + 2]["log_likelihood"], rel=1e-6)


@pytest.mark.parametrize("n", [1, 5, L.BATCH, 4000, 40 * L.BATCH + 7])
def test_language_model_learns_from_every_word(spark, monkeypatch, n):
    """Every word is a target exactly once, whatever the length of text and buffer."""
    vocab, got = L.Vocabulary([(b"a", n)], [0] * L.RARE), []
    monkeypatch.setattr(L.Network, "learn", lambda self, near, target, rate: got.append((len(near), rate)))
    monkeypatch.setattr(L, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    texts = ["a " * 700] * (n // 700) + ["a " * (n % 700)]
    out = list(L._train(type("S", (), {"value": vocab}))(iter([L.pd.DataFrame({"text": texts})])))
    assert sum(k for k, _ in got) == n and max(k for k, _ in got) <= L.BATCH
    assert out[0]["weight"].iloc[0] == n


def test_language_model_keeps_the_count_of_every_word(spark, monkeypatch):
    """Words beyond the vocabulary are scored by their own counts, and often counted words join it at any number."""
    monkeypatch.setattr(L, "WORDS", 2)
    monkeypatch.setattr(L, "RARE", 1)
    docs = [(i, "the of often") for i in range(300)] + [(900, "the of seldom"), (901, None), (None, "the of often"), (None, "the of often")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = [(r["doc_id"], r["n_tokens"], r["log_likelihood"]) for r in L.score_documents(df).collect()]
    by = {d: s for d, _, s in rows}
    assert len(rows) == len(docs) and by[901] == 0
    assert by[0] - by[900] == pytest.approx(np.log(302), abs=1e-6)
    assert sum(d is None and s == by[0] for d, _, s in rows) == 2
    monkeypatch.setattr(L, "MIN_COUNT", 300)
    vocab, counts = L.vocabulary(df)
    assert set(vocab.ids) == {b"the", b"of", b"often"} and counts.count() == 4
    monkeypatch.setattr(L, "MIN_COUNT", 1)
    assert set(L.vocabulary(df)[0].ids) == {b"the", b"of", b"often", b"seldom"}


@pytest.mark.parametrize("hot", ["copied passage " * 3, None])
def test_shards_stay_even_with_a_large_group(spark, hot):
    """A third of all rows have one text: the shards' bytes and the ranges' rows stay even."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("a text of its own, number "), F.col("id").cast("string"), F.lit(" of many"))).alias("text"))
    placed = H.place(docs, 8)
    rows = placed.select("row.doc_id", "size", "shard", "slot").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(6000))
    total = sum(r["size"] for r in rows)
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) < 0.02 * total / 8 + 100
    narrow = docs.select(H._key().alias("key"), F.xxhash64("doc_id").alias("sub"), F.lit(1).cast("long").alias("size"))
    cuts = [0, *[n for *_, n in H.cuts_of(narrow, 8)], 6000]
    assert max(b - a for a, b in zip(cuts, cuts[1:])) < 800


def test_shards_stay_even_when_a_third_of_the_rows_are_one_row(spark, monkeypatch):
    """Rows that are equal in all columns are parted too, in ranges cut by bytes and rows."""
    monkeypatch.setattr(H, "RANGE_BYTES", 4000)
    monkeypatch.setattr(H, "RANGE_ROWS", 100)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one and the same row")).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    rows = H.place(docs, 8).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    total = sum(r["size"] for r in rows)
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) < 0.02 * total / 8 + 25
    same = H.place(docs.filter("text like 'one%'"), 5).groupBy("shard").count().collect()
    assert sum(r["count"] for r in same) == 1000 and all(abs(r["count"] - 200) <= 0.01 * 200 + 1 for r in same)
    assert H.place(docs.filter("text like 'one%'").limit(3), 8).count() == 3
