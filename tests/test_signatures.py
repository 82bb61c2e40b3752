"""Fingerprints and signatures against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from tidewright.functions import markup as M
from tidewright.functions import text as T
from tidewright.operators import signatures as S


def number(b):
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big")


def test_minhash_equals_its_definition():
    rng = random.Random(3)
    for text in ["", None, "one", "two words", " ".join(rng.choice("abcdefgh") * 2 for _ in range(90)), "Ｆｕｌｌ width ﬁ and​ more words of it"]:
        words = re.findall(r"\w+", " ".join(unicodedata.normalize("NFKC", text or "").replace("​", "").lower().split()))
        grams = {"\x1f".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else set(words)
        got = S.signature(text)
        if not grams:
            assert len(got) == 0
            continue
        for i in (0, 1, 77, 127):
            a, b = number(b"a" + i.to_bytes(4, "big")) % S.PRIME or 1, number(b"b" + i.to_bytes(4, "big")) % S.PRIME
            assert int(got[i]) == min((a * (number(g.encode()) % S.PRIME) + b) % S.PRIME for g in grams)


def test_permutation_by_halves_is_exact():
    rng = random.Random(1)
    values = [0, 1, S.PRIME - 1, *[rng.randrange(S.PRIME) for _ in range(500)]]
    for a in values[:40]:
        b = rng.randrange(S.PRIME)
        got = S.permuted(np.uint64(a), np.uint64(b), np.array(values, np.uint64))
        assert got.tolist() == [(a * x + b) % S.PRIME for x in values]


def test_identity_print_equals_its_definition():
    text = "The quick brown fox, the Quick brown cat; 42 times!"
    words = re.findall("[0-9a-z]+", text.casefold())
    votes = [0] * 64
    for i in range(len(words) - 2):
        h = number(" ".join(words[i : i + 3]).encode())
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
    want = sum(1 << k for k in range(64) if votes[k] > 0)
    assert S.identity_print(text) % 2**64 == want and S.identity_print("") == 0 and S.identity_print(None) == 0


def test_bands_and_agreement(spark):
    base = [f"w{i}" for i in range(120)]
    near = base[:60] + ["new"] + base[61:]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"x{i}" for i in range(50))), (4, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in S.signatures(docs).select("doc_id", "signature", S.signature_bands().alias("bands")).collect()}
    assert set(rows[1]["bands"]) & set(rows[2]["bands"]) and not set(rows[1]["bands"]) & set(rows[3]["bands"])
    assert rows[4]["bands"] == [] and len(rows[1]["bands"]) == 16
    both = S.signatures(docs).alias("a").join(S.signatures(docs).alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"), S.agreement(F.col("a.signature"), F.col("b.signature")).alias("s"))
    got = {(r["u"], r["v"]): r["s"] for r in both.collect()}
    assert got[1, 2] > 0.85 and got[1, 3] < 0.1 and got[1, 4] == 0
    keys = spark.range(1).select(S.print_bands(F.lit(-2).cast("long")).alias("k")).first()["k"]
    assert keys == ["0:fffe", "1:ffff", "2:ffff", "3:ffff"]


def test_page_text_and_tracking_names(spark):
    html = "<head><title>t</title></head><!-- no --><nav>menu</nav><p>One <b>bold</b>.</p><div class='ad sidebar'>x</div><img width=\"1\" src='p'>&amp;lt;"
    row = spark.createDataFrame([(html,)], "h string").select(M.page_text(F.col("h")).alias("t"), M.chrome_marks(F.col("h")).alias("c"), M.tracking_pixels(F.col("h")).alias("p"), T.is_tracking(F.lit("Li_Fat_Id")).alias("k"), T.is_tracking(F.lit("source")).alias("n")).first()
    assert "One bold." in row["t"] and "menu" not in row["t"] and "no" not in row["t"] and row["t"].endswith("&lt;")
    assert row["c"] == ["sidebar"] and row["p"] == 1 and row["k"] and not row["n"]
