from __future__ import annotations

import pytest
from pyspark.sql import Row

LONG = " ".join(f"w{i % 977}x{i}" for i in range(4000))
BASE = " ".join(f"alpha{i}" for i in range(60))
NEAR = BASE.replace("alpha59", "omega59")
FAR = " ".join(f"beta{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, a repeated row, and columns that operators might use themselves."""
    rows = [
        (1, BASE, "en", "src0"), (2, BASE, "en", "src0"), (3, NEAR, None, "src1"), (4, FAR, "xx", None), (5, None, "en", "src0"), (6, "", "de", "src0"), (7, " \n\t ", "fr", "src0"),
        (8, LONG, "en", "src0"), (9, "short text", "en", "src0"), (10, "mail bob.b@example.com or +1 (212) 555-0100 now, host 10.0.0.300 and 10.1.2.3, card 4111 1111 1111 1111", "en", "src0"), (10, "mail bob.b@example.com or +1 (212) 555-0100 now, host 10.0.0.300 and 10.1.2.3, card 4111 1111 1111 1111", "en", "src0"), (None, "row without an id", "en", "src0"), (11, "Short TEXT", "en", "src0"),
    ]
    made = [Row(doc_id=a, text=b, lang=c, source=d, n_chars=len(b) if b else None, n_words=1, key="k", row=None, stratum="s", shard=3, rank=2, _spans="x") for a, b, c, d in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, key string, row string, stratum string, shard int, rank int, _spans string"
    return spark.createDataFrame(made, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (9, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int")
