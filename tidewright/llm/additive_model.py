"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few numbers.  Each feature is cut into bins at quantiles of the
training rows; cyclic boosting fits a shallow tree to one feature at a time and
adds it to that feature's lookup table, then the same for the feature pairs
that explain most of what is left.  A score is a sum of table entries, looked up
for whole batches at once.

Training uses a bounded sample of the labelled rows outside the held-out fold:
the SAMPLE rows with the smallest id hashes.  Everything else reads all rows.

Defined cases: a null or empty text has all features 0 and is scored like any
other; a very long text is measured whole; without labels, or with one class
only, every score is the smoothed share of label 1; repeated rows and null ids
are scored row by row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_texts

#: Most labelled rows that are learnt from.
SAMPLE = 20_000
FOLDS, HELD_OUT = 4, 2
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 40, 0.15
CUT = 0.7

FEATURES = ("words", "word_length", "symbols", "digits", "marks", "capitals", "non_ascii", "distinct", "top_word", "repeats", "line_length", "dup_lines")

_KIND = np.zeros(256, np.int64)
for _kind, _chars in enumerate((b"#*$%&|<>{}[]\\^~=_@/+", b"0123456789", b".,;:!?'\"()-", bytes(range(65, 91))), 1):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 5


def features(text: str | None) -> list[float]:
    """The numbers of one whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 6)
    chars = len(b"".join(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = sum([a == b for a, b in zip(words, words[1:])])
    return [math.log1p(n), chars / n, *(kinds[1:] / chars), len(counts) / n, max(counts.values()) / n, repeats / n, math.log1p(chars / len(lines)), 1 - len({*lines}) / len(lines)]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(0))


@dataclass
class AdditiveModel:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], "right")]
        for (f, g), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_cuts[f], x[:, f], "right"), np.searchsorted(self.pair_cuts[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best cut of a run of bins by gain; 0 if none gains."""
    if len(g) < 2:
        return 0, 0.0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    k = int(gain.argmax())
    return (k + 1, float(gain[k])) if gain[k] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on one feature's bins, as values per bin."""
    out = np.zeros(len(g))
    k, _ = _split(g, h)
    for lo, hi in ((0, k), (k, len(g))):
        m, _ = _split(g[lo:hi], h[lo:hi])
        for a, b in ((lo, lo + m), (lo + m, hi)):
            if a < b:
                out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best pair of one cut on each axis, as values per cell, and its gain."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    parts = list(zip(quads(gs), quads(hs)))
    gain = sum(_gain(a, b) for a, b in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(g.shape)
    for (a, b), where in zip(parts, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        out[where] = _leaf(a[i, j], b[i, j])
    return out, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of log-odds of y (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(base=math.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return model
    columns = range(x.shape[1])
    model.cuts = [_cuts(x[:, f], BINS) for f in columns]
    model.pair_cuts = [_cuts(x[:, f], PAIR_BINS) for f in columns]
    at = [np.searchsorted(model.cuts[f], x[:, f], "right") for f in columns]
    cell = [np.searchsorted(model.pair_cuts[f], x[:, f], "right") for f in columns]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)

    def push() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in columns:
            g, h = push()
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(at[f], g, n), np.bincount(at[f], h, n))
            model.tables[f] += step
            total += step[at[f]]

    def sums(f: int, k: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.pair_cuts[f]) + 1, len(model.pair_cuts[k]) + 1)
        flat = cell[f] * shape[1] + cell[k]
        return tuple(np.bincount(flat, w, shape[0] * shape[1]).reshape(shape) for w in (g, h))

    g, h = push()
    gains = {(f, k): _pair_tree(*sums(f, k, g, h))[1] for f in columns for k in columns if f < k}
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]:
        model.pairs[pair] = np.zeros((len(model.pair_cuts[pair[0]]) + 1, len(model.pair_cuts[pair[1]]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (f, k), table in model.pairs.items():
            g, h = push()
            step = RATE * _pair_tree(*sums(f, k, g, h))[0]
            table += step
            total += step[cell[f], cell[k]]
    return model


def _matrix(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """A model from at most ``sample`` labelled rows outside the held-out fold.

    A document with several labels takes the lowest; of rows that repeat a
    doc_id the first text in order is learnt from, so the bound holds for rows.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("quality").cast("int").alias("quality"), F.min("text").alias("text"))
    got = map_texts(rows, lambda: lambda texts: {"x": list(_matrix(texts))}, "x array<double>", ["quality"]).toArrow()
    if not got.num_rows:
        return AdditiveModel()
    x, y = np.array(got["x"].to_pylist()), got["quality"].to_numpy().astype(float)
    # The order of rows must not change the sums.
    order = np.lexsort((*x.T, y))
    return train(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scored = map_texts(docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "text"), lambda: lambda texts: {"score": model.scores(_matrix(texts))}, "score double", ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, learn(docs, labels, sample))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns unchanged, each judged by its own text.

    Where nothing was learnt (no labels, or all of one class) there is no
    evidence against any row and all stay.  Null and empty texts are judged like
    others; repeated rows and null ids row by row; an empty table stays empty.
    """
    model = learn(docs, labels, sample)
    if not model.tables:
        return docs
    name = "_score"
    while name in docs.columns:
        name += "_"
    scored = map_texts(docs, lambda: lambda texts: {name: model.scores(_matrix(texts))}, f"`{name}` double")
    return scored.filter(F.col(name) >= CUT).drop(name)
