"""Document scores by masked pseudo-likelihood.

Every word of every text is predicted from the two words on either side by a
small window network: the neighbours' embeddings are summed per position,
squashed and turned into a distribution over word classes; within its class a
word has its share of the corpus: P(word) = P(class | neighbours) * n(word) /
n(class).  A document's score is the sum of these conditional log-probabilities.

The counts come from all words of all texts and stay a table.  The WORDS most
frequent words and every word counted MIN_COUNT times have an embedding and a
place among the classes of equal mass, whose number follows theirs; the other
words share the embeddings of hash classes, whose number follows that of the
different words, and their own counts are joined to them by word.  The network is
trained in numpy by every worker on its own texts (every word of each text is a
target once, in one pass) and the workers' weights are averaged by the number of
words they learnt from, through two levels of a shuffle.

Defined cases: a null or blank text has no words and scores 0; a very long text
is scored whole, in stretches; an empty table gives an empty result; repeated
rows and null ids count and score as rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_texts, store, tidy

#: Least words with an embedding of their own, classes they are dealt to, and classes of the other words; all three grow with the corpus.
WORDS, CLASSES, RARE = 4096, 64, 16
#: Every word counted as often as this has an embedding of its own.
MIN_COUNT = 1000
HIDDEN, BATCH, RATE = 16, 2048, 0.1
PLACES = (-2, -1, 1, 2)
#: Weights in one row of the exchange; a worker's words are counted in blocks of so many different ones.
CHUNK, BLOCK = 4096, 400_000
#: Words that are scored together, of one text or several.
STRETCH = 2048
_MARKS = b".,;:!?\"'()"


def tokens(text: str | None) -> list[bytes]:
    """Words: runs between blanks, lower-cased in ASCII, without marks at either end."""
    return [w for x in (text or "").encode("utf-8", "replace").lower().split() if (w := x.strip(_MARKS))]


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()
    for part in parts:
        for t in part["text"]:
            held.update(tokens(t))
            if len(held) > BLOCK:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
    if held:
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})


class _Ids(dict):
    """Ids of words; a word without one of its own gets that of its hash class."""

    def __init__(self, own: dict[bytes, int], rare: int):
        super().__init__(own)
        self.base, self.rare = len(own), rare

    def __missing__(self, word: bytes) -> int:
        return self.base + zlib.crc32(word) % self.rare

    def __reduce__(self):
        return _Ids, (dict(self), self.rare)


class Vocabulary:
    """Ids, classes and in-class log-shares.  Ids: words, then hashed ones, then the edge.

    ``rare``: counts of all words of each hash class; the share of one of them lacks its own count.
    """

    def __init__(self, top: list[tuple[bytes, int]], rare: list[int]):
        self.size, self.rare = len(top), len(rare)
        self.ids = _Ids({w: i for i, (w, _) in enumerate(top)}, self.rare)
        self.classes = max(CLASSES, math.isqrt(self.size))
        n = np.array([c for _, c in top], float)
        mass = np.cumsum(n) / max(n.sum(), 1.0)
        cls = np.minimum((mass - n / max(n.sum(), 1.0) / 2) * self.classes, self.classes - 1).astype(int) if len(n) else np.zeros(0, int)
        self.cls = np.concatenate((cls, self.classes + np.arange(self.rare)))
        share = n / np.bincount(cls, n, self.classes)[cls] if len(n) else n
        self.log_share = np.concatenate((np.log(share), -np.log(np.maximum(np.array(rare, float), 1.0))))
        self.edge = self.size + self.rare

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def encode(self, text: str | None) -> np.ndarray:
        return self.ids_of(tokens(text))

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """The four neighbours of every word, the edge beyond both ends."""
        pad = np.concatenate(([self.edge] * 2, ids, [self.edge] * 2)).astype(np.int32)
        n = len(ids)
        return np.stack([pad[2 + p : 2 + p + n] for p in PLACES], axis=1)


class Network:
    """Window network over word classes, weights in one flat array."""

    def __init__(self, inputs: int, flat: np.ndarray | None = None, outputs: int = CLASSES + RARE):
        self.inputs, self.outputs = inputs, outputs
        sizes = (len(PLACES) * inputs * HIDDEN, HIDDEN, HIDDEN * self.outputs, self.outputs)
        if flat is None:
            rng = np.random.default_rng(20240615)
            flat = np.concatenate([rng.normal(0, 0.1, sizes[0]), np.zeros(HIDDEN), rng.normal(0, 0.3, sizes[2]), np.zeros(self.outputs)])
        self.flat = flat.astype(np.float32)
        cut = np.cumsum((0, *sizes))
        part = [self.flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.table = part[0].reshape(len(PLACES) * inputs, HIDDEN)
        self.bias, self.out, self.out_bias = part[1], part[2].reshape(HIDDEN, self.outputs), part[3]
        self.steps = np.arange(len(PLACES)) * inputs
        self.ones = np.ones(self.outputs, np.float32)
        self.room: dict[str, np.ndarray] = {}

    def space(self, name: str, rows: int, width: int) -> np.ndarray:
        """Room that the next call under the name uses again: fresh pages cost more than what is written to them."""
        if name not in self.room or len(self.room[name]) < rows:
            self.room[name] = np.empty((rows, width), np.float32)
        return self.room[name][:rows]

    def hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values for rows of neighbours, and the embeddings they come from."""
        at = near.astype(np.int64, copy=False) + self.steps
        h, more = self.space("hidden", len(at), HIDDEN), self.space("more", len(at), HIDDEN)
        self.table.take(at[:, 0], axis=0, out=h, mode="clip")
        for p in range(1, len(PLACES)):
            self.table.take(at[:, p], axis=0, out=more, mode="clip")
            h += more
        h += self.bias
        return np.tanh(h, out=h), at

    def exponents(self, h: np.ndarray) -> np.ndarray:
        """Scores of the classes whose exponentials, once scaled to sum 1, are the probabilities."""
        z = np.matmul(h, self.out, out=self.space("scores", len(h), self.outputs))
        z += self.out_bias
        # Hidden values lie in -1..1, so the weights bound the scores; only larger ones need a shift.
        if not np.abs(self.out).sum(axis=0).max() + np.abs(self.out_bias).max() < 60:
            z -= z.max(axis=1, keepdims=True)
        return z

    def forward(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log-probabilities of all classes for rows of neighbours."""
        h = self.hidden(near)[0].copy()
        z = self.exponents(h)
        return h, z - np.log(np.exp(z) @ self.ones)[:, None]

    def log_probability(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of every row's own class."""
        z = self.exponents(self.hidden(near)[0])
        own = z[np.arange(len(z)), target]
        return own - np.log(np.exp(z, out=z) @ self.ones)

    def learn(self, near: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean log-loss, embeddings by their own frequency."""
        h, at = self.hidden(near)
        d = self.exponents(h)
        np.exp(d, out=d)
        d *= (1 / (d @ self.ones))[:, None]
        d[np.arange(len(d)), target] -= 1
        dh = np.matmul(d, self.out.T, out=self.space("change", len(d), HIDDEN))
        slope = np.multiply(h, h, out=self.space("more", len(d), HIDDEN))
        dh *= np.subtract(1, slope, out=slope)
        rate = np.float32(rate)
        one = np.ones(len(d), np.float32)
        self.out -= (h.T @ d) * (rate / len(d))
        self.out_bias -= (one @ d) * (rate / len(d))
        self.bias -= (one @ dh) * (rate / len(d))
        # Sorted places of the embeddings, each with the row it is for in its lower part.
        key = at * len(d)
        key += np.arange(len(d))[:, None]
        key = np.sort(key, axis=None)
        place = key // len(d)
        row = key - place * len(d)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        ids, n = place[first], np.diff(np.append(first, len(place)))
        # Pairs of numbers add like complex ones, in half the steps.
        each = dh.take(row, axis=0, out=self.space("each", len(row), HIDDEN), mode="clip")
        sums = np.add.reduceat(each.view(np.complex64), first, axis=0).view(np.float32)
        sums *= (rate / np.sqrt(n, dtype=np.float32))[:, None]
        self.table[ids] -= sums


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and the counted table (word, n) of all words of all texts.

    The driver gets the words with an embedding and one number a hash class.
    """
    counts = store(docs.select("text").mapInPandas(tidy(_count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = counts.agg(F.count("*").alias("types"), F.count_if(F.col("n") >= MIN_COUNT).alias("often")).first()
    chosen = counts.filter(F.col("n") >= MIN_COUNT) if size["often"] >= WORDS else counts.orderBy(F.desc("n"), "word").limit(WORDS)
    top = sorted(((bytes(r["word"]), r["n"]) for r in chosen.collect()), key=lambda x: (-x[1], x[0]))
    classes = max(RARE, math.isqrt(size["types"]) // 64)
    rare = [0] * classes
    if len(top) < size["types"]:
        below = (F.col("n") < top[-1][1]) | ((F.col("n") == top[-1][1]) & (F.col("word") > F.lit(bytearray(top[-1][0]))))
        for r in counts.filter(below).groupBy((F.crc32("word") % classes).alias("c")).agg(F.sum("n").alias("n")).collect():
            rare[r["c"]] = r["n"]
    return Vocabulary(top, rare), counts


def network(vocab: Vocabulary, flat: np.ndarray | None = None) -> Network:
    return Network(vocab.edge + 1, flat, vocab.classes + vocab.rare)


def learn_all(net: Network, near: np.ndarray, target: np.ndarray, mixed: np.ndarray, first: bool) -> None:
    """Every target once, in equal batches of at most BATCH; a last short buffer moves the weights by its share."""
    for pick in np.array_split(mixed, -(-len(mixed) // BATCH)):
        net.learn(near[pick], target[pick], RATE if first else RATE * min(1.0, 2 * len(pick) / BATCH))


def _train(shared):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        net, seen = network(vocab), 0
        near, target, held = [], [], 0

        def step() -> None:
            nonlocal near, target, held
            x, y = np.concatenate(near), np.concatenate(target)
            learn_all(net, x, y, np.random.default_rng(seen).permutation(len(x)), seen == held)
            near, target, held = [], [], 0

        for part in parts:
            for text in part["text"]:
                ids = vocab.encode(text)
                if not len(ids):
                    continue
                near.append(vocab.windows(ids))
                target.append(vocab.cls[ids])
                held += len(ids)
                seen += len(ids)
                if held >= 32 * BATCH:
                    step()
        if held:
            step()
        if seen:
            here = TaskContext.get().partitionId() % 64
            moved = (net.flat - network(vocab).flat) * np.float32(seen)
            # The first number of row -1 is a place holder; weights that did not move are not sent.
            cut = [(-1, moved[:1])] + [(s // CHUNK, c) for s in range(0, len(moved), CHUNK) if (c := moved[s : s + CHUNK]).any()]
            yield pd.DataFrame({"chunk": np.array([k for k, _ in cut], np.int32), "lane": np.int32(here), "weight": float(seen), "sums": [c for _, c in cut]})

    return run


def _sum_chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running sums per chunk: one array a chunk is held, however many rows come."""
    sums: dict[tuple[int, int], list] = {}
    for part in parts:
        for chunk, lane, weight, values in zip(part["chunk"], part["lane"], part["weight"], part["sums"]):
            got = sums.setdefault((chunk, lane), [0.0, np.zeros(len(values))])
            got[0] += weight
            got[1] += values
    if sums:
        yield pd.DataFrame([(c, lane, w, v.astype(np.float32)) for (c, lane), (w, v) in sums.items()], columns=["chunk", "lane", "weight", "sums"]).astype({"chunk": "int32", "lane": "int32"})


def train(docs: DataFrame, vocab: Vocabulary) -> Network:
    """The workers' networks, averaged by the words they learnt from."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = "chunk int, lane int, weight double, sums array<float>"
    local = docs.select("text").mapInPandas(tidy(_train(shared)), schema)
    some = local.repartition("chunk", "lane").mapInPandas(tidy(_sum_chunks), schema).withColumn("lane", F.lit(0))
    rows = some.repartition("chunk").mapInPandas(tidy(_sum_chunks), schema).orderBy("chunk").collect()
    net = network(vocab)
    for r in rows[1:]:
        net.flat[r["chunk"] * CHUNK :][: len(r["sums"])] += np.array(r["sums"]) / rows[0]["weight"]
    return net


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all words) and mean_log_likelihood (0 for no words)."""
    vocab, counts = vocabulary(docs)
    net = train(docs, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net.flat))

    def start():
        vocab, flat = shared.value
        net = network(vocab, flat)
        row = TaskContext.get().partitionId() << 33

        def add_up(held: list, total: list[float]) -> None:
            """Add stretches of texts, looked at together, to the texts' sums."""
            ids, near = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            value = net.log_probability(near, vocab.cls[ids]).astype(np.float64) + vocab.log_share[ids]
            begins = np.cumsum([0, *(len(x) for _, x, _ in held[:-1])])
            for (at, _, _), x in zip(held, np.add.reduceat(value, begins)):
                total[at] += float(x)

        def work(texts: list) -> dict:
            nonlocal row
            out: dict = {"row": list(range(row, row + len(texts))), "n_tokens": [], "total": [], "words": [], "times": []}
            row += len(texts)
            held, waiting = [], 0
            for text in texts:
                words = tokens(text)
                ids = vocab.ids_of(words)
                rare = Counter(compress(words, (ids >= vocab.size).tolist()))
                out["n_tokens"].append(len(ids))
                out["total"].append(0.0)
                out["words"].append(list(rare))
                out["times"].append(list(rare.values()))
                for s in range(0, len(ids), STRETCH):
                    # The windows of a stretch need two words more on either side.
                    low, now = max(0, s - 2), ids[s : s + STRETCH]
                    near = vocab.windows(ids[low : s + STRETCH + 2])[s - low : s - low + len(now)]
                    held.append((len(out["total"]) - 1, now, near))
                    waiting += len(now)
                    if waiting >= STRETCH:
                        add_up(held, out["total"])
                        held, waiting = [], 0
            if held:
                add_up(held, out["total"])
            return out

        return work

    # Stored, so that a row keeps its number; then every rare word meets its own count.
    scored = store(map_texts(docs, start, "row long, n_tokens long, total double, words array<binary>, times array<int>", ["doc_id"]), "scored")
    met = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    own = met.join(counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("own"))
    whole = F.col("total") + F.coalesce("own", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).otherwise(F.lit(0.0))
    return scored.select("row", "doc_id", "n_tokens", "total").join(own, "row", "left").select("doc_id", "n_tokens", whole.alias("log_likelihood"), mean.alias("mean_log_likelihood"))
