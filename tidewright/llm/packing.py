"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document's tokens are cut into full sequences and a rest.  From the rest a piece
of exactly capacity/k tokens may be cut, for the k that wastes least.  Pieces
are put into classes of reciprocal size: class k holds pieces of at most
capacity/k tokens, and every bin of class k takes exactly k of them.  A piece's bin is its
rank in its class divided by k; ranks come from the workers' own counts, so the
classes are filled independently.  Less than one bin a class is left over, a
number that doesn't depend on the input, and these pieces are packed first-fit.

Defined cases: a null or empty text has only the end token; a very long text is
as many full sequences as it takes; repeated rows and null ids are packed row by
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Cache, map_texts, store

CAPACITY = 4096
END_TOKEN = 2
#: Classes up to this are all reciprocals, above it powers of two.
FINE = 64
#: Bytes of words and their ids that a worker keeps in each of two generations.
CACHE = 70_000_000

_ready: dict[str, WordTokens] = {}


class WordTokens:
    """Token ids of whole texts from a vocabulary that drops white space and case, word by word with a bounded cache."""

    def __init__(self, path: str):
        # Spark already runs one worker a core; the library's own threads would only spin.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._known = Cache(CACHE)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of ``text`` without special tokens.

        White space ends a word and is dropped, so the ids of a text are those of
        its runs between blanks, each looked up or encoded once.  ASCII letters
        are lowered before, as the vocabulary does; not where the text may hold a
        special token, whose spelling counts.
        """
        raw = (text or "").encode("utf-8", "replace")
        words = (raw if b"<|" in raw else raw.lower()).split()
        try:
            return np.frombuffer(b"".join(map(self._known.young.__getitem__, words)), "<u4")
        except KeyError:
            found = self._learn({*words})
            return np.frombuffer(b"".join(map(found.__getitem__, words)), "<u4")

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of ``words``, from the cache or encoded."""
        found = {w: self._known.get(w) for w in words}
        new = [w for w, ids in found.items() if ids is None]
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            ids = found[w] = np.array(e.ids, "<u4").tobytes()
            self._known.put(w, ids, len(w) + len(ids))
        return found


def word_tokens(path: str) -> WordTokens:
    """One tokenizer per worker process."""
    if path not in _ready:
        _ready[path] = WordTokens(path)
    return _ready[path]


def size_class(n: int, capacity: int = CAPACITY) -> int:
    """The number of pieces of at most this size that a bin takes."""
    k = capacity // n
    return k if k <= FINE else 1 << (k.bit_length() - 1)


def waste(n: int, capacity: int = CAPACITY) -> float:
    """Padding that a piece of ``n`` tokens brings into its full bins."""
    k = size_class(n, capacity)
    return (capacity - k * n) / k


@lru_cache(maxsize=8)
def first_cuts(capacity: int) -> list[int]:
    """For every rest under the capacity, the size capacity/k of the piece to cut off first that wastes least; 0 for none."""
    out = [0] * capacity
    for rest in range(1, capacity):
        least = waste(rest, capacity)
        for k in range(-(-capacity // rest), FINE + 1):
            p = capacity // k
            if p < rest and (w := waste(p, capacity) + waste(rest - p, capacity)) < least - 1:
                least, out[rest] = w, p
    return out


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with n tokens: full sequences, then at most two pieces of the rest."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    if at < n:
        first = first_cuts(capacity)[n - at]
        out += [(at, first), (at + first, n - at - first)] if first else [(at, n - at)]
    return out


def _pieces(path: str, capacity: int, keep_ids: bool):
    def start():
        tok = word_tokens(path)
        here = TaskContext.get().partitionId()
        filled: dict[int, int] = {}
        names = ("start", "length", "ids_crc32", "doc_tokens", "k", "worker", "rank", "ids")

        def work(texts: list) -> dict:
            rows, at = [], []
            for i, text in enumerate(texts):
                ids = np.append(tok.ids(text), np.uint32(END_TOKEN)).astype("<u4")
                for begin, n in cuts(len(ids), capacity):
                    k = size_class(n, capacity)
                    rank = filled[k] = filled.get(k, -1) + 1
                    piece = ids[begin : begin + n]
                    rows.append((begin, n, zlib.crc32(piece.tobytes()), len(ids), k, here, rank, piece.astype(np.int32) if keep_ids else None))
                    at.append(i)
            return {**{c: [r[j] for r in rows] for j, c in enumerate(names)}, None: at}

        return work

    return start


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each piece, largest first into the first bin that has room."""
    bins = [0] * len(lengths)
    free = np.zeros(0, np.int64)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = np.flatnonzero(free >= lengths[i])
        if len(at):
            b = int(at[0])
        else:
            b = len(free)
            free = np.append(free, capacity)
        free[b] -= lengths[i]
        bins[i] = b
    return bins


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``keep_ids``."""
    added = "start long, length long, ids_crc32 long, doc_tokens long, k int, worker int, rank long, ids array<int>"
    pieces = store(map_texts(docs, _pieces(path, capacity, keep_ids), added, ["doc_id"]), "pieces")
    # Ranks of a class over all workers: one row per worker and class, summed up in the order of workers.
    counts = pieces.groupBy("k", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(counts.select("k", "worker", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")
    totals = {r["k"]: r["n"] for r in starts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    base, full = {}, 0
    for k in sorted(totals):
        base[k] = full
        full += totals[k] // k
    ranked = pieces.join(starts.select("k", "worker", "before"), ["k", "worker"]).withColumn("rank", F.col("rank") + F.col("before"))
    if not totals:
        return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if keep_ids else []))
    lookup = lambda d: F.create_map(*[F.lit(x) for k in sorted(totals) for x in (k, d[k])])
    whole = lookup({k: totals[k] // k * k for k in totals})
    in_bin = lookup(base)[F.col("k")]
    ranked = ranked.withColumn("sequence_id", F.when(F.col("rank") < whole[F.col("k")], in_bin + F.floor(F.col("rank") / F.col("k"))))
    # Under k pieces of each class are left: at most the sum of all classes, about 10,000 rows.
    left = ranked.filter("sequence_id is null").select("k", "rank", "length").orderBy("k", "rank").collect()
    bins = first_fit([r["length"] for r in left], capacity)
    placed = docs.sparkSession.createDataFrame([(r["k"], r["rank"], full + b) for r, b in zip(left, bins)], "k int, rank long, late long")
    joined = ranked.join(F.broadcast(placed), ["k", "rank"], "left").withColumn("sequence_id", F.coalesce("sequence_id", "late").cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("k", "rank").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset")]
    return joined.select(*columns, *(["ids"] if keep_ids else []))
