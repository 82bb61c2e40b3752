"""Periodic runs of words: Lyndon arrays on an ordered alphabet in linear time.

A run is a maximal stretch of words with smallest period q and at least two
periods.  Every run holds a Lyndon word of length q that is the longest one from
its first word, under the order of the words or under the reverse order.  So for
both orders the next smaller suffix of every position is found with a stack, from
left to right, along with the length that the two suffixes match.  A comparison
takes its length from earlier ones: from the place that the farthest match so far
mirrors, from the two neighbours on the stack, or it goes on where that farthest
match ended.  No position is compared twice, there is no suffix structure and no
hash in it.  A run's left end is found from its first Lyndon word by at most one
period of comparisons.

``least`` and ``copies`` state which runs count: at least that many words, and at
least that many periods (2 or more).  Before the search a text is cut where a run
cannot pass: every window of ``least - 2 * (least // 3)`` words inside a counted run
of three periods occurs twice in it, so words that no repeated window covers are
left out.  That is exact (equal hashes of different windows only leave more in).

Defined cases: words are runs outside space and tab to carriage return; a null or
blank text has no words and no runs; a null id is an id like others; repeated rows
are judged each on its own; a text of any length is held by one task, as are its
runs; an empty table gives an empty result; further columns stay in ``collapse``
and are ignored elsewhere, whatever their names.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_texts

LEAST, COPIES = 24, 3


def next_smaller(w: list[int]) -> tuple[list[int], list[int]]:
    """For every suffix the start of the next smaller one (the length if none) and how many letters the two share."""
    n = len(w)
    nss, shared = [n] * n, [0] * n  # pairs (i, nss[i])
    pss, before = [-1] * n, [0] * n  # pairs (pss[r], r)
    stack: list[int] = []
    left, right, reach = 0, 0, 0  # the match that ends farthest: w[left:] and w[right:] agree up to reach
    for r in range(n):
        last = 0
        i = r - 1
        first = True
        while stack:
            i = stack[-1]
            known = -1
            if r < reach and i >= right:
                back = right - left
                i_, r_ = i - back, r - back
                smaller = nss[i_] == r_
                length = shared[i_] if smaller else before[r_]
                if r + length < reach:
                    known = length
                else:
                    length = reach - r
            elif first:
                length = 0
            else:
                other = before[above]
                if last < other:
                    length = known = last
                    smaller = True
                elif last > other:
                    length = known = other
                    smaller = False
                else:
                    length = last
            if known < 0:
                a, b = i + length, r + length
                while b < n and w[a] == w[b]:
                    a += 1
                    b += 1
                length = b - r
                smaller = b == n or w[b] < w[a]
                if b >= reach:
                    left, right, reach = i, r, b
            if not smaller:
                pss[r], before[r] = i, length
                break
            nss[i], shared[i] = r, length
            stack.pop()
            above, last, first = i, length, False
        stack.append(r)
    return nss, shared


def runs(w: list[int], least: int = 2, copies: int = 2) -> list[tuple[int, int, int]]:
    """Sorted (start, length, period) of the runs of ``w`` with at least ``least`` letters and ``copies`` periods."""
    found = set()
    for letters in (w, [-x for x in w]):
        nss, shared = next_smaller(letters)
        first: dict[tuple[int, int], int] = {}
        for i, r in enumerate(nss):
            p, end = r - i, r + shared[i]
            # The left end is less than a period before the first Lyndon word.
            if end - i + p > max(least, copies * p) and (p, end) not in first:
                first[p, end] = i
        for (p, end), start in first.items():
            stop = max(0, start - p)
            while start > stop and w[start - 1] == w[start - 1 + p]:
                start -= 1
            if end - start >= max(least, copies * p):
                found.add((start, end - start, p))
    return sorted(found)


def _segments(ids: np.ndarray, doc: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Stretches of the joined documents that windows found twice in their document cover."""
    m = len(ids) - window + 1
    if m < 2:
        return []
    key = np.zeros(m, np.uint64)
    for k in range(window):
        key = (key ^ ids[k : k + m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    key = (key ^ doc[:m].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    near = key[order]
    same = near[1:] == near[:-1]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= doc[:m] == doc[window - 1 :]
    edge = np.diff(np.concatenate(([0], twice.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + window - 1).tolist()))


def runs_of_texts(words: list[list[bytes]], least: int = LEAST, copies: int = COPIES) -> list[list[tuple[int, int, int]]]:
    """The counted runs of each list of words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(x, len(known)) for one in words for x in one], np.int64)
    sizes = [len(one) for one in words]
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    window = least - 2 * (least // 3)
    if copies >= 3 and window > 0:
        doc = np.repeat(np.arange(len(words)), sizes)
        places = [(s, e, int(doc[s])) for s, e in _segments(ids, doc, window)]
    else:
        places = [(int(starts[d]), int(starts[d + 1]), d) for d in range(len(words))]
    for s, e, d in places:
        if e - s >= least:
            at = s - int(starts[d])
            out[d] += [(at + start, length, period) for start, length, period in runs(ids[s:e].tolist(), least, copies)]
    return out


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [x for x, gone in zip(words, np.cumsum(drop).tolist()) if not gone]


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def find_runs(docs: DataFrame, least: int = LEAST, copies: int = COPIES, keep: list[str] | None = None) -> DataFrame:
    """One row per counted run: the ``keep`` columns (doc_id), start and length in words, period."""

    def start():
        def work(texts: list) -> dict:
            found = runs_of_texts([_split(t) for t in texts], least, copies)
            flat = [(i, *run) for i, own in enumerate(found) for run in own]
            cols = list(zip(*flat)) or [(), (), (), ()]
            return {None: list(cols[0]), "start": list(cols[1]), "length": list(cols[2]), "period": list(cols[3])}

        return work

    return map_texts(docs, start, "start long, length long, period long", keep or ["doc_id"])


def collapse(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """``docs`` with texts that keep one period of each run; texts without a run stay as they are, others have their kept words joined by one space."""

    def start():
        def work(texts: list) -> dict:
            words = [_split(t) for t in texts]
            found = runs_of_texts(words, least, copies)
            return {"_collapsed": [b" ".join(kept_words(w, f)).decode("utf-8", "surrogatepass") if f else t for t, w, f in zip(texts, words, found)]}

        return work

    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("`text`").alias("text"))
    made = map_texts(named, start, "_collapsed string", ["row"])
    return made.select(*[F.col("_collapsed").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The contract's rewriting of one document in ten: from word a on, the words repeat with period p."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digests(docs: DataFrame, seed: Column | None = None, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """Per document: doc_id, n_runs, the run of the greatest exponent, digests of all runs and of the collapsed text.

    ``seed`` (long) has the words rewritten by :func:`planted` first; where it is null they stay.
    """

    def start():
        def work(rows: list) -> dict:
            words = [planted(_split(r["text"]), r["h"]) for r in rows]
            out: dict[str, list] = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for own, found in zip(words, runs_of_texts(words, least, copies)):
                found = sorted(found, key=lambda x: (x[0], x[2]))
                best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
                out["n_runs"].append(len(found))
                for c, v in zip(("start", "length", "period"), best or (None,) * 3):
                    out[c].append(v)
                out["exponent_milli"].append(best and 1000 * best[1] // best[2])
                out["runs_sha256"].append(_hex("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()))
                out["collapsed_sha256"].append(_hex(b" ".join(kept_words(own, found))))
            return out

        return work

    seed = F.lit(None).cast("long") if seed is None else seed
    given = docs.select("doc_id", F.struct(F.col("text").alias("text"), seed.alias("h")).alias("given"))
    added = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_texts(given, start, added, ["doc_id"], "given")
