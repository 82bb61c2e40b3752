"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its
encoding.  The table of these last tokens is filled left to right: a token that
ends the prefix is the one if it is compatible with the last token of what
stands before it, that is, if the two encode to themselves side by side.
Appending bytes extends the table; an edit keeps the table up to the edited
place and from where it comes out the same again.  Walking the table backwards gives the encoding.

Texts are cut into pieces that the pattern treats alike on their own, pieces
are encoded once per worker and kept in a cache bounded by bytes.

Defined cases: a null text is an empty one and has no tokens; a very long text,
or match, is encoded whole; repeated rows and null ids give a row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidewright.llm.common import Cache, map_texts

#: Bytes of pieces that a worker keeps in each of two generations.
CACHE = 40_000_000


class Ranks:
    """Token ranks, the tokens by their ends, and the compatibility of neighbours."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        lengths: dict[bytes, set[int]] = {}
        for t in self.rank:
            if len(t) > 2:
                lengths.setdefault(t[-3:], set()).add(len(t))
        #: For the last three bytes of a prefix, the lengths of the tokens that can end it.
        self.lengths = {end: (1, 2, *sorted(n)) for end, n in lengths.items()}
        #: The token that is another one and a byte.
        self.longer = {(self.rank[t[:-1]], t[-1]): r for t, r in self.rank.items() if t[:-1] in self.rank}
        self._edges: dict[int, tuple | None] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def _merge(self, text: bytes) -> Iterator[list[bytes]]:
        """The parts after every merge of the lowest-ranked neighbours."""
        parts = [text[i : i + 1] for i in range(len(text))]
        rank = self.rank
        yield parts
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield parts

    def merged(self, text: bytes) -> list[int]:
        """Encoding by repeated lowest-rank merges: the definition the table must agree with."""
        *_, parts = self._merge(text)
        return [self.rank[p] for p in parts]

    def edges(self, token: int) -> tuple[list, list, bool] | None:
        """The parts that stood at a token's left and right edge while it was merged, and whether their ranks rise.

        None if the token's bytes don't merge to the token.
        """
        if token not in self._edges:
            left, right, parts = [], [], []
            for parts in self._merge(self.token[token]):
                if not left or left[-1] != parts[0]:
                    left.append(parts[0])
                if not right or right[-1] != parts[-1]:
                    right.append(parts[-1])
            rises = all([self.rank[p] for p in side[1:]] == sorted(self.rank[p] for p in side[1:]) for side in (left, right))
            self._edges[token] = (left, right, rises) if parts == [self.token[token]] else None
        return self._edges[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``; left -1 is the start."""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[left, right] = self._check(left, right)
        return found

    def _check(self, left: int, right: int) -> bool:
        r = self.edges(right)
        if left < 0 or r is None:
            return r is not None
        a = self.edges(left)
        if not (a[2] and r[2]):
            return self.merged(self.token[left] + self.token[right]) == [left, right]
        # Both grow towards the border in rank order; they are parted for good unless a merge across it comes first.
        rank, no = self.rank, len(self.rank)
        grown, growing = a[1], r[0]
        i = j = 0
        while True:
            across = rank.get(grown[i] + growing[j], no)
            next_left = rank[grown[i + 1]] if i + 1 < len(grown) else no
            next_right = rank[growing[j + 1]] if j + 1 < len(growing) else no
            if across < next_left and across <= next_right and across < no:
                return False
            if next_left == no and next_right == no:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


class PrefixEncoder:
    """The last valid token of every prefix of a byte string that can grow and change."""

    def __init__(self, ranks: Ranks, text: bytes = b""):
        self.ranks, self.text, self.last = ranks, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        """Extend the table; entries of the old prefixes stay as they are.

        As only one token is right for a prefix, the likeliest is tried first: the
        last token grown by the new byte, then the new byte alone, then the others.
        """
        ranks, last = self.ranks, self.last
        rank, known, longer, lengths = ranks.rank.get, ranks.known.get, ranks.longer.get, ranks.lengths.get
        start, text = len(self.text), self.text + more
        self.text = text
        size = 0 if start == 0 else len(ranks.token[last[start]])
        for end in range(start + 1, len(text) + 1):
            t = longer((last[-1], text[end - 1])) if size else None
            if t is not None:
                before = last[end - 1 - size]
                if known((before, t)) or ranks.fits(before, t):
                    last.append(t)
                    size += 1
                    continue
            for n in lengths(text[end - 3 : end], (1, 2)) if end > 2 else (1, 2):
                if n > end:
                    break
                t = rank(text[end - n : end])
                if t is not None:
                    before = last[end - n]
                    if known((before, t)) or ranks.fits(before, t):
                        last.append(t)
                        size = n
                        break
            if len(last) == end:
                raise ValueError("no token ends this prefix")

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replace bytes begin to end; prefixes up to ``begin`` keep their entries, and so do those from where the old table resumes.

        An entry looks back no further than the longest token: once as many
        entries in a row as that are the old ones, all that follow are.
        """
        tail, old = self.text[end:], self.last[end:]
        reach = self.ranks.longest
        self.text, self.last = self.text[:begin], self.last[: begin + 1]
        self.append(new)
        same, at = 0, 0
        while at < len(tail):
            step = min(64, len(tail) - at)
            self.append(tail[at : at + step])
            for i in range(at + 1, at + step + 1):
                token = self.last[len(self.last) - 1 - (at + step - i)]
                same = same + 1 if token == old[i] else 0
            at += step
            if same >= reach:
                self.text += tail[at:]
                self.last += old[at + 1 :]
                return

    def tokens(self) -> list[int]:
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at])
            at -= len(self.ranks.token[self.last[at]])
        return out[::-1]


#: A blank beside a space, or a space at either end: such texts are not cut at spaces.
_UNEVEN = regex.compile(r"\s | \s|^ | $|[\x1c-\x1f]")


class TextEncoder:
    """Whole texts: pattern, prefix table per match, bounded caches per match and per word after a space."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = Ranks(path), regex.compile(pattern)
        self._seen, self._words = Cache(CACHE), Cache(CACHE)

    def match(self, piece: str) -> tuple[int, ...]:
        known = self._seen.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.rank.get(raw)
            known = (whole,) if whole is not None else tuple(PrefixEncoder(self.ranks, raw).tokens())
            self._seen.put(piece, known, 2 * len(raw) + 40 * len(known))
        return known

    def encode(self, text: str) -> list[int]:
        return [t for m in self.pattern.findall(text) for t in self.match(m)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids))

    def _word(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.encode(piece)
        return ",".join(map(str, ids)), len(ids), self.decode(ids)

    def _spaced(self, word: str) -> tuple[str, int, bytes]:
        out = self._words.get(word)
        if out is None:
            out = self._word(" " + word)
            self._words.put(word, out, 150 + 2 * len(out[2]) + len(out[0]))
        return out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of tokens, sha256 of the ids joined by commas, sha256 of the decoded bytes).

        No match of the pattern crosses the place before a single space between
        non-blank characters: a match takes a space only as its first character,
        before a run that isn't blank.  Texts whose spaces all stand so are cut there
        and every distinct word is encoded once; others are encoded as they are.
        """
        if not text:
            parts = []
        elif _UNEVEN.search(text):
            parts = [self._word(text)]
        else:
            first, *words = text.split(" ")
            parts, learn = [self._word(first)], self._spaced
            for s in range(0, len(words), 4096):
                known = self._words.young.get
                parts += [known(w) or learn(w) for w in words[s : s + 4096]]
        ids = ",".join([p[0] for p in parts])
        return sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()


_ready: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder per worker process."""
    if (path, pattern) not in _ready:
        _ready[path, pattern] = TextEncoder(path, pattern)
    return _ready[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, tokens (array<int>): the encoding of every whole text, a null or empty one giving no tokens."""

    def start():
        enc = encoder(path, pattern)
        return lambda texts: {"tokens": [np.array(enc.encode(t or ""), np.int32) for t in texts]}

    return map_texts(docs, start, "tokens array<int>", ["doc_id"])


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: the exact bytes that the tokens of every document stand for; null tokens stand for none."""

    def start():
        enc = encoder(path, pattern)
        return lambda ids: {"bytes": [enc.decode(t or ()) for t in ids]}

    return map_texts(tokens, start, "bytes binary", ["doc_id"], "tokens")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding of every whole text, as digests."""

    def start():
        enc = encoder(path, pattern)

        def work(texts: list) -> dict:
            rows = [enc.digest(t) for t in texts]
            return {c: [r[i] for r in rows] for i, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return work

    return map_texts(docs, start, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])
