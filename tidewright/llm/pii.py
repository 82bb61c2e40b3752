"""Personal data by weak supervision.

Stated patterns give the base spans.  Looser patterns add candidates: spelled
e-mail addresses, phone numbers without a country, card-like numbers, and values
assigned to names (secrets).  Labelers look at every span: its format, its check
digits, parts or entropy, gazetteers of endings, prefixes and names, the words
before it, the characters beside it, its variety and the digits around it; each
votes for, against or not at all.  The vote patterns of all documents are counted,
expectation-maximisation estimates each labeler's reliability per kind from the
counts, and the resulting probabilities train a logistic span classifier on the
votes and on features of the text, fitted on at most SAMPLE spans (those with the
smallest hashes).  A candidate is taken if the classifier is sure; base spans
stay whatever it says.

Defined cases: a null or empty text has no spans; a very long text is searched
whole; repeated rows and null ids are searched row by row; without any span
nothing is trained; an empty table gives an empty result; other columns are
ignored by ``find_spans`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_texts, store

#: Kinds with stated patterns, and the one that only the classifier accepts.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("format", "structure", "gazetteer", "context", "border", "variety", "density")
#: Weights of the labelers' votes in the first guess of expectation-maximisation.
TRUST = (2.0, 3.0, 1.0, 1.0, 1.0, 0.5, 0.5)
#: Probability from which a candidate is taken, and the most spans that the classifier is fitted on.
SURE, SAMPLE = 0.95, 20_000

# Gazetteers and context words of the labelers.
ENDINGS = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl", "us", "ca", "biz", "co"}
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "2221", "6011", "65", "35", "62")
WORDS_FOR = {
    "email": re.compile(r"mail|contact|write|reach|schreib|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|anruf|appel|llam", re.I),
    "secret": re.compile(r"""[=:]\s*["']$"""),
}
SECRET_NAMES = re.compile(r"token|secret|passw|pwd|credential|auth|(?:api|access|private)[_-]?key", re.I)
SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "eyJ")
WORDS_AGAINST = re.compile(r"isbn|order|version|serial|invoice|\bref\b|\bno\.|#$", re.I)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._-]{1,64} ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?[(\[] ?dot ?[)\]] ?[A-Za-z0-9-]{1,63})+")
_ASSIGNED = re.compile(r"""([A-Za-z][A-Za-z_-]{1,40})["']?[ \t]{0,3}(?:=>|=|:)[ \t]{0,3}["']([A-Za-z0-9+/_.=-]{8,512})["']""")
_KNOWN_START = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|glpat-|xoxb-|xoxp-|sk-|sk_live_|eyJ)[A-Za-z0-9_.-]{12,512}")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 if n < 5 else n * 2 - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without going over a run of local characters more than once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The stated spans, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if text.count(".") > 2:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 12 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that only the classifier can accept; none touches a base span or an earlier candidate."""
    found = []
    if "at" in text and ("(" in text or "[" in text):
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    found += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(2)) for m in _ASSIGNED.finditer(text)]
    found += [("secret", *m.span()) for m in _KNOWN_START.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 12 and 13 <= len(d := _digits(m[0])) <= 19 and not luhn(d):
            found.append(("card", *m.span()))
    if not found:
        return []
    # Base spans of different kinds may overlap: the furthest end so far decides.
    starts, ends = [], []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        starts.append(s)
        ends.append(max(e, ends[-1] if ends else 0))
    out, last = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        before = bisect_left(starts, e) - 1
        if s >= last and (before < 0 or ends[before] <= s):
            out.append((kind, s, e))
            last = e
    return out


def _entropy(span: str) -> float:
    n = np.array(list(Counter(span).values()), float)
    return float(-(n / n.sum() * np.log2(n / n.sum())).sum())


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 none."""
    span = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    digits = _digits(span)
    form = 1 if base else 0
    if kind == "email":
        ending = re.split(r"[.\s()\[\]]+", span.rstrip(".)] "))[-1].lower()
        structure, gazetteer = (1 if ending.isalpha() and len(ending) > 1 else -1), (1 if ending in ENDINGS else -1)
    elif kind == "ip":
        parts = span.split(".")
        structure, gazetteer = (-1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1), (-1 if parts[0] in ("0", "127", "255") else 1)
    elif kind == "card":
        structure, gazetteer = (1 if luhn(digits) else -1), (1 if digits.startswith(CARD_STARTS) else -1)
        form = 1 if base else -1
    elif kind == "phone":
        structure, gazetteer = (1 if 9 <= len(digits) <= 15 else -1), (1 if span[0] == "+" else 0)
    else:
        mixed = any(c.isalpha() for c in span) and len(digits) > 1
        structure = 1 if mixed and _entropy(span) >= 2.8 else -1
        name = re.search(r"([A-Za-z_-]+)[\"']?[ \t]*(?:=>|=|:)[ \t]*[\"']$", before)
        known = span.startswith(SECRET_STARTS)
        gazetteer = 1 if known or (name and SECRET_NAMES.search(name[1])) else -1
        form = 1 if known or len(span) >= 16 else -1
    context = 1 if WORDS_FOR[kind].search(before) else -1 if WORDS_AGAINST.search(before) else 0
    beside = text[start - 1 : start] + text[end : end + 1]
    border = -1 if any(c.isalnum() for c in beside) else 1
    variety = 1 if len({*span}) >= min(6, len(span) // 2) else -1
    near = sum("0" <= c <= "9" for c in before + after)
    density = -1 if near > 12 else 1 if near < 5 else 0
    return (form, structure, gazetteer, context, border, variety, density)


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that a span is personal data, per kind and vote pattern, by expectation-maximisation.

    Each labeler has, per kind, a chance of each vote for true and for false
    spans; the votes are independent given the truth.  Starts from the weighted majority.
    """
    out = {}
    for kind in KINDS:
        patterns = sorted(v for k, v in counts if k == kind)
        if not patterns:
            continue
        n = np.array([counts[kind, v] for v in patterns], float)
        seen = np.array(patterns) + 1
        p = 1 / (1 + np.exp(-((seen - 1) * np.array(TRUST)).sum(1)))
        for _ in range(rounds):
            prior = ((p * n).sum() + 1) / (n.sum() + 2)
            logs = np.full((2, len(patterns)), 0.0)
            for truth, w in enumerate(((1 - p) * n, p * n)):
                logs[truth] = math.log(prior if truth else 1 - prior)
                for labeler in range(seen.shape[1]):
                    # Pseudo-counts keep each labeler better than chance, so that the two sides cannot change places.
                    share = np.bincount(seen[:, labeler], w, 3) + ((0.5, 1.0, 2.0) if truth else (2.0, 1.0, 0.5))
                    logs[truth] += np.log(share / share.sum())[seen[:, labeler]]
            p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
        out |= {(kind, v): float(x) for v, x in zip(patterns, p)}
    return out


_SHAPES = 26


def shape(text: str, start: int, end: int) -> list[float]:
    """Features of a span's text and of the characters and the word before it."""
    span, n = text[start:end], end - start
    kinds = [sum(map(f, span)) / n for f in (str.isdigit, str.isalpha, str.isupper, str.isspace)]
    side = lambda c: [float(c == ""), float(c.isspace()), float(c in "\"'`"), float(c.isalnum())] if c else [1.0, 0.0, 0.0, 0.0]
    words = text[max(0, start - 40) : start].split()
    word = words[-1].lower().strip(".,;:!?\"'()=") if words else ""
    hashed = [0.0] * 8
    hashed[zlib.crc32(word.encode("utf-8", "replace")) % 8] = 1.0
    marks = [float(m in (words[-1] if words else "")) for m in "=:("]
    return [min(n, 64) / 64, *kinds, len({*span}) / n, *side(text[start - 1 : start]), *side(text[end : end + 1]), float(word == ""), *marks, *hashed]


def inputs(kind: str, v: tuple[int, ...], shapes: list[float]) -> list[float]:
    """What the classifier sees of a span: kind, votes for and against, the check's vote by kind, and the text."""
    own = [float(kind == k) for k in KINDS]
    return [*own, *[float(x > 0) for x in v], *[float(x < 0) for x in v], *[v[1] * x for x in own], *shapes]


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression of the probabilities ``y`` on ``x``, rows counted ``n`` times."""
    w = np.zeros(x.shape[1])
    n = n / n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - 1e-4 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


class SpanClassifier:
    """Probability of a span from its votes and its text; 0 for all before anything was learnt."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights

    def sure(self, text: str, kind: str, start: int, end: int) -> bool:
        if self.weights is None:
            return False
        z = float(np.dot(inputs(kind, votes(text, kind, start, end, False), shape(text, start, end)), self.weights))
        return z >= math.log(SURE / (1 - SURE))

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, base spans and accepted candidates), by kind as listed, then start."""
        text = text or ""
        base = base_spans(text)
        more = [c for c in candidates(text, base) if self.sure(text, *c)]
        return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def _voted(texts: list) -> dict:
    found = []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        spans = [(*s, True) for s in base] + [(*s, False) for s in candidates(text, base)]
        found.append([{"kind": k, "votes": ",".join(map(str, votes(text, k, s, e, b))), "shape": shape(text, s, e)} for k, s, e, b in spans])
    return {"spans": found}


def learn(docs: DataFrame, sample: int = SAMPLE) -> SpanClassifier:
    """A classifier trained on the spans of all texts: all vote patterns (at most 5 * 3**7) are counted, ``sample`` spans fitted."""
    spans = map_texts(docs, lambda: _voted, "spans array<struct<kind:string,votes:string,shape:array<double>>>", [])
    spans = store(spans.select(F.explode("spans").alias("s")).select("s.*"), "spans")
    read = lambda r: (r["kind"], tuple(map(int, r["votes"].split(","))))
    counts = {read(r): r["n"] for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    truth = estimate(counts)
    rows = spans.orderBy(F.xxhash64("kind", "votes", "shape"), "kind", "votes", "shape").limit(sample).collect()
    if not rows:
        return SpanClassifier()
    keys = [read(r) for r in rows]
    return SpanClassifier(fit(np.array([inputs(*k, list(r["shape"])) for k, r in zip(keys, rows)]), np.array([truth[k] for k in keys]), np.ones(len(rows))))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and n_spans of every whole text."""
    model = learn(docs)

    def work(texts: list) -> dict:
        out: dict = {c: [] for c in (*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_spans")}
        for text in texts:
            base, spans = model.spans(text)
            n = Counter(k for k, _, _ in base)
            for k in BASE_KINDS:
                out[f"n_{k}"].append(n[k])
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
            out["n_spans"].append(len(spans))
        return out

    return map_texts(docs, lambda: work, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", ["doc_id"])


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping ones the first and longest counts, the rest of the others goes too."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` (where there is one) counted anew in these rows; all rows and columns stay.

    Null texts stay null; empty, very long and repeated ones are rows like
    others; columns of any name and an empty table are kept.
    """
    model = learn(docs)
    name = "_masked"
    while name in docs.columns:
        name += "_"

    def work(texts: list) -> dict:
        return {name: [masked(t, s) if t and (s := model.spans(t)[1]) else None for t in texts]}

    done = map_texts(docs, lambda: work, f"`{name}` string")
    kind = dict(docs.dtypes)
    new = {"text": F.coalesce(name, "text")}
    if "n_chars" in kind:
        new["n_chars"] = F.when(F.col(name).isNotNull(), F.length(name).cast(kind["n_chars"])).otherwise(F.col("n_chars"))
    return done.select([new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
