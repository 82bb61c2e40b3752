"""Where reported mentions stand in texts: exact offsets, found in tiers, each place taken once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import tokens
from tidewright.operators.batches import record_batches

# Fixed value: most mentions of a document.
LIMIT = 64
#: Inner words of a quote that texts and quotes meet on.
ANCHOR_WORDS = 4


class Folds:
    """Forms of one text whose every character knows its place in the text: letters folded one by one, and blanks in one."""

    def __init__(self, text: str):
        self.text = text
        self._lower: str | None = None
        self._single: tuple[str, list[int]] | None = None

    @staticmethod
    def lower(text: str) -> str:
        """Lower case that keeps the length: a letter whose lower form is longer stays."""
        low = text.lower()
        return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)

    def folded(self) -> str:
        if self._lower is None:
            self._lower = self.lower(self.text)
        return self._lower

    def single(self) -> tuple[str, list[int]]:
        """The folded text with every run of white space as one blank, and the place of each character; one more for the end."""
        if self._single is None:
            out, at, blank = [], [], False
            for i, c in enumerate(self.folded()):
                space = c.isspace()
                if not (space and blank):
                    out.append(" " if space else c)
                    at.append(i)
                blank = space
            self._single = "".join(out), [*at, len(self.text)]
        return self._single


def _found(hay: str, needle: str, step: int) -> Iterator[int]:
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + step)


def places(folds: Folds, surface: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Tier by tier the spans of a stripped surface: as it is (overlapping ones too), in any case, with any white space."""
    n = len(surface)
    yield "exact", [(i, i + n) for i in _found(folds.text, surface, 1)]
    low = Folds.lower(surface)
    yield "case", [(i, i + n) for i in _found(folds.folded(), low, n)]
    words = low.split()
    if len(words) > 1:
        flat, at = folds.single()
        joined = " ".join(words)
        # The place behind the last character, not the next kept one: white space may follow.
        yield "blanks", [(at[i], at[i + len(joined) - 1] + 1) for i in _found(flat, joined, len(joined))]


def locate(folds: Folds, surface: str, start: int | None = None, end: int | None = None, taken: Iterable[tuple[int, int]] = ()) -> tuple[int, int, str] | None:
    """(start, end, tier) of a surface, or None where it stands nowhere free.

    Reported offsets count if they cut out the very surface, taken or not.  Else the
    first tier with a free span decides, with the span nearest to the reported start
    (the earlier of two), or the first one without a report.
    """
    surface, taken = surface.strip(), set(taken)
    if not surface or not folds.text:
        return None
    if start is not None and end is not None and 0 <= start < end and folds.text[start:end] == surface and end <= len(folds.text):
        return None if (start, end) in taken else (start, end, "reported")
    for tier, spans in places(folds, surface):
        free = [s for s in spans if s not in taken]
        if free:
            if start is None:
                return (*free[0], tier)
            k = bisect_left(free, (start,))
            near = min(free[max(0, k - 1) : k + 1], key=lambda s: (abs(s[0] - start), s[0]))
            return (*near, tier)
    return None


def verify(text: str | None, mentions: list, limit: int = LIMIT) -> list[dict]:
    """Mentions (surface, start, end) in the order reported: those that can be located, up to ``limit``; by start, longer first."""
    folds = Folds(text or "")
    taken: dict[str, set] = {}
    out = []
    for number, m in enumerate(mentions):
        if len(out) >= limit:
            break
        surface = (m["surface"] or "").strip()
        if not surface:
            continue
        own = taken.setdefault(surface.casefold(), set())
        hit = locate(folds, surface, m["start"], m["end"], own)
        if hit is not None:
            own.add(hit[:2])
            out.append({"reported": number, "start": hit[0], "end": hit[1], "surface": folds.text[hit[0] : hit[1]], "tier": hit[2]})
    return sorted(out, key=lambda x: (x["start"], -x["end"]))


def resolve_mentions(docs: DataFrame, mentions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, reported (number among the document's mentions), start, end, surface as it stands in the text, tier, position.

    ``mentions``: doc_id, ord, surface, start, end (offsets in code points, may be
    null), taken in order of ord.  A document's mentions are looked at together,
    as each takes its place from the later ones; documents go separately.
    """
    lists = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "surface", "start", "end"))).alias("mentions"))
    told = F.transform("mentions", lambda m: F.struct(m["surface"].alias("surface"), m["start"].alias("start"), m["end"].alias("end")))
    id_ = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").join(lists, "doc_id").select("doc_id", "text", told.alias("mentions"))
    return found.mapInArrow(_verified(limit), f"doc_id {id_}, reported int, start int, end int, surface string, tier string, position int")


def _verified(limit: int):
    """Batches of (doc_id, text, mentions) to located mentions; one document's are Python objects at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = ((doc.as_py(), *m.values(), at) for doc, text, own in zip(*part.columns) for at, m in enumerate(verify(text.as_py(), own.as_py(), limit)))
            yield from record_batches(rows, [("doc_id", part.schema.field(0).type), ("reported", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("tier", pa.string()), ("position", pa.int32())])

    return run


def quote_pairs(docs: DataFrame, ids: list[str], quotes: DataFrame) -> DataFrame:
    """``ids`` of ``docs`` (with text) and item_id of the quotes that a text may hold, each pair once: (item_id, quote) meet texts on words.

    A quote's inner words are whole words of any text that holds it, so a run of up
    to ANCHOR_WORDS of them is looked for, in any case.  Quotes of one or two words
    have no inner word and are tried on all texts.  Only ids and words travel.
    """
    low = lambda c: tokens(F.lower(F.col(c)))
    sized = quotes.filter("quote != ''").select("item_id", "quote", low("quote").alias("w")).withColumn("n", F.least(F.size("w") - 2, F.lit(ANCHOR_WORDS)))
    out = None
    for row in sized.filter("n > 0").select("n").distinct().sort("n").collect():  # ANCHOR_WORDS rows at most
        n = row["n"]
        anchors = sized.filter(F.col("n") == n).select("item_id", F.array_join(F.slice("w", 2, n), " ").alias("anchor"))
        words = docs.select(*ids, low("text").alias("w")).filter(F.size("w") >= n)
        grams = words.select(*ids, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " ")))).alias("anchor"))
        met = grams.join(anchors, "anchor").select(*ids, "item_id").distinct()
        out = met if out is None else out.unionByName(met)
    short = sized.filter("n <= 0").select("item_id", "quote")
    if not short.isEmpty():
        direct = docs.select(*ids, "text").join(short, F.contains(F.lower("text"), F.lower("quote"))).select(*ids, "item_id")
        out = direct if out is None else out.unionByName(direct)
    return docs.select(*ids).limit(0).withColumn("item_id", F.lit(None).cast("long")) if out is None else out


def quote_hits(docs: DataFrame, ids: list[str], quotes: DataFrame) -> DataFrame:
    """``ids``, item_id and position (from 1) of the first place of every quote that a whole text holds, as it is."""
    pairs = quote_pairs(docs, ids, quotes)
    texts = pairs.join(docs.select(*ids, "text"), ids).join(quotes, "item_id")
    return texts.filter(F.contains("text", "quote")).select(*ids, "item_id", F.expr("instr(text, quote)").cast("long").alias("position")).distinct()
