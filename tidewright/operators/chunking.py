"""Chunks of documents with their character spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.batches import record_batches

_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(?=\S)", re.M)


def _spans(text: str, cut: re.Pattern, base: int = 0) -> list[tuple[int, int]]:
    """Spans between the cuts, without blank ends."""
    out, at = [], 0
    for end, after in [*[m.span() for m in cut.finditer(text)], (len(text), len(text))]:
        part = text[at:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((base + at + lead, base + at + len(part.rstrip())))
        at = after
    return out


def split_text(text: str | None, most: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``most`` characters.

    Paragraphs are packed while they fit; a longer one is cut at sentences, a
    longer sentence by length.  A last chunk under a quarter of ``most`` joins
    the one before if both fit.  Each further chunk starts up to ``overlap``
    characters earlier, at a sentence.
    """
    text = text or ""
    units: list[tuple[int, int]] = []
    for s, e in _spans(text, _PARAGRAPH):
        for a, b in [(s, e)] if e - s <= most else _spans(text[s:e], _SENTENCE, s):
            units += [(x, min(x + most, b)) for x in range(a, b, most)]
    packed: list[list[int]] = []
    for s, e in units:
        if packed and e - packed[-1][0] <= most:
            packed[-1][1] = e
        else:
            packed.append([s, e])
    if len(packed) > 1 and packed[-1][1] - packed[-1][0] < most // 4 and packed[-1][1] - packed[-2][0] <= most:
        packed[-2][1] = packed.pop()[1]
    starts = sorted({s for s, _ in units} | {m.end() for m in _SENTENCE.finditer(text)})
    out = []
    for i, (s, e) in enumerate(packed):
        back = [x for x in starts if max(s - overlap, e - most, 0) <= x < s] if i else []
        out.append((back[0] if back else s, e))
    return out


def split_sections(text: str | None, most: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """Chunks as by :func:`split_text` of each section alone; a section starts at a heading line, or with the text."""
    text = text or ""
    starts = sorted({0, *(m.start() for m in _HEADING.finditer(text))})
    return [(s + a, s + b) for s, e in zip(starts, [*starts[1:], len(text)]) for a, b in split_text(text[s:e], most, overlap)]


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section (from 0), start, end, level, title and path of the sections of every document.

    A section runs from its heading line (one to six # and a title) to the next one,
    blank ends left out; what stands before the first heading is a section of level 0.
    path holds the titles above it and its own.  Lines carry their offsets along,
    and the headings in force at each level are the last ones seen, unless a
    shallower one came later.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    along = Window.partitionBy("doc_id").orderBy("n")
    marks = F.regexp_extract("line", r"^[ \t]{0,3}(#{1,6})[ \t]+\S", 1)
    placed = lines.withColumns({"first": F.sum(F.length("line") + 1).over(along) - F.length("line") - 1, "level": F.length(marks)})
    title = F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^[ \t]{0,3}#{1,6}[ \t]+", "")))
    numbered = placed.withColumns({"title": title, "heads": F.sum((F.col("level") > 0).cast("int")).over(along)})
    for k in range(1, 7):
        here = F.when(F.col("level") == k, F.struct("n", "title"))
        numbered = numbered.withColumn(f"h{k}", F.last(here, ignorenulls=True).over(along))
    valid = []
    for k in range(1, 7):
        newer = [F.coalesce(F.col(f"h{j}.n") > F.col(f"h{k}.n"), F.lit(False)) for j in range(1, k)]
        stale = newer[0] if newer else F.lit(False)
        for x in newer[1:]:
            stale = stale | x
        valid.append(F.when(~stale, F.col(f"h{k}.title")))
    solid = F.length(F.trim(F.regexp_replace("line", r"\s+", " "))) > 0
    lead, trail = F.length("line") - F.length(F.regexp_replace("line", r"^\s+", "")), F.length(F.regexp_replace("line", r"\s+$", ""))
    grouped = numbered.groupBy("doc_id", "heads").agg(
        F.min(F.when(solid, F.col("first") + lead)).alias("start"), F.max(F.when(solid, F.col("first") + trail)).alias("end"),
        F.max("level").alias("level"), F.min_by("title", "n").alias("title"), F.min_by(F.array_compact(F.array(*valid)), "n").alias("path"),
    )
    kept = grouped.filter("start is not null")
    order = Window.partitionBy("doc_id").orderBy("heads")
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("section"), "start", "end", "level", "title", "path")


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text) one by one."""
    for part in parts:
        for doc, text in zip(part.column(0), part.column(1)):
            yield doc.as_py(), text.as_py()


def _sentences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for d, t in _texts(parts):
            for p, (s, e) in enumerate(_spans(t or "", _PARAGRAPH)):
                yield d, "paragraph", p, s, e
                for a, b in _spans(t[s:e], _SENTENCE, s):
                    yield d, "sentence", p, a, b

    yield from record_batches(rows(), [("doc_id", pa.int64()), ("kind", pa.string()), ("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def text_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind (paragraph or sentence), paragraph, start and end in code points of every paragraph and its sentences."""
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sentences, "doc_id long, kind string, paragraph int, start int, end int")


def _chunk(most: int, overlap: int, cut=split_text):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, i, s, e, t[s:e]) for d, t in _texts(parts) for i, (s, e) in enumerate(cut(t, most, overlap)))
        yield from record_batches(rows, [("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("chunk", pa.string())])

    return run


def chunk_documents(docs: DataFrame, most: int = 2000, overlap: int = 200, headings: bool = False) -> DataFrame:
    """doc_id, chunk_index, char_start, char_end, chunk; with ``headings`` no chunk holds parts of two sections."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunk(most, overlap, split_sections if headings else split_text), "doc_id long, chunk_index int, char_start int, char_end int, chunk string")
