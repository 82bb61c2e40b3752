"""Keyword phrases of documents: runs of content words, scored by degree over frequency."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Longest phrase in words and characters, the boost of entity names, phrases kept a document.
MOST_WORDS, MOST_CHARS, ENTITY_BOOST, KEPT = 3, 60, 1.5, 12
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*")
_SCHEMA = "doc_id bigint, at int, surface string, words array<string>"


def runs(text: str | None, stops: frozenset[str]) -> Iterator[tuple[str, list[str]]]:
    """(surface, folded words) of every phrase, in order: content words with only blanks between, MOST_WORDS at most.

    Stop words, numbers and single characters end a phrase and belong to none;
    a phrase of over MOST_CHARS characters is not returned.
    """
    text, held, last = text or "", [], 0
    for found in [*_WORD.finditer(text), None]:
        word = found.group() if found else ""
        content = len(word) > 1 and not word.isdigit() and word.casefold() not in stops
        apart = not found or text[last : found.start()].strip() != ""
        if held and (apart or not content or len(held) == MOST_WORDS):
            surface = " ".join(text[held[0].start() : held[-1].end()].split())
            if len(surface) <= MOST_CHARS:
                yield surface, [w.group().casefold() for w in held]
            held = []
        if found:
            last = found.end()
            if content:
                held.append(found)


def _scan(docs: DataFrame, phrases: Callable[[str | None], list[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Rows of (doc_id, at and the parts of a phrase) of what ``phrases`` finds in each text."""
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                rows = [(doc, at, *phrase) for at, phrase in enumerate(phrases(text.as_py()))]
                for s in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[s : s + 10_000]), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def candidate_phrases(docs: DataFrame, stops: Iterable[str]) -> DataFrame:
    """(doc_id, at, surface, words) of every phrase of every whole text; nothing for a null or blank one."""
    stops = frozenset(s.casefold() for s in stops)
    return _scan(docs, lambda text: list(runs(text, stops)), _SCHEMA, [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())])


def weighed(found: list[tuple[str, list[str]]]) -> list[tuple[str, float]]:
    """(surface, score) of a text's phrases: the sum of what :func:`word_scores` gives their words."""
    degree, times = Counter(), Counter()
    for _, words in found:
        times.update(words)
        for w in words:
            degree[w] += len(words)
    return [(surface, sum(degree[w] / times[w] for w in words)) for surface, words in found]


def scored_phrases(docs: DataFrame, stops: Iterable[str]) -> DataFrame:
    """(doc_id, at, surface, score) of every phrase, for :func:`keywords`; words are counted where the text is, so none travel.

    A document is one row: doc_id tells it from all others.
    """
    stops = frozenset(s.casefold() for s in stops)
    return _scan(docs, lambda text: weighed(list(runs(text, stops))), "doc_id bigint, at int, surface string, score double", [pa.int64(), pa.int32(), pa.string(), pa.float64()])


def word_scores(phrases: DataFrame) -> DataFrame:
    """(doc_id, word, score): words of a document by degree (sizes of the phrases they stand in) over frequency."""
    words = phrases.select("doc_id", F.size("words").alias("span"), F.explode("words").alias("word"))
    return words.groupBy("doc_id", "word").agg((F.sum("span") / F.count("*")).alias("score"))


def keywords(phrases: DataFrame, entities: DataFrame | None = None, kept: int = KEPT) -> DataFrame:
    """(doc_id, term, weight, position): the best phrases of every document, the best one at 1.

    A phrase is written as where it first stands and counts once however often
    it occurs; those that hold one of the document's ``entities`` (doc_id,
    surface) are boosted.  Ties go by occurrences, then by the folded phrase.
    ``phrases`` with scores, of :func:`scored_phrases`, are dealt out by document once.
    """
    key = F.lower("surface").alias("key")
    if "score" in phrases.columns:
        raw = phrases.repartition("doc_id").groupBy("doc_id", key).agg(F.min_by(F.struct("surface", "score"), "at").alias("first"), F.count("*").alias("times")).select("doc_id", "key", F.col("first.surface").alias("term"), "times", "first.score")
    else:
        seen = phrases.groupBy("doc_id", key).agg(F.min_by("surface", "at").alias("term"), F.min_by("words", "at").alias("words"), F.count("*").alias("times"))
        scored = seen.select("doc_id", "key", "term", "times", F.explode("words").alias("word")).join(word_scores(phrases), ["doc_id", "word"])
        raw = scored.groupBy("doc_id", "key").agg(F.first("term").alias("term"), F.first("times").alias("times"), F.sum("score").alias("score"))
    if entities is not None:
        named = entities.filter(F.trim("surface") != "").select("doc_id", F.lower("surface").alias("entity")).distinct()
        boosted = raw.join(named, "doc_id").filter(F.contains("key", F.col("entity"))).select("doc_id", "key").distinct().withColumn("boost", F.lit(ENTITY_BOOST))
        raw = raw.join(boosted, ["doc_id", "key"], "left").withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0)))
    of = Window.partitionBy("doc_id")
    order = of.orderBy(F.desc(F.round("score", 9)), F.desc("times"), "key")
    placed = raw.withColumn("position", F.row_number().over(order).cast("long")).withColumn("best", F.max("score").over(of))
    return placed.filter(F.col("position") <= kept).select("doc_id", "term", F.round(F.col("score") / F.col("best"), 4).alias("weight"), "position")
