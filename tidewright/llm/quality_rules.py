"""Risk-controlled quality rules, in DataFrame functions only.

Every text gets a few counts.  Each rule compares one ratio with a cutoff and
rejects texts at or above it.  A cutoff may be used in a stratum only if the
labelled holdout proves, by an exact binomial test, that it rejects at most a
stated share of good documents; the tests of all strata, rules and cutoffs are
Bonferroni-corrected together, so any choice among the certified cutoffs keeps
the guarantee.  Among them the one that best separates the labels is taken, and
none where no cutoff catches more bad documents than good ones.

Defined cases: a null or empty text has no words and fails the base test; a
null or unlisted language falls into stratum ``other``; without labels, or with
too few, no cutoff is certified and the base test alone decides; repeated rows
are judged row by row; other columns are passed through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import store

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Candidate cutoffs of each rule, loosest last.
CUTOFFS = {
    "symbols": [0.005, 0.01, 0.02, 0.04, 0.08, 0.16],
    "dup_lines": [0.1, 0.2, 0.3, 0.5, 0.7],
    "repeats": [0.05, 0.1, 0.15, 0.2, 0.25],
    "long_words": [9.0, 10.0, 12.0, 15.0, 20.0],
    "short_words": [0.25, 0.33, 0.4, 0.5],
}
STRATA = ("en", "de", "fr", "es")


@dataclass(frozen=True)
class Risk:
    """At most ``false_rejection`` of a stratum's good documents go, shared evenly by the rules, except with probability ``delta``."""

    false_rejection: float = 0.05
    delta: float = 0.1


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(sorted_windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice, from (hash, position) pairs sorted by hash."""

    def at(s: Column, i: Column) -> Column:
        return F.get(s, i).getField("h")

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (at(s, i - 1) == x["h"]) | (at(s, i + 1) == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    return _let(sorted_windows, lambda s: _let(positions(s), total))


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long).

    Words are runs of non-blank characters, compared in windows by 64-bit
    hashes; two different windows of one text collide with a chance below
    1e-10 even at 20,000 words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        *keep,
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    hashed = split.select(
        *keep,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    window = lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)])
    n = F.size("_hashes")
    windows = hashed.withColumn("_windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    repeat = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(_covered(pairs))
    return windows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """The compared ratio of each rule; higher is worse."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": F.col("n_words") / chars,
    }


def stratum(lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise(F.lit("other"))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate): the exact p-value of k rejections against a true rate of ``rate``.

    1 where k is not below n * rate, so that the summed terms stay few.
    """
    import math

    odds = math.log(rate) - math.log1p(-rate)
    start = F.struct((n * math.log1p(-rate)).alias("t"), F.exp(n * math.log1p(-rate)).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda acc: acc["s"])
    return F.when(k >= n * rate, F.lit(1.0)).when(k < 1, F.exp(n * math.log1p(-rate))).otherwise(total)


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def certified_cutoffs(counted: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[tuple[str, str], float]:
    """The chosen cutoff per (stratum, rule): at most 25 values, whatever the input.

    ``counted`` needs doc_id, stratum, text_key (a hash of the text) and the counts;
    ``labels`` doc_id and quality (1 good, 0 bad; the lowest counts if a document
    has several).  Documents that the base test rejects are out before and don't
    count.  The bound needs independent trials: a document counts once however often
    its row is repeated, and so does a text within a stratum, with its lowest label.
    """
    m = (len(STRATA) + 1) * sum(map(len, CUTOFFS.values()))
    rate, level = risk.false_rejection / len(CUTOFFS), risk.delta / m
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    labelled = counted.filter(~base_failed()).join(truth, "doc_id")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    one_each = labelled.groupBy("doc_id").agg(F.min(F.struct("text_key", "stratum", "_quality", *counts)).alias("h")).select("h.*")
    holdout = one_each.groupBy("stratum", "text_key").agg(F.min(F.struct("_quality", *counts)).alias("h")).select("stratum", "h.*")
    tried = [(r, c) for r, cs in CUTOFFS.items() for c in cs]
    values = rule_values()
    hits = [F.sum(F.when((F.col("_quality") == q) & (values[r] >= c), 1).otherwise(0)).alias(f"k{i}_{q}") for i, (r, c) in enumerate(tried) for q in (0, 1)]
    sums = holdout.groupBy("stratum").agg(F.sum(F.when(F.col("_quality") == 1, 1).otherwise(0)).alias("n"), *hits)
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k{i}_1").alias("k"), F.col(f"k{i}_0").alias("bad")) for i, (r, c) in enumerate(tried)]))
    tested = sums.select("stratum", "n", cells.alias("x")).select("stratum", "n", "x.*").withColumn("p", binomial_tail(F.col("k"), F.col("n"), rate))
    best = tested.filter((F.col("p") <= level) & (F.col("bad") > F.col("k"))).groupBy("stratum", "rule").agg(F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), "cutoff")).alias("b"))
    return {(r["stratum"], r["rule"]): r["b"]["cutoff"] for r in best.collect()}


def method_passes(cutoffs: dict[tuple[str, str], float]) -> Column:
    """True where no certified rule of the row's stratum rejects it."""
    values = rule_values()
    rejected = F.lit(False)
    for (s, r), c in sorted(cutoffs.items()):
        rejected = rejected | ((F.col("stratum") == s) & (values[r] >= c))
    return ~rejected


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, stratum."""
    counted = store(text_counts(docs.select("doc_id", "text", stratum().alias("stratum"), text_key()), "doc_id", "stratum", "text_key"), "rule-counts")
    cutoffs = certified_cutoffs(counted, labels, risk)
    failed = base_failed()
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & method_passes(cutoffs)).alias("kept"), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns unchanged.

    Counts are made once, on the row itself, and the cutoffs applied in a second
    look at the counts; rows travel with a row's own verdict, so repeated ids
    and null ids are judged apart.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "text", stratum().alias("stratum"), text_key())
    counted = store(text_counts(held, "_row", "doc_id", "stratum", "text_key"), "rule-rows")
    cutoffs = certified_cutoffs(counted.drop("_row"), labels, risk)
    return counted.filter(~base_failed() & method_passes(cutoffs)).select([F.col("_row").getField(c).alias(c) for c in names])
