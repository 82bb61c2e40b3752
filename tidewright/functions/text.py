"""Text expressions: canonical forms, tokens, shingles, fingerprints."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters and attribution parameters.
ZERO_WIDTH = "[­​-‏‪-‮⁠﻿]"
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_", "matomo_", "piwik_", "hsa_", "vero_")
TRACKING_NAMES = (
    "fbclid", "gclid", "gclsrc", "dclid", "wbraid", "gbraid", "msclkid",
    "twclid", "ttclid", "igshid", "igsh", "yclid", "li_fat_id", "mkt_tok",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsctatracking",
    "s_kwcid", "ef_id", "trk", "trkcampaign", "icid", "ncid", "spm", "scm",
    "ref_src", "ref_url", "guccounter", "guce_referrer", "guce_referrer_sig",
    "at_medium", "at_campaign", "_openstat", "wt_mc", "wt_zmc",
    "action_object_map", "action_type_map", "action_ref_map",
    "__twitter_impression", "cmpid", "cvid",
)


def collapse_whitespace(text: Column) -> Column:
    """Runs of blanks become one, blank lines keep one paragraph break, invisible characters go."""
    clean = F.regexp_replace(F.regexp_replace(text, ZERO_WIDTH, ""), r"\r\n?", "\n")
    lines = F.regexp_replace(F.regexp_replace(clean, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def dedup_form(text: Column) -> Column:
    """Lower case, single blanks, no invisible characters: what content hashes are taken over (without Unicode folding)."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, ZERO_WIDTH, "")), r"\s+", " "))


# Campaign parameters of addresses inside texts, and tails that feeds append.
CAMPAIGN = ("fbclid", "gclid", "gbraid", "wbraid", "msclkid", "yclid", "igshid", "mc_cid", "mc_eid", "_hsenc", "_hsmi")
ADDRESS = r"""(?i)https?://[^\s<>"')\]]+"""
TAIL = r"(?i)\s*(?:[\[(]\s*)?(?:…|\.{3})?\s*(?:read more|read the full (?:story|article)|continue reading|see more|view more|view full article|full story|the post .{0,160}? appeared first on .{0,80})\s*[.…]*\s*(?:[\])])?\s*$"
TAILS = 3


def replaced_by(text: Column, pattern: str, made) -> Column:
    """``text`` with what ``made`` returns for each match of ``pattern`` in its place."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(between, F.array_append(F.transform(found, made), F.lit("")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pairs, "")).otherwise(text)


def plain_address(url: Column) -> Column:
    """Scheme and host in lower case, no campaign parameters, no fragment; the other parameters in order, encoded one way."""
    bare = F.split(url, "#", 2)[0]
    head, params = F.split(bare, r"\?", 2)[0], F.get(F.split(bare, r"\?", 2), F.lit(1))
    start = F.concat(F.lower(F.regexp_extract(head, "^[A-Za-z]+://[^/]*", 0)), F.regexp_replace(head, "^[A-Za-z]+://[^/]*", ""))
    coded = lambda x: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    each = F.filter(F.split(F.coalesce(params, F.lit("")), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=", 2)[0]).isin(*CAMPAIGN) & ~F.lower(p).startswith("utm_"))
    kept = F.transform(each, lambda p: F.concat(coded(F.split(p, "=", 2)[0]), F.lit("="), coded(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit("")))))
    return F.concat(start, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def mapped(text: Column, f: Callable[[str], str]) -> Column:
    """A function of the standard library that Spark lacks, over a column of strings by Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else f(x))

    return run(text)


def compatible(text: Column) -> Column:
    """NFKC."""
    return mapped(text, lambda x: unicodedata.normalize("NFKC", x))


def canonical_text(text: Column) -> Column:
    """What content hashes are taken over: compatible characters, none invisible, plain addresses, lower case, single blanks, and up to TAILS tails of feeds gone."""
    out = replaced_by(F.regexp_replace(compatible(text), ZERO_WIDTH, ""), ADDRESS, plain_address)
    out = F.trim(F.regexp_replace(F.lower(out), r"(?U)\s+", " "))
    for _ in range(TAILS):
        out = F.trim(F.regexp_replace(out, TAIL, ""))
    return out


# Patterns and marks of personal data.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
CARD = r"(?<![\d\-])(?:\d[ \-]?){12,18}\d(?![\d\-])"
PHONE = r"(?U)(?<![\w+])(?:\+\d{1,3}[\s.\-]?(?:\(?\d{1,4}\)?[\s.\-]?){1,4}\d{2,4}|\(\d{2,4}\)\s?\d{2,4}[\s.\-]?\d{2,4}|\b\d{3}[.\-]\d{3}[.\-]\d{4}\b)(?!\w)"


def redacted(text: Column) -> Column:
    """Addresses, then card numbers that pass Luhn's test, then phone numbers, each by its mark."""
    digits = lambda c: F.regexp_replace(c, r"[ \-]", "")
    card = lambda c: F.when(F.length(digits(c)).between(13, 19) & F.call_function("luhn_check", digits(c)), "[CARD]").otherwise(c)
    return F.regexp_replace(replaced_by(F.regexp_replace(text, EMAIL, "[EMAIL]"), CARD, card), PHONE, "[PHONE]")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def shingles(words: Column, size: int = 3) -> Column:
    """Overlapping n-grams; texts shorter than ``size`` give their words."""
    n = F.size(words)
    return F.when(n < size, words).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), "\x1f")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_tracking(name: Column) -> Column:
    low = F.lower(name)
    found = low.isin(*TRACKING_NAMES)
    for p in TRACKING_PREFIXES:
        found = found | low.startswith(p)
    return found


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, tracking parameters or fragment; parameters sorted."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", 0)
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    scheme, host, path, params = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    bare = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    kept = F.array_sort(F.filter(F.split(params, "&"), lambda p: (p != "") & ~is_tracking(F.split(p, "=")[0])))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(head == "", "").otherwise(F.concat(scheme, F.lit("://"), bare, F.when(path == "", "/").otherwise(path), tail))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def elide_middle(text: Column, limit: int) -> Column:
    """Texts over ``limit`` keep two thirds of it from the start and the rest from the end."""
    head = limit * 2 // 3
    tail = limit - head
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" ... "), F.right(text, F.lit(tail))))


def primary_subtag(code: Column) -> Column:
    return F.lower(F.split(code, "-")[0])


def language_tag(code: Column) -> Column:
    """Language in lower case, a two-letter region in upper case; blank is und."""
    low = F.lower(F.trim(code))
    region = F.split(low, "-")[1]
    return F.when(low == "", "und").when(low.rlike("^[^-]*-[^-]{2}$"), F.concat(F.split(low, "-")[0], F.lit("-"), F.upper(region))).otherwise(low)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def lucene_safe(text: Column, most: int = 12) -> Column:
    """Quoted words joined by OR; words of one character are left out."""
    words = F.filter(tokens(text), lambda w: F.length(w) >= 2)
    return F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")
