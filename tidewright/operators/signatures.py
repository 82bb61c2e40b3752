"""MinHash signatures, their bands, and estimated similarities."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERMUTATIONS, BANDS = 128, 16
#: Fixed value: the prime of the permutations.
PRIME = (1 << 61) - 1
_INVISIBLE = re.compile("[­​-‏‪-‮⁠﻿]")


def folded(text: str | None) -> str:
    """Compatibility forms unified, invisible characters gone, lower case, single blanks."""
    return " ".join(_INVISIBLE.sub("", unicodedata.normalize("NFKC", text or "")).lower().split())


def hashed(features) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f.encode("utf-8", "replace"), digest_size=8).digest(), "big") for f in features], np.uint64)


def word_grams(text: str | None, size: int = 3) -> list[str]:
    words = re.findall(r"\w+", folded(text))
    return ["\x1f".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else words


@lru_cache(maxsize=4)
def coefficients(count: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the permutations, from digests of their numbers."""
    numbers = [int.from_bytes(hashlib.blake2b(side + i.to_bytes(4, "big"), digest_size=8).digest(), "big") % PRIME for side in (b"a", b"b") for i in range(count)]
    return np.array([x or 1 for x in numbers[:count]], np.uint64), np.array(numbers[count:], np.uint64)


def permuted(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(a * x + b) mod 2**61 - 1 by halves of 31 bits, since 2**61 counts as 1."""
    low, thirty, p = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(PRIME)
    s31, s30, s61 = np.uint64(31), np.uint64(30), np.uint64(61)
    ah, al, xh, xl = a >> s31, a & low, x >> s31, x & low
    middle = ah * xl + al * xh
    total = ((ah * xh) << np.uint64(1)) + (middle >> s30) + ((middle & thirty) << s31)
    total = (total & p) + (total >> s61) + al * xl
    total = (total & p) + (total >> s61) + b
    total = (total & p) + (total >> s61)
    return np.where(total >= p, total - p, total)


def signature(text: str | None, count: int = PERMUTATIONS) -> np.ndarray:
    """The smallest permuted hash of the text's different word trigrams under each permutation; empty without words."""
    grams = {*word_grams(text)}
    if not grams:
        return np.empty(0, np.uint64)
    x = np.unique(hashed(grams) % np.uint64(PRIME))
    a, b = coefficients(count)
    least = np.full(count, PRIME, np.uint64)
    for s in range(0, len(x), 4096):
        least = np.minimum(least, permuted(a[:, None], b[:, None], x[None, s : s + 4096]).min(axis=1))
    return least


def identity_print(text: str | None) -> int:
    """The second, frozen SimHash as a signed number: folded ASCII letters and digits, trigrams joined by blanks."""
    words = re.findall("[0-9a-z]+", unicodedata.normalize("NFKC", text or "").casefold())
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else words
    if not grams:
        return 0
    places = np.arange(64, dtype=np.uint64)
    votes = np.zeros(64, np.int64)
    for s in range(0, len(grams), 4096):
        bits = ((hashed(grams[s : s + 4096])[:, None] >> places) & np.uint64(1)).astype(np.int64)
        votes += (2 * bits - 1).sum(axis=0)
    return int((np.uint64(1) << places[votes > 0]).sum(dtype=np.uint64).view(np.int64))


def _each_text(make, name: str, kind: pa.DataType):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in range(0, part.num_rows, 512):
                now = part.slice(s, 512)
                yield pa.RecordBatch.from_arrays([now.column(0), pa.array([make(t) for t in now.column(1).to_pylist()], kind)], ["doc_id", name])

    return run


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id and the signature of every whole text; an empty array without words."""
    make = lambda t: signature(t).astype(np.int64)
    return docs.select("doc_id", "text").mapInArrow(_each_text(make, "signature", pa.list_(pa.int64())), "doc_id bigint, signature array<bigint>")


def identity_prints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_each_text(identity_print, "print", pa.int64()), "doc_id bigint, print bigint")


def signature_bands(column: str = "signature", bands: int = BANDS) -> Column:
    """One key per band, the band's number before a hash of its values; rows of equal bands share it."""
    rows = PERMUTATIONS // bands
    return F.when(F.size(column) > 0, F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.sha1(F.array_join(F.slice(column, i * rows + 1, rows), ",").cast("binary"))))).otherwise(F.array().cast("array<string>"))


def agreement(a: Column, b: Column) -> Column:
    """Share of positions on which two signatures agree: the estimated similarity; 0 if one is empty."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), equal / F.size(a)).otherwise(F.lit(0.0))


def print_bands(value: Column, bands: int = 4) -> Column:
    """Band keys of a 64-bit fingerprint as number:hex."""
    width = 64 // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(F.call_function("shiftrightunsigned", value, i * width).bitwiseAND(F.lit((1 << width) - 1))), width // 4, "0"))))
