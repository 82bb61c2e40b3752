"""Record fields: first usable value, versions, times, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(payload: Column, paths: Sequence[str], default: object = None) -> Column:
    """The first path of a JSON text that is there and not blank, else the default."""
    found = [F.get_json_object(payload, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in found], F.lit(default))


def version_ordinal(version: Column) -> Column:
    """major.minor.patch as one number; 0 for anything else."""
    part = lambda i: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)$", i).try_cast("bigint")
    return F.coalesce(part(1) * 1_000_000 + part(2) * 1_000 + part(3), F.lit(0)).cast("long")


def to_instant(text: Column) -> Column:
    """Epoch seconds, epoch milliseconds, ISO or compact times as UTC timestamps; null for others."""
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
    seconds = F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_seconds(seconds), F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))


def named_id(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a UTF-8 name under a namespace (hex digits), as hex without dashes."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def json_depth(raw: Column) -> Column:
    """Nested containers of a JSON text, arrays included: 0 for a scalar, null for null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]", "")
    step = lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    walked = F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, c: F.struct((s["now"] + step(c)).alias("now"), F.greatest(s["most"], s["now"] + step(c)).alias("most")))
    return walked["most"]
