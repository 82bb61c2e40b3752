"""Bytes to text: marks, declarations, and what never fails last."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte-order marks, the longest first; codecs that read any bytes; labels that mean another codec.
MARKS = ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
ANY_BYTES = (
    "iso8859-1", "iso8859-2", "iso8859-4", "iso8859-5", "iso8859-9", "iso8859-13", "iso8859-15", "iso8859-16",
    "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1257", "mac-roman", "cp437", "cp850",
)
MEANT = {"iso8859-1": "cp1252", "ascii": "cp1252"}
LAST = "cp1252"
#: Bytes of a document that are searched for its own declaration.
HEAD = 2048
_IN_HEADER = re.compile(r";\s*charset\s*=\s*\"?([\w.:+-]+)\"?", re.I | re.A)
_IN_DOCUMENT = (re.compile(r"<\?xml[^>]+encoding\s*=\s*[\"']([\w.:+-]+)[\"']", re.I | re.A), re.compile(r"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:+-]+)", re.I | re.A))


def codec(label: str | None) -> str | None:
    """The codec that a label means; None for none and for unknown ones."""
    try:
        name = codecs.lookup(label).name if label else None
    except (LookupError, ValueError):
        return None
    return MEANT.get(name, name)


def ladder(raw: bytes, media_type: str | None) -> list[str]:
    """The codecs to try, best first; those that fail on the bytes are passed over."""
    declared = codec(m.group(1)) if (m := _IN_HEADER.search(media_type or "")) else None
    head = raw[:HEAD].decode("ascii", "ignore")
    inside = next((codec(m.group(1)) for p in _IN_DOCUMENT if (m := p.search(head))), None)
    mark = next((c for m, c in MARKS if raw.startswith(m)), None)
    wide = lambda c: bool(c) and c.startswith(("utf-16", "utf-32"))
    steps = []
    if wide(mark) and not wide(declared):
        steps.append(mark)
    if declared in ANY_BYTES and not raw.isascii():
        steps.append("utf-8")  # a single-byte label reads anything, so valid UTF-8 of several bytes speaks against it
    steps += [declared, mark]
    if inside not in ANY_BYTES:
        steps.append(inside)
    return list(dict.fromkeys(filter(None, [*steps, "utf-8", inside])))


def decoded(raw: bytes | None, media_type: str | None = None) -> tuple[str | None, str | None]:
    """(text, codec) without a byte-order mark; bytes that nothing reads are replaced one by one."""
    if raw is None:
        return None, None
    for name in ladder(raw, media_type):
        try:
            return raw.decode(name).removeprefix("﻿"), name
        except (UnicodeError, LookupError):
            continue
    return raw.decode(LAST, "replace").removeprefix("﻿"), LAST


def decode_bytes(raw: Column, media_type: Column) -> Column:
    """Struct of text and codec of a binary column, by Arrow batches."""
    made = F.udf(lambda r, t: dict(zip(("text", "codec"), decoded(None if r is None else bytes(r), t))), "text string, codec string", useArrow=True)
    return made(raw, media_type)
