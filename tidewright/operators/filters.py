"""Filters compiled to one Column, so that Catalyst can push them to the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Equalities, memberships, lower bounds and one half-open window [after, before); nothing set accepts all rows."""

    equals: dict[str, object] = field(default_factory=dict)
    any_of: dict[str, Sequence] = field(default_factory=dict)
    at_least: dict[str, float] = field(default_factory=dict)
    window: tuple[str, str | None, str | None] | None = None


def compile_filters(filters: Filters) -> Column:
    parts = [F.col(c) == v for c, v in sorted(filters.equals.items())]
    for c, values in sorted(filters.any_of.items()):
        if any(v is None or str(v).strip() == "" for v in values):
            raise ValueError(f"blank value for {c}")
        parts.append(F.col(c).isin(*sorted(values)))
    parts += [F.col(c) >= v for c, v in sorted(filters.at_least.items())]
    if filters.window:
        c, after, before = filters.window
        if after is not None:
            parts.append(F.col(c) >= F.lit(after).cast("timestamp_ntz"))
        if before is not None:
            parts.append(F.col(c) < F.lit(before).cast("timestamp_ntz"))
    return reduce(and_, parts) if parts else F.lit(True)


def contains_all(column: str, values: Sequence) -> Column:
    return reduce(and_, [F.array_contains(column, v) for v in values]) if values else F.lit(True)


def overlaps(column: str, values: Sequence) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))


def json_contains(column: str, test: Callable[[Column], Column]) -> Column:
    """Whether an array of structs has an element that passes."""
    return F.exists(column, test)


def as_of(valid_from: str, valid_to: str, moment: Column) -> Column:
    """Validity at a moment: half-open, an absent end is open."""
    return (F.col(valid_from) <= moment) & (F.col(valid_to).isNull() | (F.col(valid_to) > moment))


def keyset_after(keys: Sequence[tuple[str, object]], descending: bool = True) -> Column:
    """Rows strictly after a position in the order of the keys."""
    out, equal = None, None
    for c, v in keys:
        step = F.col(c) < v if descending else F.col(c) > v
        step = step if equal is None else equal & step
        out = step if out is None else out | step
        equal = F.col(c) == v if equal is None else equal & (F.col(c) == v)
    return out if out is not None else F.lit(True)
