"""Score arithmetic as Column expressions."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and floors of the composite scores.
CONFIDENCE_WEIGHTS = {"source_credibility": 0.35, "extraction_quality": 0.25, "content_integrity": 0.20, "corroboration": 0.20}
CONFIDENCE_FLOOR = 0.05
CORROBORATION_SOURCES = 8


def weighted_geometric_mean(parts: dict[str, Column], weights: dict[str, float], floor: float) -> Column:
    """Product of max(part, floor) ** weight."""
    return reduce(mul, [F.pow(F.greatest(parts[k], F.lit(floor)), F.lit(w)) for k, w in weights.items()])


def compose_confidence(parts: dict[str, Column]) -> Column:
    return F.least(F.lit(1.0), F.round(weighted_geometric_mean(parts, CONFIDENCE_WEIGHTS, CONFIDENCE_FLOOR), 6))


def weighted_mean_of_present(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the non-null parts, weights renormalised; null when none is present."""
    total = reduce(add, [F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in weights.items()])
    weight = reduce(add, [F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()])
    return F.when(weight > 0, total / weight)


def log_saturate(value: Column, saturation: float) -> Column:
    """log1p(value) / log1p(saturation), in 0 to 1."""
    return F.when(value <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(value) / math.log1p(saturation)))


def corroboration(platforms: Column) -> Column:
    """Spread over independent platforms; an unknown cluster counts as one."""
    return F.round(log_saturate(F.greatest(F.coalesce(platforms, F.lit(1)), F.lit(1)), CORROBORATION_SOURCES), 6)


def half_life(age: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), age / half)


def gaussian_decay(age: Column, scale: float, decay: float) -> Column:
    """1 at age 0 and ``decay`` at ``scale``."""
    return F.exp(math.log(decay) * F.pow(age / scale, 2))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def band(value: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """Name of the first cut (highest first) that the value reaches."""
    out = None
    for cut, name in cuts:
        out = F.when(value >= cut, name) if out is None else out.when(value >= cut, name)
    return out.otherwise(rest)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
