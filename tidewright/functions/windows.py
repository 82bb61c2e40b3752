"""Relative time windows."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

_UNITS = {"w": "weeks", "d": "days", "h": "hours"}


def parse_since(value: str, now: str | datetime) -> datetime:
    """2w, 10d or 36h before ``now``, or an ISO time."""
    now = datetime.fromisoformat(now) if isinstance(now, str) else now
    m = re.fullmatch(r"(\d+)([wdh])", value.strip().lower())
    if m:
        return now - timedelta(**{_UNITS[m[2]]: int(m[1])})
    return datetime.fromisoformat(value)
