"""Rows that Python tasks hand back, a few at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa

#: Rows of one batch.
ROWS = 1000


def record_batches(rows: Iterable[tuple], fields: list[tuple[str, pa.DataType]], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """``rows`` as Arrow batches of at most ``most`` rows (ROWS), made while they are asked for, so that no more are held."""
    rows, schema = iter(rows), pa.schema(fields)
    while held := list(islice(rows, most or ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
