"""Sharding by histogram sort.

Rows are ordered by a 64-bit hash of their text, then by one of a number that each
row got when it was stored, so equal texts stay together unless their group is too
large for an even cut, and rows that are equal in all columns can be parted too.
Splitters between shards start as candidate key boundaries; exact bytes and
rows below each are counted over all partitions, and every interval that still
holds a wanted cut is probed again more finely, until the cuts are within the
tolerance or fall between two neighbouring keys.  A cut that misses by more than
GROUP_SHARE of a shard is then sought in the same way by the second hash, inside
the group of copies that it falls in.  Then rows are exchanged once, into ranges of
a shard: cells of the key's first bits, of RANGE_BYTES or RANGE_ROWS on average at
most; a cell that a group of copies fills beyond that is dealt out by the second
hash.  Cells are counted before, so that rows are numbered within them and stay
without gaps.

Defined cases: a null text counts as 1 byte and sits with other nulls; a text of
any length is one row and never cut; a shard can miss its even share by GROUP_SHARE
or the size of one row; with fewer rows than shards some shards are empty; an empty
table gives an empty result; further columns stay in ``place``, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import join_ids, store

#: Intervals that one probed interval is divided into, by the next bits of the key.
STEP_BITS = 8
TOLERANCE = 0.0005
#: A cut goes through a group of copies where it would miss by more than this share of a shard or range.
GROUP_SHARE = 0.01
#: Bytes of text and rows in one range of the exchange.
RANGE_BYTES, RANGE_ROWS = 64 << 20, 1 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def _counts(rows: DataFrame, shift: int, open_: list[int] | None) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) per interval of keys that agree above ``shift`` bits, within the opened parents."""
    cell = F.shiftright(F.col("key"), shift)
    own = rows if open_ is None else rows.filter(F.shiftright(F.col("key"), shift + STEP_BITS).isin(open_))
    got = own.groupBy(cell.alias("cell")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["cell"]: (r["b"], r["n"]) for r in got}


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE, goals: list[float] | None = None) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) of the ``parts`` - 1 cuts; ``rows`` has key and size.

    With ``goals`` (bytes below each cut) the tolerance is in bytes.

    Each pass collects at most parts * 2**STEP_BITS counts.
    """
    shift = 64 - STEP_BITS
    cells = {c: v for c, v in _counts(rows, shift, None).items()}
    total = sum(b for b, _ in cells.values())
    slack = tolerance if goals is not None else tolerance * total / parts
    goals = [total * i / parts for i in range(1, parts)] if goals is None else goals
    best: dict[int, tuple[int, int, int]] = {}
    pending: dict[int, tuple[int, int, int]] = {}

    def look(cells: dict[int, tuple[int, int]], shift: int, below: tuple[int, int], goal: float, g: int, first: int, end: int) -> None:
        b, n = below
        edge = (first << shift, b, n)
        for c in sorted(x for x in cells if first <= x < end):
            after = (b + cells[c][0], n + cells[c][1])
            if after[0] >= goal:
                low, high = (c << shift, b, n), ((c + 1) << shift, *after)
                for cut in (low, high):
                    if g not in best or abs(cut[1] - goal) < abs(best[g][1] - goal):
                        best[g] = cut
                if abs(best[g][1] - goal) > slack and shift:
                    pending[g] = (c, b, n)
                return
            b, n = after
            edge = ((c + 1) << shift, b, n)
        if g not in best or abs(edge[1] - goal) < abs(best[g][1] - goal):
            best[g] = edge

    for g, goal in enumerate(goals):
        look(cells, shift, (0, 0), goal, g, -(1 << (STEP_BITS - 1)), 1 << (STEP_BITS - 1))
    while pending:
        shift -= STEP_BITS
        todo, pending_now = dict(pending), {}
        pending.clear()
        cells = _counts(rows, shift, sorted({c for c, _, _ in todo.values()}))
        for g, (c, b, n) in todo.items():
            look(cells, shift, (b, n), goals[g], g, c << STEP_BITS, (c + 1) << STEP_BITS)
        pending.update(pending_now)
    return [best[g] for g in range(len(goals))]


def _inside(rows: DataFrame, cuts: list[tuple[int, int, int]], goals: list[float], slack: float) -> list[tuple[int, int, int, int]]:
    """(key, sub, bytes below, rows below): cuts that miss their goal by more than ``slack`` move into the group they miss by."""
    found = [(k, LEAST, b, n) for k, b, n in cuts]
    # A cut stands before or behind the group that holds its goal; its neighbour key is that group.
    missed = [g for g, c in enumerate(cuts) if abs(c[1] - goals[g]) > slack]
    if not missed:
        return found
    near = [F.when(F.lit(cuts[g][1] > goals[g]), F.max(F.when(F.col("key") < F.lit(cuts[g][0]), F.col("key")))).otherwise(F.min(F.when(F.col("key") >= F.lit(min(cuts[g][0], MOST)), F.col("key")))).alias(f"k{g}") for g in missed]
    group = dict(zip(missed, rows.agg(*near).first()))
    keys = sorted({k for k in group.values() if k is not None})
    below = rows.agg(*[F.sum(F.when(F.col("key") < F.lit(k), F.col("size")).otherwise(0)) for k in keys], *[F.sum(F.when(F.col("key") < F.lit(k), 1).otherwise(0)) for k in keys]).first()
    for i, key in enumerate(keys):
        own = [g for g in missed if group[g] == key]
        part = rows.filter(F.col("key") == F.lit(key)).select(F.col("sub").alias("key"), "size")
        b0, n0 = below[i], below[len(keys) + i]
        inner = splitters(part, 2, slack, [goals[g] - b0 for g in own])
        for g, (sub, b, n) in zip(own, inner):
            if abs(b0 + b - goals[g]) < abs(found[g][2] - goals[g]):
                found[g] = (key, sub, b0 + b, n0 + n)
    return found


def cuts_of(rows: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int, int]]:
    """Cuts into ``parts`` of even size; ``rows`` has key, sub and size."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    goals = [total * i / parts for i in range(1, parts)]
    return _inside(rows, splitters(rows, parts, tolerance), goals, GROUP_SHARE * total / parts) if total else []


def _bits(size: Column) -> Column:
    """Bits by which a cell of so many ranges is dealt out."""
    return F.when(size > 1, F.ceil(F.log2(size))).otherwise(0).cast("int")


def place(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, plus size, key, shard and slot.

    Rows are stored first, each with its number, so that all counts and the one
    exchange see the same; a shard's slots follow its ranges.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), _key().alias("key"))
    rows = store(keyed.withColumn("sub", F.xxhash64(F.monotonically_increasing_id())), "rows")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    found = [(min(k, MOST), s) if k <= MOST else (MOST, MOST) for k, s, *_ in cuts_of(rows, shards, tolerance)]
    cuts = sorted(set(found))
    # Two cuts at one place leave an empty shard between them.
    home = [sum(c <= k for c in found) for k in cuts]
    shard = F.lit(0)
    if cuts:
        # Position among the sorted cuts, as a balanced tree of comparisons.
        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(home[lo - 1] if lo else 0)
            mid = (lo + hi) // 2
            before = (F.col("key") < F.lit(cuts[mid][0])) | ((F.col("key") == F.lit(cuts[mid][0])) & (F.col("sub") < F.lit(cuts[mid][1])))
            return F.when(before, tree(lo, mid)).otherwise(tree(mid + 1, hi))

        shard = tree(0, len(cuts))
    bits = max(0, math.ceil(math.log2(max(1, 2 * total / RANGE_BYTES, 2 * n_rows / RANGE_ROWS))))
    cell = F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long")
    placed = rows.select("row", "size", "key", "sub", shard.cast("int").alias("shard"), cell.alias("cell"))
    narrow = placed.select("size", "sub", "shard", "cell")
    ranges = F.greatest(F.sum("size") / RANGE_BYTES, F.count("*") / RANGE_ROWS)
    large = store(narrow.groupBy("shard", "cell").agg(_bits(ranges).alias("more")).filter("more > 0"), "large-cells")
    n_large = large.count()

    def dealt(table: DataFrame) -> DataFrame:
        if not n_large:
            return table.withColumn("part", F.lit(0).cast("long"))
        marked = join_ids(table, large, n_large, ["shard", "cell"], "left", 24)
        return marked.withColumn("part", F.when(F.col("more").isNull(), F.lit(0).cast("long")).otherwise(F.expr("shiftright(sub, 64 - more)"))).drop("more")

    counted = dealt(narrow).groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = store(counted.select("shard", "cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranges")
    order = Window.partitionBy("shard", "cell", "part").orderBy("key", "sub")
    numbered = dealt(placed).withColumn("at", F.row_number().over(order) - 1)
    found = join_ids(numbered, base, base.count(), ["shard", "cell", "part"], "inner", 32)
    return found.select("row", "size", "key", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))


def range_of(key: int, cuts: list[int]) -> int:
    """The range a key falls in, as ``place`` decides it."""
    return bisect_right(cuts, key)
