"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines.  Along each line the vectors
are sorted, a window is centred on each of them, and the number of lines on
which two vectors lie in each other's window is counted.  The windows' width and
the count that a pair must reach follow from the similarity: a pair at the
threshold reaches it with the stated recall.  Pairs that do are verified by
their cosine in double precision.

So that not all vectors meet, the counting runs within cells: vectors whose
projections on a few further lines fall in the same strips, in each of TABLES
independent tables, again with known recall.  A pair that meets in several
tables counts in the first.  Large cells are cut into blocks, and every pair of
blocks is a group of its own.  Groups return sums of links and a spanning forest,
never their pairs.

Defined cases: equal vectors are collapsed before and linked with each other,
repeated rows among them; extra columns are ignored;
null, zero or empty vectors and those with a null or non-finite component link
with nothing; vectors of different lengths are not compared; a null vec_id gets
no component and isn't kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import join_ids, map_texts, store, tidy
from tidewright.llm.components import connected_components, local_forest

THRESHOLD = 0.95
#: Lines on which collisions are counted, half of a window's width in standard deviations of a pair at the threshold, and the share of such pairs that must reach the count.
LINES, WINDOW, RECALL = 32, 1.3, 0.995
#: Tables of cells, strips that make a cell, and a strip's width where a random pair differs by sqrt(2) on average.
TABLES, STRIPS, WIDTH = 8, 8, 2.4
#: Vectors in one block of a cell.
BLOCK = 1024


def needed_collisions(lines: int = LINES, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall`` at least."""
    p = math.erf(window / math.sqrt(2))
    tail, need = 0.0, 0
    for k in range(lines, -1, -1):
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail >= recall:
            need = k
            break
    return need


def _lines(dim: int, n: int, salt: int) -> np.ndarray:
    return np.random.default_rng([20240611, dim, salt]).standard_normal((dim, n))


def _unit(values: np.ndarray) -> np.ndarray | None:
    v = values.astype(np.float64)
    size = np.abs(v).max(initial=0.0)
    if not len(v) or not np.isfinite(v).all() or not size > 0:
        return None
    v = v / size
    return v / np.sqrt(v @ v)


def _digests(vectors: list) -> dict:
    """Digest of each usable vector, null for the others."""
    keys = []
    for e in vectors:
        v = None if e is None else np.array([np.nan if x is None else x for x in e], np.float64)
        ok = v is not None and _unit(v) is not None
        keys.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if ok else None)
    return {"digest": keys}


def _keys(dim: int, x: np.ndarray) -> np.ndarray:
    """The keys of the cells of unit vectors in all tables."""
    at = x @ _lines(dim, TABLES * STRIPS, 1)
    shift = np.random.default_rng([20240612, dim]).uniform(0, WIDTH, TABLES * STRIPS)
    strip = np.ascontiguousarray(np.floor((at + shift) / WIDTH).astype(np.int64).reshape(len(x), TABLES, STRIPS).transpose(2, 0, 1))
    key = np.broadcast_to(np.random.default_rng([20240613, dim]).integers(0, 2**64, TABLES, dtype=np.uint64), (len(x), TABLES))
    for s in range(STRIPS):
        key = (key + strip[s].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    return key.view(np.int64)


def _cells(vectors: list) -> dict:
    """Digest and cell keys of each usable vector, nulls for the others."""
    out = {**_digests(vectors), "keys": [None] * len(vectors)}
    usable = [i for i, d in enumerate(out["digest"]) if d is not None]
    for dim in {len(vectors[i]) for i in usable}:
        same = [i for i in usable if len(vectors[i]) == dim]
        for i, k in zip(same, _keys(dim, np.stack([_unit(np.array(vectors[i])) for i in same]))):
            out["keys"][i] = k
    return out


def _collisions(p: np.ndarray, q: np.ndarray, half: float) -> np.ndarray:
    """Lines on which each column of ``q`` lies in the window around each row of ``p``: lists sorted once, windows as ranges of ranks."""
    counts = np.zeros((len(p), len(q)), np.uint8)
    for j in range(p.shape[1]):
        order = np.argsort(q[:, j], kind="stable")
        line = q[order, j]
        rank = np.empty(len(q), np.int16)
        rank[order] = np.arange(len(q), dtype=np.int16)
        lo = np.searchsorted(line, p[:, j] - half, "left").astype(np.int16)
        hi = np.searchsorted(line, p[:, j] + half, "right").astype(np.int16)
        counts += (rank >= lo[:, None]) & (rank < hi[:, None])
    return counts


def _group(at: int, left: dict, right: dict | None, need: int, half: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j) of the verified links of one group whose first common table is this one."""
    other = right or left
    lines = _lines(left["vector"].shape[1], LINES, 2)
    p, q = left["vector"] @ lines, other["vector"] @ lines
    hit = _collisions(p, q, half) >= need
    if right is None:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    for s in range(0, len(i), 100_000):
        a, b = i[s : s + 100_000], j[s : s + 100_000]
        close = np.einsum("ij,ij->i", left["vector"][a], other["vector"][b]) >= THRESHOLD
        a, b = a[close], b[close]
        first = (left["keys"][a] == other["keys"][b]).argmax(axis=1) == at
        yield a, b, first


def _links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group: sums of linked weights (v null) and edges of a spanning forest; rows come sorted by group."""
    need, half = needed_collisions(), WINDOW * math.sqrt(2 - 2 * THRESHOLD)
    held: list[pa.RecordBatch] = []
    key = None

    def solve() -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held)
        # Rows that repeat a vector and its id are one.
        _, once = np.unique(np.stack((rows["side"].to_numpy(), rows["id"].to_numpy())), axis=1, return_index=True)
        rows = rows.take(pa.array(once))
        side = rows["side"].to_numpy()
        col = {"id": rows["id"].to_numpy(), "weight": rows["weight"].to_numpy()}
        flat = rows["keys"].combine_chunks()
        col["keys"] = flat.flatten().to_numpy().reshape(len(flat), -1)
        flat = rows["vector"].combine_chunks()
        col["vector"] = np.stack([_unit(v) for v in flat.flatten().to_numpy().reshape(len(flat), -1)])
        left = {c: v[side == 0] for c, v in col.items()}
        right = {c: v[side == 1] for c, v in col.items()} if (side == 1).any() else None
        two = rows["two"][0].as_py()
        if not len(left["id"]) or (two and right is None):
            return None
        other = right or left
        n_left, n_other = np.zeros(len(left["id"]), np.int64), np.zeros(len(other["id"]), np.int64)
        u, v = [], []
        for a, b, first in _group(rows["at"][0].as_py(), left, right, need, half):
            x, y = a[first], b[first]
            n_left += np.bincount(x, other["weight"][y], len(n_left)).astype(np.int64)
            n_other += np.bincount(y, left["weight"][x], len(n_other)).astype(np.int64)
            u.append(left["id"][a])
            v.append(other["id"][b])
        forest = local_forest(np.concatenate(u).tolist(), np.concatenate(v).tolist()) if u else {}
        edges = [(x, r) for x, r in forest.items() if x != r]
        ids, sums = np.concatenate((left["id"], other["id"])), np.concatenate((n_left, n_other))
        ids, sums = ids[sums > 0], sums[sums > 0]
        return pa.RecordBatch.from_arrays(
            [pa.array([*ids.tolist(), *[x for x, _ in edges]], pa.int64()), pa.array([*[None] * len(ids), *[r for _, r in edges]], pa.int64()), pa.array([*sums.tolist(), *[0] * len(edges)], pa.int64())], ["u", "v", "links"]
        )

    for batch in parts:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in ("at", "cell", "i", "j")])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cut[:-1], cut[1:]):
            now = tuple(k[:, s])
            if now != key and held:
                if (out := solve()) is not None:
                    yield out
                held = []
            key = now
            held.append(batch.slice(s, e - s))
    if held and (out := solve()) is not None:
        yield out


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors travel once, to their cells, in the type they are stored in; what is
    written before is ids, digests and cell keys.
    """
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    clean = store(map_texts(given, lambda: _cells, "digest binary, keys array<long>", ["vec_id"], "vector"), "vectors")
    usable = clean.filter("digest is not null and vec_id is not null")
    classes = store(usable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("keys").alias("keys")), "classes")
    n_classes = classes.count()
    places = classes.select("id", F.posexplode("keys").alias("at", "cell"))
    sizes = places.groupBy("at", "cell").agg(F.count("*").alias("n")).filter("n > 1").select("at", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = store(sizes, "cell-sizes")
    wanted = join_ids(places, sizes, sizes.count(), ["at", "cell"], "inner", 24).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    to = F.struct("at", "cell", "block", "blocks")
    wanted = store(wanted.groupBy("id").agg(F.collect_list(to).alias("to")).join(classes, "id").select(F.col("id").alias("vec_id"), "digest", "weight", "keys", "to"), "cells")
    own = map_texts(given.select("vec_id", "vector", F.col("vector").alias("v")), lambda: _digests, "digest binary", ["vec_id", "vector"], "v")
    cut = join_ids(own, wanted, n_classes, ["vec_id", "digest"], "inner", 60 + 36 * TABLES).select(F.explode("to").alias("to"), F.col("vec_id").alias("id"), "weight", "keys", "vector").select("to.*", "id", "weight", "keys", "vector")
    dealt = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = dealt.select("cell", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("side"), (F.col("block") != F.col("with")).alias("two"), "at", "id", "weight", "keys", "vector")
    links = store(group.repartition("at", "cell", "i", "j").sortWithinPartitions("at", "cell", "i", "j").mapInArrow(tidy(_links), "u long, v long, links long"), "vector-links")
    counts = links.filter("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    parts = connected_components(links.filter("v is not null").select("u", "v"))
    of = classes.select("digest", "id", "weight").join(counts, F.col("id") == F.col("u"), "left").drop("u").join(parts, "id", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = clean.select("vec_id", "digest").join(of, "digest", "left")
    component = F.coalesce("component", "vec_id")
    linked = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.when(linked, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(linked, component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
