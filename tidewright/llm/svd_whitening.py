"""Embedding whitening by hierarchical SVD merging.

Components are taken as integers, ``floor(scale * c)``, and every distinct vector
counts once.  Each partition keeps a summary of its vectors: their number, exact
sums, mean, and all singular values with their right vectors.  Two summaries merge
by stacking their scaled vectors and one more row, the difference of the means
times sqrt(n * m / (n + m)), and taking the SVD of the stack.  As no dimension is
dropped, a merge loses nothing.  Summaries are d x d at most, whatever the number
of vectors; they are merged in a tree of FAN at a time, each level a stored table.
The covariance matrix is never formed.

The whitening itself is made of array functions, joined by the vectors' length.

Defined cases: null vectors and those with a null or non-finite component are
dropped, empty ones too; repeated rows and null ids stay, each as a row; vectors of
different lengths have a fit of their own; scaled components beyond a long are cut
to its range, and a deviation beyond it is null; a component without variance (one
distinct vector, constant or dependent dimensions) has explained 0, or null where
the fit has no variance at all, and whitened null, and is left out of
identity_error; with no component of variance that is null; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import join_ids, store, tidy

#: Factor before the floor, summaries merged at once, and components that are returned.
SCALE, FAN, COMPONENTS = 256, 16, 4
#: Singular values below the largest times this and the longer side of the data are rounding errors.
EPSILON = float(np.finfo(np.float64).eps)

_SUMMARY = "dim int, part long, n long, sums array<decimal(38,0)>, mean array<double>, values array<double>, vectors array<double>"
_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


class Summary:
    """Number, exact sums, mean, singular values and right vectors (rows) of some vectors."""

    def __init__(self, n: int, sums: list[int], mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.mean, self.values, self.vectors = n, sums, mean, values, vectors

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of the rows of an integer matrix."""
        small = not x.size or max(abs(int(x.max())), abs(int(x.min()))) < (1 << 62) // len(x)
        sums = x.sum(axis=0).tolist() if small else [sum(c) for c in x.T.tolist()]
        mean = np.array([s / len(x) for s in sums])
        _, values, vectors = np.linalg.svd(x - mean, full_matrices=False)
        return cls(len(x), sums, mean, values, vectors)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        step = np.sqrt(self.n * (other.n / n)) * (other.mean - self.mean)
        stack = np.vstack((self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, step))
        _, values, vectors = np.linalg.svd(stack, full_matrices=False)
        sums = [a + b for a, b in zip(self.sums, other.sums)]
        return Summary(n, sums, np.array([s / n for s in sums]), values, vectors)

    def row(self, dim: int, part: int) -> pa.RecordBatch:
        cells = [dim, part, self.n, [Decimal(s) for s in self.sums], self.mean, self.values, self.vectors.ravel()]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _ARROW)], schema=_ARROW)


def _numbers(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summarise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary for each length of the vectors of a task."""
    from pyspark import TaskContext

    held: dict[int, Summary] = {}
    for batch in parts:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            new = Summary.of(_numbers(batch.column(1).filter(pa.array(dims == dim)), dim))
            held[dim] = held[dim].merge(new) if dim in held else new
    part = TaskContext.get().partitionId()
    for dim, found in held.items():
        yield found.row(dim, part)


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary for each (dim, part) of a task; rows come sorted by them."""
    key, held = None, None
    for batch in parts:
        for r in batch.to_pylist():
            values = np.array(r["values"])
            one = Summary(r["n"], [int(s) for s in r["sums"]], np.array(r["mean"]), values, np.array(r["vectors"]).reshape(len(values), r["dim"]))
            if (r["dim"], r["part"]) != key:
                if held is not None:
                    yield held.row(*key)
                key, held = (r["dim"], r["part"]), one
            else:
                held = held.merge(one)
    if held is not None:
        yield held.row(*key)


def usable(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, x): the usable rows with their integer components."""
    v = F.col(f"`{vector}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return embeddings.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)).select(F.col(f"`{key}`").alias("vec_id"), F.size(v).alias("dim"), x.alias("x"))


def summaries(fit: DataFrame) -> DataFrame:
    """One summary for each length of the vectors of ``fit`` (dim, x), merged level by level."""
    level = store(fit.select("dim", "x").mapInArrow(tidy(_summarise), _SUMMARY), "summaries")
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        up = level.withColumn("part", F.floor(F.col("part") / FAN)).select(*_ARROW.names)
        level = store(up.repartition("dim", "part").sortWithinPartitions("dim", "part", "n", "mean").mapInArrow(tidy(_merge), _SUMMARY), "summaries")
    return level


def _model(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eigenvalues and eigenvectors of each summary, all dimensions; each vector's largest entry is positive."""
    for batch in parts:
        for r in batch.to_pylist():
            d, s = r["dim"], np.array(r["values"])
            v = np.array(r["vectors"]).reshape(len(s), d)
            if len(s) < d:  # fewer vectors than dimensions: any basis of the rest
                v = np.vstack((v, np.linalg.svd(v, full_matrices=True)[2][len(s) :]))
                s = np.concatenate((s, np.zeros(d - len(s))))
            s = np.where(s > s[0] * EPSILON * max(r["n"], d), s, 0.0)
            sign = np.sign(v[np.arange(d), np.abs(v).argmax(axis=1)])
            e = s * s / r["n"]
            cells = [d, r["n"], r["sums"], r["mean"], e, (v * np.where(sign == 0, 1, sign)[:, None]).tolist(), float(e.sum())]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["dim", "n", "sums", "mean", "eigenvalues", "eigenvectors", "trace"])


def fit(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """The fit list (dim, x) and the model by length: n, sums, mean, all eigenvalues and eigenvectors, trace.  Both are stored."""
    distinct = store(usable(embeddings, vector, key, scale).select("dim", "x").distinct(), "fit-list")
    kind = "dim int, n long, sums array<decimal(38,0)>, mean array<double>, eigenvalues array<double>, eigenvectors array<array<double>>, trace double"
    return distinct, store(summaries(distinct).mapInArrow(tidy(_model), kind), "whitening")


def _whitened(components: int) -> tuple[Column, Column]:
    """x less the mean, and its first components in the model's basis over their standard deviations; null where these are 0."""
    centred = F.zip_with("x", "mean", lambda a, m: a - m)
    dots = F.transform(F.slice("eigenvectors", 1, components), lambda v: F.aggregate(F.zip_with(F.col("_c"), v, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    return centred, F.zip_with(dots, F.slice("eigenvalues", 1, components), lambda p, e: F.when(e > 0, p / F.sqrt(e)))


def apply(rows: DataFrame, model: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``rows`` (dim, x and others) with n, whitened (array), explained (array) and deviation.

    The model of few lengths is broadcast by its size, others are joined by the length."""
    columns = [c for c in rows.columns if c != "dim"]
    small = model.select("dim", "n", "mean", F.transform("sums", lambda s: s.try_cast("long")).alias("sums"), F.slice("eigenvalues", 1, components).alias("eigenvalues"), F.slice("eigenvectors", 1, components).alias("eigenvectors"), "trace")
    count, widest = model.agg(F.count("*"), F.max("dim")).first()
    joined = join_ids(rows, small, count, "dim", "inner", 8 * (components + 3) * (widest or 1))
    centred, whitened = _whitened(components)
    squares = F.zip_with("x", "sums", lambda x, s: F.try_subtract(F.try_multiply(F.col("n"), x), s))
    deviation = F.aggregate(F.transform(squares, lambda y: F.try_multiply(y, y)), F.lit(0).cast("long"), lambda a, b: F.try_add(a, b))
    explained = F.transform("eigenvalues", lambda e: F.when(F.col("trace") > 0, e / F.col("trace")))
    return joined.withColumn("_c", centred).select(*columns, "n", deviation.alias("deviation"), whitened.alias("whitened"), explained.alias("explained"))


def identity_error(fit_list: DataFrame, model: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(dim, identity_error): largest absolute entry of the covariance of the whitened fit list minus the identity."""
    white = apply(fit_list.withColumn("length", F.col("dim")), model, components).select(F.col("length").alias("dim"), "n", "whitened")
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    at = lambda i: F.get("whitened", F.lit(i))
    sums = white.groupBy("dim").agg(F.max("n").alias("n"), *[F.sum(at(i)).alias(f"s{i}") for i in range(components)], *[F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs])
    gaps = [F.abs(F.col(f"p{i}_{j}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n")) - (1.0 if i == j else 0.0)) for i, j in pairs]
    return sums.select("dim", F.array_max(F.array(*gaps)).alias("identity_error"))


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, n, deviation, identity_error, and arrays whitened and explained, for every usable row."""
    distinct, model = fit(embeddings, vector, key, scale)
    error = store(identity_error(distinct, model, components), "identity-error")
    rows = usable(embeddings, vector, key, scale).withColumn("length", F.col("dim"))
    out = apply(rows, model, components).withColumnRenamed("length", "dim").drop("x")
    return join_ids(out, error, error.count(), "dim", "left", 16)


def digests(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    wide = whiten(embeddings, components=components)
    each = wide.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value.whitened").alias("whitened"), F.col("value.explained").alias("explained"), "identity_error")
