"""Whitening of embeddings by covariances that are exact until the last step.

Entries become whole numbers. One pass over the distinct vectors gives their number and the sum of each dimension; a second
one adds up, in whole numbers, the squares of the centred value of every dimension and of every sum of two dimensions. By
polarisation, cov(a, b) = (var(a + b) - var(a) - var(b)) / 2. The matrix goes to ``eigh``; its size depends on the number of
dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.storage import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Vectors whose pair sums are formed at once.
BLOCK = 512
#: Sums of squares are added up in Spark as ``high * 2^60 + low``, so that decimals of 38 digits hold them.
LIMB = 1 << 60


def whole_entries(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))


def usable(vector: Column) -> Column:
    """Whether there is a vector with entries, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _exact_squares(values: np.ndarray) -> np.ndarray:
    """Sum of squares of each column, as Python integers; ``values`` are whole numbers below 2^63 in size."""
    if not len(values):
        return np.zeros(values.shape[1], object)
    size = np.abs(values)
    limbs = [(size >> (21 * i)) & ((1 << 21) - 1) for i in range(3)]
    total = np.zeros(values.shape[1], object)
    for i in range(3):
        for j in range(i, 3):
            if limbs[j].any():
                part = np.einsum("ij,ij->j", limbs[i], limbs[j])  # at most BLOCK products below 2^42 each
                total += part.astype(object) * ((1 << (21 * (i + j))) * (1 if i == j else 2))
    return total


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: as 64-bit integers where they suffice for sums of two, else as Python integers."""
    low, high = x.min(0), x.max(0)
    widest = max(max(abs(n * int(a) - s), abs(n * int(b) - s), n * (int(b) - int(a))) for a, b, s in zip(low, high, sums))
    if widest < 1 << 61:
        return n * (x - low) + np.array([n * int(a) - s for a, s in zip(low, sums)], np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _pair_squares(y: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each dimension, then of each sum of two dimensions."""
    total = np.zeros(y.shape[1] + len(first), object)
    for at in range(0, len(y), BLOCK):
        block = y[at : at + BLOCK]
        both = np.hstack([block, block[:, first] + block[:, second]])
        total += (both * both).sum(0) if both.dtype == object else _exact_squares(both)
    return total


def _limbed(totals: list[int]) -> pa.RecordBatch:
    """Totals of a task as rows (key, high, low), so that Spark adds them up without rounding."""
    high, low = (pa.array(map(Decimal, v), pa.decimal128(38, 0)) for v in ([t // LIMB for t in totals], [t % LIMB for t in totals]))
    return pa.record_batch([pa.array(range(len(totals)), pa.int64()), high, low], names=["key", "high", "low"])


def _added(parts: DataFrame) -> dict[int, int]:
    """The totals by key, as Python integers: one row for each dimension or pair of dimensions."""
    rows = parts.groupBy("key").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {r["key"]: int(r["high"]) * LIMB + int(r["low"]) for r in rows}


LIMBED = "key long, high decimal(38,0), low decimal(38,0)"


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | None = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            own = np.append((x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object), len(x))
            total = own if total is None else total + own
    if total is not None:
        yield _limbed(total.tolist())


def _square_task(n: int, sums: list[int], first: np.ndarray, second: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                own = _pair_squares(_centred(_matrix(batch.column(0)), n, sums), first, second)
                total = own if total is None else total + own
        if total is not None:
            yield _limbed(total.tolist())

    return run


class Whitening:
    """A fitted transform: ``n``, ``sums``, ``components`` (columns), ``eigenvalues`` and ``explained``, and ``identity_error``."""

    def __init__(self, n: int, sums: list[int], squares: dict[int, int], components: int):
        dims = len(sums)
        first, second = np.triu_indices(dims, 1)
        self.n, self.sums = n, sums
        covariance, cube = np.zeros((dims, dims)), 2 * n**3
        for d in range(dims):
            covariance[d, d] = 2 * squares[d] / cube  # one rounding of an exact ratio
        for k, (i, j) in enumerate(zip(first.tolist(), second.tolist())):
            covariance[i, j] = covariance[j, i] = (squares[dims + k] - squares[i] - squares[j]) / cube
        trace = float(Fraction(sum(squares[d] for d in range(dims)), n**3))
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        rank = int((values > max(values[0], 0) * dims * np.finfo(float).eps).sum()) if dims else 0
        kept = min(rank, components)
        self.eigenvalues, self.components = values[:kept], vectors[:, :kept]
        self.explained = self.eigenvalues / trace if trace else self.eigenvalues
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened coordinates of each vector, and ``n * x - sums`` exactly."""
        y = _centred(x, self.n, self.sums)
        return (y.astype(float) / self.n) @ self.components / np.sqrt(self.eigenvalues), y


def _moments_task(fitted: Whitening):
    """Sums of whitened coordinates and of their products, one row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.eigenvalues)
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w, _ = fitted.project(_matrix(batch.column(0)))
                total, products = total + w.sum(0), products + w.T @ w
        values = np.concatenate([total, products.ravel()])
        yield pa.record_batch([pa.array(range(len(values)), pa.int64()), pa.array(values)], names=["key", "value"])

    return run


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, col: str = "x") -> Whitening | None:
    """The transform that whitens ``vectors``, whole-number arrays of one length, each distinct one counted once.

    Components are numbered by falling eigenvalue; those of no variance (below the rounding of ``eigh``) are not among
    them. No vectors give ``None``. The distinct vectors are stored; what reaches the driver is one number for each
    dimension and each pair of dimensions.
    """
    fit = stored(vectors.select(F.col(col).alias("x")).distinct(), "distinct-vectors")
    sums = _added(fit.mapInArrow(_sum_task, LIMBED))
    if not sums:
        return None
    dims = len(sums) - 1
    n, own = sums[dims], [sums[d] for d in range(dims)]
    first, second = np.triu_indices(dims, 1)
    squares = _added(fit.mapInArrow(_square_task(n, own, first, second), LIMBED))
    fitted = Whitening(n, own, squares, components)
    k = len(fitted.eigenvalues)
    moments = fit.mapInArrow(_moments_task(fitted), "key long, value double").groupBy("key").agg(F.sum("value").alias("value"))
    values = np.array([r["value"] for r in moments.sort("key").collect()])
    mean, products = values[:k] / n, values[k:].reshape(k, k) / n
    fitted.identity_error = float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    return fitted


def _whiten_task(fitted: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, y = fitted.project(_matrix(batch.column(1)))
            if y.dtype != object and np.abs(y).max() < 1 << 28:
                deviation = (y * y).sum(1).tolist()
            else:
                deviation = (y.astype(object) ** 2).sum(1).tolist()
            exact = pa.array([Decimal(d) for d in deviation], pa.decimal128(38, 0))
            yield pa.record_batch([batch.column(0), exact, pa.array(list(w), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """Whitened coordinates of every usable vector: id, ``deviation`` (decimal) and ``whitened`` (array); and the transform.

    An entry c counts as ``floor(64 c) + 1000000``. Vectors that are null or empty or hold null, NaN or infinite entries are
    left out of the fit and of the result; so are vectors of another length than the commonest (the longer of equally
    common ones). ``deviation`` is the exact sum of ``(n x - S)^2`` over the dimensions. Every row of the table counts in
    the result, whatever its id; further columns are ignored. Without usable vectors the result is empty.
    """
    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), whole_entries(F.col(vector_col)).alias("x"))
    rows = stored(rows, "whole-vectors")
    lengths = rows.groupBy(F.size("x").alias("size")).count().sort(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    rows = rows.filter(F.size("x") == lengths[0]["size"])
    fitted = fit_whitening(rows, components)
    out = rows.mapInArrow(_whiten_task(fitted), "id long, deviation decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("id", id_col), fitted
